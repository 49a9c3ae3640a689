import io
import zipfile

import pytest
from pyspark.sql import functions as F

from octetflow.functions import names
from octetflow.operators.archive import pack_entries
from octetflow.operators.shares import split, write_share
from octetflow.sources import files as S
from octetflow.streaming import files as stream


def folder(tmp_path):
    at = tmp_path / "in put"
    (at / "sub").mkdir(parents=True)
    (at / "a.txt").write_bytes(b"abc")
    (at / "sub" / "b.bin").write_bytes(b"")
    (at / "sub" / "50%+ é").write_bytes(b"")
    return at


def test_scan(spark, tmp_path):
    at = folder(tmp_path)
    rows = {r.relative_path: (r.size, bytes(r.content)) for r in S.scan(spark, f"file://{at}").collect()}
    assert rows == {"a.txt": (3, b"abc"), "sub/b.bin": (0, b""), "sub/50%+ é": (0, b"")}
    assert [r.relative_path for r in S.scan(spark, str(at), recursive=False).collect()] == ["a.txt"]


def test_scan_prunes(spark, tmp_path):
    plan = S.scan(spark, str(folder(tmp_path))).filter("size > 2").select("relative_path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,2)" in plan and "content" not in plan.split("ReadSchema")[-1]


def test_readers(spark, tmp_path):
    (tmp_path / "a.cfup").write_bytes(pack_entries([("x/y", b"1")]))
    assert [(r.relative_path, bytes(r.data)) for r in S.read_archives(spark, str(tmp_path / "a.cfup")).collect()] == [("x/y", b"1")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("q", b"22")
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    assert [(r.relative_path, bytes(r.data)) for r in S.read_zips(spark, str(tmp_path / "a.zip")).collect()] == [("q", b"22")]
    share = split(b"hello", 3, 2, bytes(32), bytes(24), bytes(range(32)))[1]
    (tmp_path / "s.cfs").write_bytes(write_share(share))
    row = S.read_shares(spark, str(tmp_path / "s.cfs")).first()
    assert (row.share_id, row.k, row.orig_size, bytes(row.payload)) == (2, 2, 5, share["payload"])
    (tmp_path / "m.mtd").write_text('{\n"a": "b",\n"c": "d"\n}')
    assert S.read_metadata(spark, str(tmp_path / "m.mtd")).first().fields == {"a": "b", "c": "d"}


def test_sinks(spark, tmp_path):
    S.register(spark)
    rows = [(f"d{i % 3}/f{i}", bytes([i])) for i in range(20)]
    df = spark.createDataFrame(rows, "relative_path string, content binary").repartition(4)
    df.write.format("octet_files").mode("append").save(f"file://{tmp_path}/out")
    got = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == dict(rows)
    S.write_bytes(spark, f"file://{tmp_path}/one", b"xyz")
    assert (tmp_path / "one").read_bytes() == b"xyz"


def test_names(spark):
    paths = ["a/b.txt", "a/.x", "x.tar.gz", "dir/", "n"]
    p = F.col("p")
    out = spark.createDataFrame([(x,) for x in paths], "p string").select(names.basename(p), names.stem(p), names.extension(p), names.zip_entry_kept(p)).collect()
    assert [tuple(r) for r in out] == [("b.txt", "b", ".txt", True), (".x", ".x", "", True), ("x.tar.gz", "x.tar", ".gz", True), ("dir", "dir", "", False), ("n", "n", "", True)]
    nums = spark.createDataFrame([(x,) for x in ("5", "-7", "5abc", "", None, "99999999999999999999")], "p string")
    assert [r[0] for r in nums.select(names.strict_int(p)).collect()] == [5, -7, None, None, None, None]
    rel = spark.createDataFrame([("C:\\x\\y\\z",)], "p string").select(names.relative(p, "C:\\x\\")).first()[0]
    assert rel == "y/z"


def test_stream(spark, tmp_path):
    at = folder(tmp_path)
    table, check = str(tmp_path / "t"), str(tmp_path / "c")

    def drain():
        stream.to_table(stream.digested(stream.arriving(spark, str(at), 1)), table, check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path.rsplit("/", 1)[-1], r.size, r.fnv, r.format) for r in spark.read.parquet(table).collect())

    assert drain() == [("a.txt", 3, "e71fa2190541574b", "Unknown")]
    (at / "sub" / "c.bin").write_bytes(b"\x28\xb5\x2f\xfd")
    assert [r[0] for r in drain()] == ["a.txt", "c.bin"] and drain()[1][3] == "ZSTD"
    chunks = stream.chunked(stream.arriving(spark, str(at)))
    stream.to_table(chunks, str(tmp_path / "t2"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 2
    counts = stream.arrivals(stream.arriving(spark, str(at)))
    query = counts.writeStream.format("memory").queryName("arrivals").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.files for r in spark.table("arrivals").collect()) == 2


@pytest.mark.parametrize("kind", ["octet_files", "octet_archive"])
def test_sinks_refuse_other_stores(spark, kind):
    S.register(spark)
    df = spark.createDataFrame([("a", bytearray(b"x"), 0, bytearray(b"x"))], "relative_path string, content binary, offset long, piece binary")
    with pytest.raises(Exception, match="not to hdfs"):
        df.write.format(kind).mode("append").save("hdfs://host/folder")
