import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from octetflow.operators import archive as A
from octetflow.sources import files as store

ENTRIES = [("a.txt", b"abc"), ("a/b", b""), ("z/ü", b"12"), ("z/a/b", bytes(300))]


def table(spark, rows=ENTRIES, folder="f"):
    return spark.createDataFrame([(folder, p, d) for p, d in rows], "folder string, relative_path string, content binary")


def test_golden():
    assert A.pack_entries(ENTRIES[:2]).hex() == "0200000003000000612f62000000000000000005000000612e7478740300000000000000616263"
    assert sorted(A.unpack_entries(A.pack_entries(ENTRIES))) == sorted(ENTRIES) and A.unpack_entries(A.pack_entries([])) == []


def test_tables(spark):
    packed = A.pack(table(spark), ["folder"])
    assert bytes(packed.first().archive) == A.pack_entries(ENTRIES)
    assert sorted((r.relative_path, bytes(r.data)) for r in A.unpack(packed).collect()) == sorted(ENTRIES)
    zips = A.zip_pack(table(spark), ["folder"])
    assert sorted((r.relative_path, bytes(r.data)) for r in A.zip_unpack(zips).collect()) == sorted(ENTRIES)
    assert bytes(A.zip_to_archive(zips).first().archive) == A.pack_entries(ENTRIES)
    again = A.archive_to_zip(packed).first().archive
    assert sorted(A.zip_entries(bytes(again))) == sorted(ENTRIES)


def many(n=700):
    r = random.Random(8)
    return [(f"{'hot' if i % 3 else 'cold'}", f"d{r.randrange(9)}/{i}{'.x' * (i % 3)}", r.randbytes(r.randrange(40))) for i in range(n)]


def test_layout_and_pieces_over_many_tasks(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(many(), "folder string, relative_path string, content binary").repartition(4)
        placed = A.layout(df.withColumn("size", F.octet_length("content")), ["folder"]).collect()
        parts = A.pieces(df, ["folder"]).collect()
        split = A.volumes(df, ["folder"], 2000).collect()
        store.register(spark)
        A.pieces(df.filter("folder = 'hot'")).write.format("octet_archive").mode("append").save(f"file://{tmp_path}/x/hot.cfup")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("hot", "cold"):
        own = [(p, d) for f, p, d in many() if f == name]
        whole = A.pack_entries(own)
        pieces = sorted((r.offset, bytes(r.piece)) for r in parts if r.folder == name)
        assert b"".join(p for _, p in pieces) == whole
        order = [p for p, _ in A.unpack_entries(whole)]
        assert [r.relative_path for r in sorted((r for r in placed if r.folder == name), key=lambda r: r.idx)] == order
        assert all(whole[r.offset + 4 : r.offset + 4 + len(r.relative_path)] == r.relative_path.encode() for r in placed if r.folder == name)
        sizes = {}
        for r in split:
            if r.folder == name:
                sizes[r.volume] = sizes.get(r.volume, 0) + 12 + len(r.relative_path) + len(r.content)
        assert len(sizes) > 3 and max(sizes.values()) < 2100
    assert sorted(p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")) == ["hot.cfup"]
    assert (tmp_path / "x/hot.cfup").read_bytes() == A.pack_entries([(p, d) for f, p, d in many() if f == "hot"])


def test_unsafe_and_damaged():
    good = A.pack_entries(ENTRIES)
    for bad in ("/etc/x", "../x", "a/../../x", "a\\..\\x", "C:x", ""):
        with pytest.raises(ValueError):
            A.unpack_entries(A.pack_entries([(bad, b"")]))
    for cut in (3, 10, len(good) - 1):
        with pytest.raises(ValueError):
            A.unpack_entries(good[:cut])


def test_zip_names():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b/", b"")
        z.writestr("b\\c.txt", b"1")
        z.writestr("a", b"2")
    assert A.zip_entries(out.getvalue()) == [("a", b"2"), ("b/c.txt", b"1")]


def test_empty(spark):
    none = table(spark, [])
    assert A.pack(none, ["folder"]).count() == 0 and A.pieces(none, ["folder"]).count() == 0
    assert [bytes(r.piece) for r in A.pieces(none).collect()] == [bytes(4)]


def test_a_path_that_stands_twice_is_an_error(spark):
    df = spark.createDataFrame([("f", "a", bytearray(b"1")), ("f", "a", bytearray(b"2"))], "folder string, relative_path string, content binary")
    for made in (A.volumes(df, ["folder"], 100), A.pieces(df, ["folder"])):
        with pytest.raises(Exception, match="more than once"):
            made.collect()


def test_one_archive_at_a_time(spark):
    """Steps take from a batch, or from sorted rows, what one archive needs, and run in one worker where they follow each other."""
    import pyarrow as pa

    taken = []

    def rows():
        for k in range(4):
            taken.append(k)
            yield pa.RecordBatch.from_pylist([{"by": k, "relative_path": p, "content": d} for p, d in sorted(ENTRIES)])

    made = A._gathering(1, A._Zip)(rows())
    assert sorted(A.zip_entries(bytes(next(made)[1]))) == sorted(ENTRIES) and taken == [0, 1] and len(list(made)) == 3

    whole, turned = pa.RecordBatch.from_pylist([{"by": k, "archive": A.pack_entries(ENTRIES)} for k in range(4)]), []
    one = A._turning(lambda x: turned.append(1) or x)(A._standing(1)(iter([whole])))
    found = A._entries(["by"], A._read)(one)
    assert next(found).num_rows == 4 and len(turned) == 1 and sum(b.num_rows for b in found) == 12

    df = table(spark, [(f"{k}/x", bytes(2_000_000)) for k in range(6)])
    back = A.zip_unpack(A.archive_to_zip(A.zip_to_archive(A.zip_pack(df, ["folder"]))))
    assert back._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.idx, r.relative_path, len(r.data)) for r in back.collect()) == [(k, f"{k}/x", 2_000_000) for k in range(6)]
    filtered = A.unpack(A.pack(df, ["folder"]).filter("folder = 'f'").withColumn("more", F.lit(7)))  # a step of Spark's in between
    assert filtered.columns == ["folder", "more", "idx", "relative_path", "data_size", "data"] and {r.more for r in filtered.collect()} == {7}
    assert [bytes(A.pack(df.limit(n), []).first().archive) for n in (0, 1)] == [A.pack_entries([]), A.pack_entries([(df.first().relative_path, bytes(2_000_000))])]


def test_an_archive_goes_before_the_next_is_made():
    import weakref

    class Held(bytearray):
        pass

    alive = weakref.WeakSet()

    def make(x):
        assert not alive, "the archive before is still held"
        out = Held(x)
        alive.add(out)
        return out

    Held.__hash__ = lambda self: id(self)
    good = A.pack_entries(ENTRIES)
    one = A._turning(make)((([], good) for _ in range(3)))
    assert [b.num_rows for b in A._entries([], A._read)(one)] == [4, 4, 4]
