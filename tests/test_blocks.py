import random

import pytest
from pyspark.sql import functions as F

from octetflow.functions import chacha
from octetflow.functions.digests import fnv1a
from octetflow.operators import blocks as B
from octetflow.operators import shares as S
from octetflow.sources import files as store

KEY, NONCE = bytes(range(32)), bytes(range(24))
SIZES = [0, 1, 3071, 3072, 3073, 20_000]


def table(spark):
    r = random.Random(6)
    data = {f"f{n}": r.randbytes(n) for n in SIZES}
    return data, spark.createDataFrame(list(data.items()), "path string, content binary")


def joined(rows, key="path"):
    out = {}
    for r in sorted(rows, key=lambda r: r.block_no):
        out[r[key]] = out.get(r[key], b"") + bytes(r["bytes"])
    return out


def test_cut_and_digest(spark):
    data, files = table(spark)
    cut = B.cut(files, 3072)
    assert joined(cut.collect()) == data
    assert {r.path: (r.fnv, r.size) for r in B.fnv(cut.repartition(5)).collect()} == {k: (f"{fnv1a(v):016x}", len(v)) for k, v in data.items()}


def test_cipher_is_that_of_whole_files(spark):
    big = random.Random(1).randbytes(chacha.BATCH + 500)
    made = B.cipher(B.cut(spark.createDataFrame([("a", big), ("e", b"")], "path string, content binary")), KEY)
    assert joined(made.collect()) == {"a": chacha.batch_cipher(KEY, big), "e": b""}


def test_shares_are_those_of_whole_files(spark, tmp_path):
    n, k, size = 4, 3, 3072
    data, files = table(spark)
    parts = B.disperse(B.cut(files, size), n, k, KEY, NONCE, size)
    macs = {(r.path, r.share_id): bytes(r.hmac) for r in B.authenticate(parts, KEY).collect()}
    got = {}
    for r in sorted(parts.collect(), key=lambda r: r.block_no):
        got[r.path, r.share_id] = got.get((r.path, r.share_id), b"") + bytes(r["bytes"])
    for path, d in data.items():
        for s in S.split(d, n, k, KEY, NONCE, bytes(64)):
            assert got[path, s["share_id"]] == s["payload"] and macs[path, s["share_id"]] == s["hmac"]
    name = "f20000"
    back = B.restore(parts.filter((F.col("path") == name) & (F.col("share_id") != 2)), k, KEY, NONCE, size, 20_000)
    store.register(spark)
    B.placed(back, size).write.format("octet_archive").mode("append").save(f"file://{tmp_path}/back")
    assert (tmp_path / "back").read_bytes() == data[name]
    with pytest.raises(Exception, match="lacks shares"):
        B.restore(parts.filter("share_id < 3"), k, KEY, NONCE, size, 20_000).collect()
    with pytest.raises(ValueError):
        B.disperse(parts, n, k, KEY, NONCE, 100)


def test_files_are_read_by_ranges(spark, tmp_path):
    import hashlib
    import zlib

    import xxhash

    from octetflow.operators import blocks
    from octetflow.sources import files

    files.register(spark)
    data = {"a.bin": bytes(range(256)) * 5000, "sub/b.bin": b"x" * 70_000, "empty": b"", "é.txt": b"short"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    df = spark.read.format("octet_blocks").option("blockSize", "65536").option("taskBytes", "200000").load(f"file://{tmp_path}")
    assert df.rdd.getNumPartitions() > 5
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in blocks.digests(df).collect()}
    assert set(got) == set(data)
    for name, content in data.items():
        r = got[name]
        assert (r.sha, r.crc, r.xxh, r.size) == (hashlib.sha256(content).hexdigest(), f"{zlib.crc32(content):X}", f"{xxhash.xxh3_64_intdigest(content):X}", len(content))
    assert {r.path.removeprefix(f"{tmp_path}/"): r.size for r in blocks.fnv(df).collect()} == {n: len(c) for n, c in data.items()}
    one = spark.read.format("octet_blocks").load(f"file://{tmp_path}/a.bin")
    assert one.select("path", "size").distinct().collect()[0].size == len(data["a.bin"])


def test_a_file_beyond_two_gibibytes(spark, tmp_path):
    import hashlib

    from octetflow.operators import blocks
    from octetflow.sources import files

    files.register(spark)
    size = (2 << 30) + 12_345
    with open(tmp_path / "sparse", "wb") as f:
        f.seek(size - 3)
        f.write(b"end")
    want = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        want.update(bytes(1 << 20))
    want.update(bytes(size % (1 << 20) - 3) + b"end")
    (row,) = blocks.digests(spark.read.format("octet_blocks").option("blockSize", str(8 << 20)).load(f"file://{tmp_path}/sparse")).collect()
    assert (row.size, row.sha) == (size, want.hexdigest())
