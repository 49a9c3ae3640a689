from itertools import combinations

import numpy as np
import pytest

from octetflow.functions import gf256 as G
from octetflow.operators import shares as S

KEY, NONCE = bytes(range(32)), bytes(range(24))


def coefficients(k):
    return bytes((7 * i + 1) & 255 for i in range(32 * (k - 1)))


def test_field():
    assert (G.MUL[2, 128], G.MUL[83, 202], G.MUL[255, 255], G.INV[2], G.INV[83], G.INV[0]) == (29, 143, 226, 142, 140, 0)
    assert all(G.MUL[a, G.INV[a]] == 1 for a in range(1, 256))
    assert G.product(G.powers([1, 2, 3], 2), np.array([[10], [20]], np.uint8)).ravel().tolist() == [30, 34, 54]
    m = G.powers([1, 5, 9, 200], 4)
    assert (G.product(m, G.inverse(m)) == np.eye(4)).all()
    with pytest.raises(ValueError):
        G.inverse(np.ones((2, 2), np.uint8))


@pytest.mark.parametrize("n,k", [(1, 1), (3, 1), (3, 2), (5, 3), (4, 4)])
@pytest.mark.parametrize("size", [0, 1, 2, 3, 100, 4096 * 3 - 1, 4096 * 3, 4096 * 3 + 1])
def test_any_k(n, k, size):
    data = bytes(i * 31 & 255 for i in range(size))
    made = S.split(data, n, k, KEY, NONCE, coefficients(k))
    assert all(len(s["payload"]) == -(-size // k) for s in made)
    for some in combinations(made, k):
        assert S.integrate(list(some)) == data
    assert S.integrate(made) == data  # more than needed
    assert S.read_share(S.write_share(made[0])) == made[0] and len(S.write_share(made[0])) == 101 + -(-size // k)


def test_failures():
    made = S.split(b"secret" * 50, 5, 3, KEY, NONCE, coefficients(3))
    other = S.split(b"secret" * 50, 5, 3, KEY, bytes(24), coefficients(3))
    for bad in (
        [], made[:2], [made[0], made[0], made[1]], [made[0], made[1], other[2]], [made[0], made[1], {**made[2], "payload": bytes(len(made[2]["payload"]))}],
        [{**s, "orig_size": 10_000} for s in made], [made[0], made[1], {**made[2], "key_share": bytes(32)}],
    ):
        with pytest.raises(ValueError):
            S.integrate(bad)
    for n, k in ((0, 0), (2, 3), (256, 2), (3, 0)):
        with pytest.raises(ValueError):
            S.check(n, k)
    with pytest.raises(ValueError):
        S.read_share(b"short")
    with pytest.raises(ValueError):
        G.split_secret(KEY, 3, 2, b"")


def test_tables(spark):
    rows = [("a", b"abc" * 1000), ("b", b"")]
    files = spark.createDataFrame(rows, "path string, content binary")
    made = S.split_files(files, 5, 3, KEY, coefficients(3))
    assert {r.path: r.agree for r in S.consistent(made).collect()} == {"a": True, "b": True}
    assert len({bytes(r.nonce) for r in made.collect()}) == 2
    back = S.integrate_files(made.filter("share_id in (1, 4, 5)"))
    assert {r.path: bytes(r.content) for r in back.collect()} == dict(rows)
    sizes = {(r.path, r.share_id): (r.payload_bytes, r.share_bytes) for r in S.share_sizes(files, 5, 3).collect()}
    assert sizes == {(r.path, r.share_id): (len(r.payload), len(r.payload) + 101) for r in made.collect()}
    with pytest.raises(Exception, match="3 shares are needed"):
        S.integrate_files(made.filter("share_id < 3")).collect()


def test_a_full_batch_is_worked_on_in_stretches(spark, monkeypatch):
    """However many files a batch holds, split, integrate and disperse give back a few at once."""
    from pyspark.sql import functions as F

    from octetflow.functions import batches
    from octetflow.operators import blocks

    assert list(batches.stretches(np.array([1, 1, 9, 0, 1, 1, 1]), 3)) == [(0, 2), (2, 3), (3, 7)] and list(batches.stretches(np.array([], int), 3)) == []
    files = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("path"), F.expr("encode(repeat('x', 100000 + cast(id as int)), 'utf-8')").alias("content")).cache()

    plain = type(files).mapInArrow
    made = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, *a: made.append((self, f)) or plain(self, f, *a))
    parts = S.split_files(files, 5, 3, KEY, coefficients(3))
    back = S.integrate_files(parts)
    spread = blocks.disperse(files.select("path", F.lit(0).cast("long").alias("block_no"), F.col("content").alias("bytes")), 5, 3, KEY, NONCE, 192 * 1000)
    for rows, f in made:
        whole = rows.toArrow().combine_chunks().to_batches()
        sizes = [b.num_rows for b in f(iter(whole))]
        assert len(whole) == 1 and len(sizes) > 1 and max(sizes) < sum(sizes), sizes
    assert {r.path: len(r.content) for r in back.collect()} == {str(i): 100000 + i for i in range(40)}
    assert spread.count() == parts.count() == 200
