import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from octetflow.functions import digests as D


def test_golden():
    assert f"{D.fnv1a(b''):016x}" == "cbf29ce484222325"
    assert f"{D.fnv1a(b'abc'):016x}" == "e71fa2190541574b"
    assert f"{D.word_fnv(b'abc'):016x}" == "e71fa219e25ef552"
    assert f"{D.word_fnv(b'abcdefgh1'):016x}" == "e8f75229a12c410e"
    assert D.password_key("password").hex() == "344b8a854221bd1eaf9382daaea1996fbcd496f158e983f8835c7ef5084c55bb"
    assert D.mac_key(bytes(32)).hex() == "cc0112201fd79774ed57ac3841c2d47ea5ff218d428a7d2c031038176845ce09"


def test_columns(spark):
    rows = [(b"abc",), (b"",), (None,)]
    c = F.col("c")
    out = spark.createDataFrame(rows, "c binary").select(D.sha256(c), D.crc32(c), D.xxh3(c), D.fnv(c), D.blake2b(c), D.hmac_sha256(c, b"k")).collect()
    assert out[0][:4] == (hashlib.sha256(b"abc").hexdigest(), "352441C2", "78AF5F94892F3950", "e71fa2190541574b")
    assert out[1][1:4] == ("0", "2D06800538D394C2", "cbf29ce484222325")
    assert list(out[2]) == [None] * 6


def test_many_as_one():
    r = random.Random(3)
    items = [r.randbytes(r.choice([0, 1, 7, 8, 9, 300, 5000])) for _ in range(200)]
    assert D.fnv1a_many(items).tolist() == [D.fnv1a(x) for x in items]
    word = []
    for x in items:
        h = D.OFFSET
        for k in range(0, len(x) // 8 * 8, 8):
            h = (h ^ int.from_bytes(x[k : k + 8], "little")) * D.PRIME & D.MASK
        for b in x[len(x) // 8 * 8 :]:
            h = (h ^ b) * D.PRIME & D.MASK
        word.append(h ^ h >> 32)
    assert D.word_fnv_many(items).tolist() == word


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 2**64 - 1))
def test_transfer(a, b, start):
    assert D.after(start, D.transfer(a)) == D.fnv1a(a, start)
    assert D.after(start, D.chained(D.transfer(a), D.transfer(b))) == D.fnv1a(a + b, start)


def test_transfer_of_long_stretches():
    data = random.Random(1).randbytes(30_011)
    assert D.after(D.OFFSET, D.transfer(data)) == D.fnv1a(data)
    assert D.transfer(b"")[0] == 1 and not np.any(D.transfer(b"")[1])


def test_expression_agrees(spark):
    rows = [(x,) for x in (b"", b"abc", bytes(range(256)))]
    out = spark.createDataFrame(rows, "c binary").select(D.fnv(F.col("c")), D.fnv_expression(F.col("c"))).collect()
    assert all(a == b for a, b in out)


def test_fnv_of_a_column_takes_its_buffers():
    import pyarrow as pa

    items = [b"", b"a", None, b"abc" * 50, bytes(1000), None] + [bytes([i]) * i for i in range(80)]
    for column in (pa.array(items, pa.binary()), pa.array([b"x", *items, b"y"], pa.binary()).slice(1, len(items)), pa.array(items, pa.large_binary())):
        assert [h for h, x in zip(D.fnv1a_column(column).tolist(), items, strict=True) if x is not None] == [D.fnv1a(x) for x in items if x is not None]
    assert D.fnv1a_column(pa.array([], pa.binary())).tolist() == [] and D.fnv1a_column(pa.array([None], pa.binary())).size == 1
    import tracemalloc

    column = pa.array([bytes(1 << 10)] * 20_000, pa.binary())
    tracemalloc.start()
    found = D.fnv1a_column(column)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found.tolist())) == 1 and most < 5 << 20  # of 20 MB
