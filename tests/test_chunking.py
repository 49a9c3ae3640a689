import random

import pytest

from octetflow.functions.digests import word_fnv
from octetflow.operators.chunking import GEAR, chunk_index, chunk_rows, cuts


def literal(data):
    """Byte by byte: a 32-bit rolling hash, reset at each cut."""
    out, pos, h, n = [], 0, 0, 0
    for i, b in enumerate(data):
        h, n = ((h << 1) ^ int(GEAR[b])) & 0xFFFFFFFF, n + 1
        mask = 0x1FF if n < 512 else 0xFF if n <= 768 else 0x7F
        if n >= 256 and (h & mask == 0 or n >= 1024):
            out.append((pos, n, 0))
            pos, h, n = i + 1, 0, 0
    return out + ([(pos, n, 2)] if n else [])


def test_golden():
    data = bytes((i * i * 31 + i * 7 + (i >> 5)) & 255 for i in range(4096))
    found = cuts(data)
    assert found == [(0, 546, 0), (546, 739, 0), (1285, 538, 0), (1823, 660, 0), (2483, 788, 0), (3271, 474, 0), (3745, 351, 2)]
    hashes = [f"{word_fnv(data[p : p + n]):016x}" for p, n, _ in found]
    assert hashes == ["7630ec6871760719", "7dc32bede64c3a98", "6c71f362b774911b", "23467678e9b5dc0e", "c8f9fd0188861db2", "75082285a71f6d31", "35523f2a2e5cebe3"]
    assert [n for _, n, _ in cuts(b"\xff" * 3000)] == [256] * 11 + [184]
    assert f"{word_fnv(bytes([255]) * 256):016x}" == "e024889c4602b119"
    fox = b"The quick brown fox jumps over the lazy dog. " * 400
    assert len(cuts(fox)) == 18 and [f"{word_fnv(fox[p : p + n]):016x}" for p, n, _ in cuts(fox)[:2]] == ["ae145d211c700997", "1348f56a456272f0"]


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 511, 512, 768, 769, 1023, 1024, 1025, 5000, 70_000])
def test_as_byte_by_byte(size):
    r = random.Random(size)
    for data in (r.randbytes(size), b"\0" * size, bytes(r.choice(b"etaoin shrdlu") for _ in range(size)), bytes(r.choice(range(150, 256)) for _ in range(size))):
        assert cuts(data) == literal(data)


def test_rows_and_index(spark):
    data = random.Random(2).randbytes(9000)
    files = spark.createDataFrame([("a", data), ("b", data), ("c", b""), ("d", None)], "path string, content binary")
    rows = chunk_rows(files).collect()
    assert sorted((r.path, r.pos, r.len, r.level) for r in rows) == sorted((p, *c) for p in "ab" for c in cuts(data))
    index = {r.hash: (r.last_pos, r.copies) for r in chunk_index(chunk_rows(files)).collect()}
    assert all(copies == 2 for _, copies in index.values()) and len(index) == len(cuts(data))
