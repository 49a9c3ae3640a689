"""Digests of byte strings in the text forms that stored metadata uses."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, 2**64 - 1
#: With fewer strings left than this, a loop over bytes beats NumPy over strings.
_FEW = 24


def fnv1a(data: bytes, start: int = OFFSET) -> int:
    h = start
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return h


def _columns(items: list[bytes], width: int, step) -> np.ndarray:
    ends = np.cumsum([0, *map(len, items)])
    return _folded(np.frombuffer(b"".join(items), np.uint8), ends, width, step)


def _folded(joined: np.ndarray, ends: np.ndarray, width: int, step) -> np.ndarray:
    """Folds all strings at once, one unit of ``width`` bytes after another; ``step(h, unit)`` gives the next state. String i is what ``joined`` holds from ends[i] to ends[i + 1]."""
    h = np.full(len(ends) - 1, OFFSET, np.uint64)
    sizes = np.diff(ends) // width
    order = np.argsort(-sizes, kind="stable")
    starts = ends[:-1][order]
    live, k, sizes = len(h), 0, sizes[order]
    state = h[order]
    while live:
        live = int(np.searchsorted(-sizes, -k, "left"))  # those with more than k units
        if live < _FEW:
            break
        at = starts[:live] + k * width
        unit = joined[at].astype(np.uint64)
        for j in range(1, width):
            unit |= joined[at + j].astype(np.uint64) << np.uint64(8 * j)
        state[:live] = step(state[:live], unit)
        k += 1
    h[order] = state
    for i in order[:live].tolist():  # the few long ones that are left
        x, item = int(h[i]), joined[ends[i] : ends[i + 1]].tobytes()
        for j in range(k, len(item) // width):
            x = (x ^ int.from_bytes(item[j * width : (j + 1) * width], "little")) * PRIME & MASK
        h[i] = x
    return h


def fnv1a_many(items: list[bytes]) -> np.ndarray:
    return _columns(items, 1, lambda h, b: (h ^ b) * np.uint64(PRIME))


def fnv1a_column(column: pa.Array) -> np.ndarray:
    """The same of a binary column, from its buffers: no value is copied. What stands for a null means nothing."""
    wide = column.cast(pa.large_binary())
    _, ends, data = wide.buffers()
    ends = np.frombuffer(ends, np.int64, len(wide) + 1, 8 * wide.offset) if len(wide) else np.zeros(1, np.int64)
    return _folded(np.frombuffer(data or b"", np.uint8), ends, 1, lambda h, b: (h ^ b) * np.uint64(PRIME))


def transfer(data: bytes, lanes: int = 64) -> tuple[int, np.ndarray]:
    """What ``data`` does to any FNV-1a state, as (power, table): h becomes h * power + table[h & 255].

    Xor touches the low byte alone and that byte's course depends on its own start only, so a stretch of bytes is known from 256
    starts. Stretches can thus be folded apart, in parallel, and put together by ``chained``."""
    size = max(1, len(data) // max(1, min(lanes, len(data) // 64)))
    cut = len(data) // size * size
    power, out = 1, np.zeros(256, np.uint64)
    for part in (np.frombuffer(data[:cut], np.uint8).reshape(-1, size), np.frombuffer(data[cut:], np.uint8).reshape(1, -1)):
        if part.size:
            h = np.broadcast_to(np.arange(256, dtype=np.uint64), (len(part), 256)).copy()
            for b in part.T.astype(np.uint64):
                h ^= b[:, None]
                h *= np.uint64(PRIME)
            p = pow(PRIME, part.shape[1], 2**64)
            for row in h - np.arange(256, dtype=np.uint64) * np.uint64(p):
                power, out = chained((power, out), (p, row))
    return power, out


def chained(first: tuple[int, np.ndarray], then: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The transfer of one stretch after the other."""
    (p, x), (q, y) = first, then
    middle = np.arange(256, dtype=np.uint64) * np.uint64(p) + x
    return p * q & MASK, x * np.uint64(q) + y[(middle & np.uint64(255)).astype(np.int64)]


def after(state: int, step: tuple[int, np.ndarray]) -> int:
    return (state * step[0] + int(step[1][state & 255])) & MASK


def word_fnv_many(items: list[bytes]) -> np.ndarray:
    """FNV over little-endian 8-byte words, then over the bytes that are left, folded by h ^ h >> 32. The length is no part of it."""
    h = _columns(items, 8, lambda h, w: (h ^ w) * np.uint64(PRIME))
    for i, x in enumerate(items):
        if tail := x[len(x) // 8 * 8 :]:
            h[i] = fnv1a(tail, int(h[i]))
    return h ^ (h >> np.uint64(32))


def word_fnv(data: bytes) -> int:
    return int(word_fnv_many([data])[0])


def _udf(make, kind="string"):
    return F.arrow_udf(lambda x: pa.array(make(x.to_pylist()), pa.string() if kind == "string" else pa.binary()), kind)


def _each(f):
    return lambda xs: [None if x is None else f(x) for x in xs]


def sha256(content: Column) -> Column:
    """Lower-case hex."""
    return F.sha2(content, 256)


def crc32(content: Column) -> Column:
    """Upper-case hex without leading zeros."""
    return F.hex(F.crc32(content))


def xxh3(content: Column) -> Column:
    """XXH3-64, seed 0: upper-case hex without leading zeros."""
    return _udf(_each(lambda x: f"{xxhash.xxh3_64_intdigest(x):X}"))(content)


def fnv(content: Column) -> Column:
    """FNV-1a 64: 16 lower-case hex digits."""

    def run(x):
        return pa.array([f"{h:016x}" for h in fnv1a_column(x).tolist()], pa.string(), mask=x.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "string")(content)


def fnv_expression(content: Column) -> Column:
    """The same without Python: a fold over hex digits in two 32-bit halves (the prime is 2**40 + 435). Slow; a cross-check."""
    low = F.lit(0xFFFFFFFF)
    hexed = F.hex(content)
    digits = F.filter(F.split(F.regexp_replace(hexed, "(..)", "$1 "), " "), lambda x: x != "")

    def step(s, d):
        x = s["lo"].bitwiseXOR(F.conv(d, 16, 10).cast("long"))
        p = x * 435
        return F.struct((s["hi"] * 435 + F.shiftright(p, 32) + x * 256).bitwiseAND(low).alias("hi"), p.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(OFFSET >> 32).alias("hi"), F.lit(OFFSET & 0xFFFFFFFF).alias("lo"))
    return F.aggregate(digits, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def blake2b(content: Column, key: bytes = b"") -> Column:
    """BLAKE2b-256, keyed or not: lower-case hex."""
    return _udf(_each(lambda x: hashlib.blake2b(x, digest_size=32, key=key).hexdigest()))(content)


def hmac_sha256(content: Column, key: bytes) -> Column:
    return _udf(_each(lambda x: hmac.new(key, x, hashlib.sha256).hexdigest()))(content)


def password_key(password: str | bytes) -> bytes:
    """32 bytes from a password: BLAKE2b-256, no salt, as stored images expect."""
    return hashlib.blake2b(password.encode() if isinstance(password, str) else password, digest_size=32).digest()


def key_bytes(key: str | bytes) -> bytes:
    """A key of 32 bytes stands for itself; any other length is folded by BLAKE2b-256."""
    raw = key.encode() if isinstance(key, str) else key
    return raw if len(raw) == 32 else password_key(raw)


def mac_key(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=32, key=b"HMAC-KEY").digest()


same = hmac.compare_digest
