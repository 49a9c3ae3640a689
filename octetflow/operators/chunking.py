"""Content-defined chunks of byte strings, and the index of chunks by hash."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetflow.functions.digests import word_fnv_many

# Bytes of a chunk at which its rule changes.
LEAST, MIDDLE, LATE, MOST = 256, 512, 768, 1024
# The rolling hash's word for each byte. Chunk boundaries depend on them. Bytes 192 to 255 stand for 0.
# fmt: off
GEAR = np.array(
    [
        0x67ed26b7, 0x32da500f, 0x53d0fee3, 0xce620efb, 0xd4c8c93c, 0xc6f250bb, 0x30ddc3e8, 0xa2a8515e,
        0x3bc9bd50, 0x4b136f67, 0x67a3b0c9, 0x42f66ef8, 0xf0842d0d, 0xdc56c4e5, 0x7b8b26b7, 0x8c8ca762,
        0xb0e7b346, 0x2482fb41, 0x7e315179, 0x27ff677e, 0xf8d0dc3f, 0x49d4b519, 0x64b0f3a1, 0x8fe3b520,
        0xf4ef00a3, 0x2c2f8f2d, 0x2b41b5c7, 0x2d7e4a6e, 0x89f4c7c8, 0x9f49ff7e, 0x9e847c80, 0x3c9e96cb,
        0x7c7f9df6, 0x4ff61e9f, 0x3d3e7e41, 0x6e2d4e27, 0x0e3f4c30, 0xf2c4c8f3, 0x3f13e0e6, 0x4d73aaf9,
        0x3d3e8444, 0x5e8e6c8c, 0xa3e8e8c0, 0xd3b1c3c7, 0x8a8c8484, 0xe3c0c0c0, 0x8c8c8c8c, 0xc0c0c0c0,
        0x1e6e6e6e, 0x7a7a7a7a, 0x4f4f4f4f, 0xb3b3b3b3, 0x26262626, 0x9a9a9a9a, 0x5d5d5d5d, 0xe1e1e1e1,
        0x38383838, 0x8c8c8c8c, 0x70707070, 0xc4c4c4c4, 0x19191919, 0x6d6d6d6d, 0xa1a1a1a1, 0xd5d5d5d5,
        0x2a2a2a2a, 0x7e7e7e7e, 0xb2b2b2b2, 0xe6e6e6e6, 0x3b3b3b3b, 0x8f8f8f8f, 0xc3c3c3c3, 0xf7f7f7f7,
        0x4c4c4c4c, 0x90909090, 0xd4d4d4d4, 0x18181818, 0x5c5c5c5c, 0xa0a0a0a0, 0xe4e4e4e4, 0x28282828,
        0x6c6c6c6c, 0xb0b0b0b0, 0xf4f4f4f4, 0x39393939, 0x7d7d7d7d, 0xc1c1c1c1, 0x05050505, 0x49494949,
        0x8d8d8d8d, 0xd1d1d1d1, 0x16161616, 0x5a5a5a5a, 0x9e9e9e9e, 0xe2e2e2e2, 0x27272727, 0x6b6b6b6b,
        0xafafafaf, 0xf3f3f3f3, 0x37373737, 0x7b7b7b7b, 0xbfbfbfbf, 0x03030303, 0x47474747, 0x8b8b8b8b,
        0xcfcfcfcf, 0x13131313, 0x57575757, 0x9b9b9b9b, 0xdfdfdfdf, 0x23232323, 0x67676767, 0xabababab,
        0xefefefef, 0x33333333, 0x77777777, 0xbbbbbbbb, 0xffffffff, 0x43434343, 0x87878787, 0xcbcbcbcb,
        0x0f0f0f0f, 0x53535353, 0x97979797, 0xdbdbdbdb, 0x1f1f1f1f, 0x63636363, 0xa7a7a7a7, 0xebebebeb,
        0x2f2f2f2f, 0x73737373, 0xb7b7b7b7, 0xfbfbfbfb, 0x3f3f3f3f, 0x83838383, 0xc7c7c7c7, 0x0b0b0b0b,
        0x4f4f4f4f, 0x93939393, 0xd7d7d7d7, 0x1b1b1b1b, 0x5f5f5f5f, 0xa3a3a3a3, 0xe7e7e7e7, 0x2b2b2b2b,
        0x6f6f6f6f, 0xb3b3b3b3, 0xf7f7f7f7, 0x3b3b3b3b, 0x7f7f7f7f, 0xc3c3c3c3, 0x07070707, 0x4b4b4b4b,
        0x8f8f8f8f, 0xd3d3d3d3, 0x17171717, 0x5b5b5b5b, 0x9f9f9f9f, 0xe3e3e3e3, 0x27272727, 0x6b6b6b6b,
        0xafafafaf, 0xf3f3f3f3, 0x37373737, 0x7b7b7b7b, 0xbfbfbfbf, 0x03030303, 0x47474747, 0x8b8b8b8b,
        0xcfcfcfcf, 0x13131313, 0x57575757, 0x9b9b9b9b, 0xdfdfdfdf, 0x23232323, 0x67676767, 0xabababab,
        0xefefefef, 0x33333333, 0x77777777, 0xbbbbbbbb, 0xffffffff, 0x43434343, 0x87878787, 0xcbcbcbcb,
        0x0f0f0f0f, 0x53535353, 0x97979797, 0xdbdbdbdb, 0x1f1f1f1f, 0x63636363, 0xa7a7a7a7, 0xebebebeb,
    ]
    + [0] * 64,
    np.uint32,
)
# fmt: on
_KIND = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int32()), ("hash", pa.string()), ("level", pa.int32()), ("bytes", pa.binary())]))
SCHEMA = "array<struct<pos:bigint,len:int,hash:string,level:int,bytes:binary>>"


def window_hash(data: bytes) -> np.ndarray:
    """For each byte the low 9 bits of the rolling hash: only the last 9 bytes reach them, so all places are computed at once."""
    g = GEAR[np.frombuffer(data, np.uint8)] & np.uint32(0x1FF)
    h = g.copy()
    for k in range(1, 9):
        h[k:] ^= g[:-k] << np.uint32(k)
    return h & np.uint32(0x1FF)


def cuts(data: bytes) -> list[tuple[int, int, int]]:
    """(pos, len, level). A chunk ends at the first place where the hash has no bit of the mask: 9 bits below 512 bytes, 8 up to 768,
    7 beyond, never below 256, always at 1024. An unfinished last chunk has level 2, all others level 0."""
    h = window_hash(data)
    stops = [np.flatnonzero((h & np.uint32(m)) == 0).tolist() for m in (0x1FF, 0xFF, 0x7F)]
    out, pos, n = [], 0, len(data)
    while pos < n:
        end = None
        for at, lo, hi in zip(stops, (LEAST, MIDDLE, LATE + 1), (MIDDLE - 1, LATE, MOST - 1), strict=True):
            k = bisect_left(at, pos + lo - 1)
            if k < len(at) and at[k] <= pos + hi - 1:
                end = at[k] + 1
                break
        if end is None and pos + MOST <= n:
            end = pos + MOST
        out.append((pos, (end or n) - pos, 0 if end else 2))
        pos = end or n
    return out


def chunks(content: Column) -> Column:
    """Array of (pos, len, hash, level, bytes) in order; null content gives null, empty content an empty array."""

    def run(batch):
        out = []
        for data in batch.to_pylist():
            if data is None:
                out.append(None)
                continue
            found = cuts(data)
            parts = [data[p : p + n] for p, n, _ in found]
            out.append([{"pos": p, "len": n, "hash": f"{x:016x}", "level": v, "bytes": b} for (p, n, v), x, b in zip(found, word_fnv_many(parts).tolist(), parts, strict=True)])
        return pa.array(out, _KIND)

    return F.arrow_udf(run, SCHEMA)(content)


def chunk_rows(files: DataFrame, content: str = "content", with_bytes: bool = False) -> DataFrame:
    """``files`` without its content, one row a chunk."""
    rest = [c for c in files.columns if c != content]
    kept = ["pos", "len", "hash", "level", *(["bytes"] if with_bytes else [])]
    return files.select(*rest, F.explode(chunks(F.col(content))).alias("c")).select(*rest, *(F.col(f"c.{k}").alias(k) for k in kept))


def chunk_index(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Last position of each hash (the last wins) and the number of copies."""
    return rows.groupBy(*(by or []), "hash").agg(F.max("pos").alias("last_pos"), F.count("*").alias("copies"))
