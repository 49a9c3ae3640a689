"""Compression by level, detection by magic bytes, and strict decompression."""

from __future__ import annotations

import io
import lzma

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a level means to each codec (dictionaries in MiB), the formats' first bytes and names.
LZ4_LEVELS = {1: 1, 2: 3, 3: 6, 4: 4, 5: 7, 6: 9}
XZ_DICT = {16: 64, 17: 128, 18: 128, 19: 256, 20: 128, 21: 256}
XZ_DEPTH = {16: 512, 17: 512, 18: 1000, 19: 1000, 20: 2000, 21: 2000}
MAGIC = [(b"\x04\x22\x4d\x18", "LZ4 Frame"), (b"\x28\xb5\x2f\xfd", "ZSTD"), (b"\xfd7zXZ\x00", "LZMA2/XZ")]
UNKNOWN = "Unknown"


def algorithm(level: int) -> str:
    """Name of the codec that a level stands for."""
    if not 1 <= level <= 21:
        raise ValueError("levels are 1 to 21")
    return "LZ4 Frame" if level <= 6 else "ZSTD" if level <= 15 else "LZMA2/XZ"


def compress(data: bytes, level: int) -> bytes:
    """Levels 1-6: LZ4 frame; 7-15: zstd (level + 5, at most 19); 16-21: xz. Empty input is an error."""
    name = algorithm(level)
    if not data:
        raise ValueError("there is nothing to compress")
    if name == "LZ4 Frame":
        return pa.Codec("lz4", compression_level=LZ4_LEVELS[level]).compress(data, asbytes=True)
    if name == "ZSTD":
        return zstandard.ZstdCompressor(level=min(19, level + 5)).compress(data)
    size = min(XZ_DICT[level] << 20, max(4096, 1 << (len(data) - 1).bit_length()))  # a dictionary beyond the input only costs memory
    chain = [{"id": lzma.FILTER_X86}] * (level >= 20) + [{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": size, "lc": 4, "lp": 0, "pb": 2, "mode": lzma.MODE_NORMAL, "nice_len": 273, "mf": lzma.MF_BT4, "depth": XZ_DEPTH[level]}]
    return lzma.compress(data, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC64, filters=chain)


def detect(data: bytes) -> str:
    return next((name for magic, name in MAGIC if data.startswith(magic)), UNKNOWN)


def decompress(data: bytes) -> bytes:
    """By magic bytes. Of LZ4 the first frame; zstd and xz frames one after another. Unknown formats, empty results and truncated streams fail."""
    name = detect(data)
    if name == "LZ4 Frame":
        out = pa.CompressedInputStream(io.BytesIO(data), "lz4").read()
    elif name == "ZSTD":
        parts, rest = [], data
        while rest:
            d = zstandard.ZstdDecompressor().decompressobj()
            parts.append(d.decompress(rest))
            if not d.eof:
                raise ValueError("the zstd stream is truncated")
            rest = d.unused_data
        out = b"".join(parts)
    elif name == "LZMA2/XZ":
        out = lzma.decompress(data, format=lzma.FORMAT_XZ)
    else:
        raise ValueError("the format is unknown")
    if not out:
        raise ValueError("the stream holds nothing")
    return out


def detected(content: Column) -> Column:
    """``detect`` as a built-in expression."""
    out = F.lit(UNKNOWN)
    for magic, name in reversed(MAGIC):
        out = F.when(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit(name)).otherwise(out)
    return out


def compressed(content: Column, level: int) -> Column:
    return F.arrow_udf(lambda x: pa.array([None if v is None else compress(v, level) for v in x.to_pylist()], pa.binary()), "binary")(content)


def decompressed(content: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([None if v is None else decompress(v) for v in x.to_pylist()], pa.binary()), "binary")(content)


def is_compressed(content: Column) -> Column:
    return detected(content) != UNKNOWN
