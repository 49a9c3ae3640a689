"""Files as rows of blocks (path, block_no, bytes), for files too large for one value: work within a file is spread over tasks.

All blocks of a file but the last have the same size. An empty file has one empty block."""

from __future__ import annotations

import hashlib
import hmac
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from octetflow.functions import chacha, gf256
from octetflow.functions.batches import lengths, stretches
from octetflow.functions.digests import key_bytes, mac_key
from octetflow.operators.folds import fnv_in_order
from octetflow.operators.shares import payloads


def cut(files: DataFrame, size: int = chacha.BATCH, path: str = "path", content: str = "content") -> DataFrame:
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(content) / F.lit(size))).cast("long")
    numbered = files.select(F.col(path).alias("path"), F.col(content).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block_no"))
    return numbered.select("path", "block_no", F.expr(f"substring(c, cast(block_no * {size} + 1 as int), {size})").alias("bytes"))


def placed(blocks: DataFrame, size: int = chacha.BATCH) -> DataFrame:
    """(path, offset, piece), as the archive sink writes them: one file of any size from all tasks."""
    return blocks.select("path", (F.col("block_no") * size).alias("offset"), F.col("bytes").alias("piece"))


def fnv(blocks: DataFrame) -> DataFrame:
    """(path, fnv, blocks, size): FNV-1a of whole files."""
    rows = blocks.select(F.col("path").alias("g"), F.lpad(F.hex("block_no"), 16, "0").alias("at"), F.col("bytes").alias("data"), F.octet_length("bytes").cast("long").alias("size"))
    return fnv_in_order(rows).select(F.col("g").alias("path"), "fnv", F.col("n").alias("blocks"), "size")


def _running(batches):
    """(path, block_no, bytes), sorted by path and number, to a row of digests a file. A file of which a block is missing is an error."""
    now, state, after = None, None, 0
    for batch in batches:
        done = []
        for path, no, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if path != now:
                if now is not None:
                    done.append((now, *_digests(state)))
                now, state, after = path, [hashlib.sha256(), 0, xxhash.xxh3_64(), 0], 0
            if no != after:
                raise ValueError(f"{path}: block {after} is missing or repeated")
            raw, after = data.as_buffer(), no + 1
            state[0].update(raw)
            state[1] = zlib.crc32(raw, state[1])
            state[2].update(raw)
            state[3] += len(raw)
        yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(now, *_digests(state))])


def _digests(state: list) -> tuple:
    return state[0].hexdigest(), f"{state[1]:X}", f"{state[2].intdigest():X}", state[3]


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "sha", "crc", "xxh", "size"])


def digests(blocks: DataFrame) -> DataFrame:
    """(path, sha, crc, xxh, size): SHA-256, CRC-32 and XXH3-64 of whole files of any size, as ``functions.digests`` writes them. These are folds one block after
    another by their nature: a file is read by one task, which holds a block at a time. (FNV-1a has a spread form, ``fnv``.)"""
    rows = blocks.select("path", "block_no", "bytes").repartition("path").sortWithinPartitions("path", "block_no")
    return rows.mapInArrow(_running, "path string, sha string, crc string, xxh string, size long")


def cipher(blocks: DataFrame, key: str | bytes) -> DataFrame:
    """The cipher of stored images; blocks of 1 MiB, each with its number as nonce. Its own inverse."""
    secret = key_bytes(key)

    def run(no, data):
        return pa.array(chacha.chacha20_many(secret, [n.to_bytes(8, "little") + bytes(4) for n in no.to_pylist()], data.to_pylist()), pa.binary())

    return blocks.withColumn("bytes", F.arrow_udf(run, "binary")("block_no", "bytes"))


def disperse(blocks: DataFrame, n: int, k: int, key: bytes, nonce: bytes, size: int) -> DataFrame:
    """(path, share_id, block_no, bytes): payloads of n shares, block by block. ``size`` is a multiple of 64 k, so that blocks begin at whole counters of the cipher and at whole groups of k bytes."""
    if size % (64 * k):
        raise ValueError("blocks must hold a multiple of 64 k bytes")

    def run(batches):
        for batch in batches:
            paths, no, data = batch.columns
            for lo, hi in stretches(lengths(data) * n // k + n * 512):
                items, at = data.slice(lo, hi - lo).to_pylist(), pa.array(np.repeat(np.arange(lo, hi), n))
                made = payloads(items, n, k, key, [nonce] * len(items), [b * size // 64 for b in no.slice(lo, hi - lo).to_pylist()])
                ids = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), hi - lo))
                yield pa.RecordBatch.from_arrays([paths.take(at), ids, no.take(at), pa.array([p for parts in made for p in parts], pa.binary())], ["path", "share_id", "block_no", "bytes"])

    rows = blocks.select("path", "block_no", "bytes")
    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("share_id", IntegerType()), *rows.schema[1:]]))


def restore(parts: DataFrame, k: int, key: bytes, nonce: bytes, size: int, orig_size: int) -> DataFrame:
    """(path, block_no, bytes) from the blocks of k shares. ``orig_size``: bytes of the file, to which the last block is trimmed."""

    def run(no, groups):
        out = []
        for b, g in zip(no.to_pylist(), groups.to_pylist(), strict=True):
            g = sorted(g, key=lambda s: s["share_id"])[:k]
            if len(g) < k or len({s["share_id"] for s in g}) < k or len({len(s["bytes"]) for s in g}) != 1:
                raise ValueError(f"block {b} lacks shares")
            stacked = np.array([np.frombuffer(s["bytes"], np.uint8) for s in g])
            plain = gf256.product(gf256.inverse(gf256.powers([s["share_id"] for s in g], k)), stacked).T.tobytes()
            out.append(chacha.xchacha20(key, nonce, plain, b * size // 64)[: max(0, orig_size - b * size)])
        return pa.array(out, pa.binary())

    grouped = parts.groupBy("path", "block_no").agg(F.collect_list(F.struct("share_id", "bytes")).alias("g"))  # 255 shares at most
    return grouped.select("path", "block_no", F.arrow_udf(run, "binary")("block_no", "g").alias("bytes"))


def _mac(secret: bytes):
    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for path, share, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (path, share) != now:
                    if now is not None:
                        done.append((*now, state.digest()))
                    now, state = (path, share), hmac.new(secret, digestmod=hashlib.sha256)
                state.update(data)
            yield _macs(done)
        if now is not None:
            yield _macs([(*now, state.digest())])

    return run


def _macs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["path", "share_id", "hmac"])


def authenticate(parts: DataFrame, key: bytes) -> DataFrame:
    """(path, share_id, hmac) of the payloads. HMAC is one fold after another by its nature: a share is read by one task, block by block."""
    rows = parts.select("path", "share_id", "block_no", "bytes").repartition("path", "share_id").sortWithinPartitions("path", "share_id", "block_no")
    return rows.mapInArrow(_mac(mac_key(key)), "path string, share_id int, hmac binary")
