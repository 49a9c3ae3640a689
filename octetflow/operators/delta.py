"""Differences between two versions of files as copies and inserts, and their application."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octetflow.functions.digests import word_fnv_many
from octetflow.operators.chunking import chunk_rows, cuts

# First byte of a patch, its commands and their layouts.
MARK, COPY, INSERT = 0xFF, 0, 1
_HEAD, _COPY, _INSERT = "<BQ", "<BQI", "<BI"


def diff_ops(source: DataFrame, target: DataFrame, key: str = "path") -> DataFrame:
    """(key, seq, op, src_pos, dst_pos, len): ``source`` and ``target`` have (key, content), one row a file.

    A chunk of the target is copied if the last chunk of the source with its hash has its bytes; what lies between copies is inserted. Adjacent copies stay apart. One join brings
    the two versions of a file together, and all else happens where they are."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("src_pos", pa.int64()), ("dst_pos", pa.int64()), ("len", pa.int64())]))

    def run(old, new):
        found = file_ops([(a or b"", b or b"") for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)])
        return pa.array([[dict(zip(("op", "src_pos", "dst_pos", "len"), o, strict=True)) for o in ops] for ops in found], kind)

    made = F.arrow_udf(run, "array<struct<op:string,src_pos:bigint,dst_pos:bigint,len:bigint>>")
    rows = _versions(source, target, key).select(key, F.posexplode(made("old", "content")).alias("seq", "o"))
    return rows.select(key, F.col("seq").cast("long").alias("seq"), "o.*")


def _versions(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, content, old)"""
    return target.select(key, "content").join(source.select(key, F.col("content").alias("old")), key, "left")


def diff_by_join(source: DataFrame, target: DataFrame, key: str = "path") -> DataFrame:
    """The rows of ``diff_ops`` by a join of chunks: three shuffles more, for sources and targets that one task should not hold together."""
    index = chunk_rows(source.select(key, "content"), with_bytes=True).groupBy(key, "hash").agg(F.max(F.struct("pos", "bytes")).alias("s"))
    parts = chunk_rows(target.select(key, "content"), with_bytes=True).select(key, "pos", "len", "hash", "bytes")
    same = F.substring(F.col("s.bytes"), F.lit(1), F.col("len")) == F.col("bytes")
    copies = parts.join(index, [key, "hash"]).filter(same).select(key, "pos", F.col("len").cast("long").alias("len"), F.col("s.pos").alias("src_pos"))
    ends = target.select(key, F.octet_length("content").cast("long").alias("pos"), F.lit(0).cast("long").alias("len"), F.lit(None).cast("long").alias("src_pos"))
    by_place = Window.partitionBy(key).orderBy("pos", F.col("src_pos").isNull())
    placed = copies.unionByName(ends).withColumn("from", F.coalesce(F.lag(F.col("pos") + F.col("len")).over(by_place), F.lit(0)))
    insert = F.when(F.col("pos") > F.col("from"), F.struct(F.lit("INSERT").alias("op"), F.lit(None).cast("long").alias("src_pos"), F.col("from").alias("dst_pos"), (F.col("pos") - F.col("from")).alias("len")))
    copy = F.when(F.col("src_pos").isNotNull(), F.struct(F.lit("COPY").alias("op"), "src_pos", F.col("pos").alias("dst_pos"), "len"))
    ops = placed.select(key, F.explode(F.array_compact(F.array(insert, copy))).alias("o")).select(key, "o.*")
    return ops.withColumn("seq", (F.row_number().over(Window.partitionBy(key).orderBy("dst_pos")) - 1).cast("long")).select(key, "seq", "op", "src_pos", "dst_pos", "len")


def patch_sizes(ops: DataFrame, target: DataFrame, key: str = "path") -> DataFrame:
    """(key, patch_bytes): 9 bytes, 13 a copy, 5 and the bytes an insert."""
    cost = F.sum(F.when(F.col("op") == "COPY", 13).otherwise(5 + F.col("len")))
    return target.select(key).join(ops.groupBy(key).agg(cost.alias("c")), key, "left").select(key, (9 + F.coalesce("c", F.lit(0))).alias("patch_bytes"))


def write_patch(data: bytes, ops: list[tuple[str, int | None, int, int]]) -> bytes:
    """``ops``: (op, src_pos, dst_pos, len) in order; inserts take their bytes from ``data``, the target."""
    out = [struct.pack(_HEAD, MARK, len(data))]
    for op, src, dst, n in ops:
        if n >= 2**32:
            raise ValueError("a command holds less than 4 GiB")
        out += [struct.pack(_COPY, COPY, src, n)] if op == "COPY" else [struct.pack(_INSERT, INSERT, n), data[dst : dst + n]]
    return b"".join(out)


def read_patch(patch: bytes) -> tuple[int, list[tuple[str, int | None, int, int, bytes | None]]]:
    """(size of the target, commands (op, src_pos, dst_pos, len, bytes))."""
    if len(patch) < struct.calcsize(_HEAD) or patch[0] != MARK:
        raise ValueError("this is no patch")
    size, at, dst, out = struct.unpack_from(_HEAD, patch)[1], struct.calcsize(_HEAD), 0, []
    try:
        while at < len(patch):
            if patch[at] == COPY:
                _, src, n = struct.unpack_from(_COPY, patch, at)
                at += struct.calcsize(_COPY)
                out.append(("COPY", src, dst, n, None))
            elif patch[at] == INSERT:
                n = struct.unpack_from(_INSERT, patch, at)[1]
                at += struct.calcsize(_INSERT)
                if at + n > len(patch):
                    raise ValueError("the patch is cut short")
                out.append(("INSERT", None, dst, n, patch[at : at + n]))
                at += n
            else:
                raise ValueError("the patch holds an unknown command")
            dst += n
    except struct.error:
        raise ValueError("the patch is cut short") from None
    return size, out


def apply_patch(source: bytes, patch: bytes) -> bytes:
    size, ops = read_patch(patch)
    out = []
    for op, src, _, n, data in ops:
        part = source[src : src + n] if op == "COPY" else data
        if len(part) != n:
            raise ValueError("a copy passes the source's end")
        out.append(part)
    whole = b"".join(out)
    if len(whole) != size:
        raise ValueError("the result has not the size that the patch names")
    return whole


def file_ops(pairs: list[tuple[bytes, bytes]]) -> list[list[tuple[str, int | None, int, int]]]:
    """For each (source, target) the commands (op, src_pos, dst_pos, len), as ``diff_ops`` finds them; chunks of all files are hashed at once."""
    found = [(cuts(a), cuts(b)) for a, b in pairs]
    hashes = iter(word_fnv_many([data[p : p + n] for pair, both in zip(pairs, found, strict=True) for data, parts in zip(pair, both, strict=True) for p, n, _ in parts]).tolist())
    out = []
    for (src, dst), (old, new) in zip(pairs, found, strict=True):
        last = {next(hashes): p for p, _, _ in old}
        ops, done = [], 0
        for p, n, _ in new:
            at = last.get(next(hashes))
            if at is not None and src[at : at + n] == dst[p : p + n]:
                if p > done:
                    ops.append(("INSERT", None, done, p - done))
                ops.append(("COPY", at, p, n))
                done = p + n
        out.append(ops + ([("INSERT", None, done, len(dst) - done)] if len(dst) > done else []))
    return out


def make_patches(source: DataFrame, target: DataFrame, key: str = "path") -> DataFrame:
    """(key, patch, dst_sha256): a patch for each file of the target; files that the source lacks are inserted whole. One join brings the two versions of a file together, and
    all else happens where they are."""

    def run(old, new):
        pairs = [(a or b"", b) for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)]
        return pa.array([write_patch(b, ops) for (_, b), ops in zip(pairs, file_ops(pairs), strict=True)], pa.binary())

    return _versions(source, target, key).select(key, F.arrow_udf(run, "binary")("old", "content").alias("patch"), F.sha2("content", 256).alias("dst_sha256"))


def apply_patches(source: DataFrame, patches: DataFrame, key: str = "path") -> DataFrame:
    """(key, content). A patch without a source starts from nothing."""

    def run(content, patch):
        return pa.array([apply_patch(c or b"", p) for c, p in zip(content.to_pylist(), patch.to_pylist(), strict=True)], pa.binary())

    joined = patches.select(key, "patch").join(source.select(key, "content"), key, "left")
    return joined.select(key, F.arrow_udf(run, "binary")("content", "patch").alias("content"))


def patch_rows(patches: DataFrame, key: str = "path") -> DataFrame:
    """(key, seq, op, src_pos, dst_pos, len, payload) of stored patches."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("src_pos", pa.int64()), ("dst_pos", pa.int64()), ("len", pa.int64()), ("payload", pa.binary())]))

    def run(patch):
        return pa.array([[dict(zip(("op", "src_pos", "dst_pos", "len", "payload"), o, strict=True)) for o in read_patch(p)[1]] for p in patch.to_pylist()], kind)

    ops = F.arrow_udf(run, "array<struct<op:string,src_pos:bigint,dst_pos:bigint,len:bigint,payload:binary>>")("patch")
    return patches.select(key, F.posexplode(ops).alias("seq", "o")).select(key, "seq", "o.*")
