"""Digests of folders and comparison of two folder versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetflow.functions import digests
from octetflow.operators.folds import fnv_in_order

STATUSES = ["only_in_first", "only_in_second", "modified", "identical"]


def listing(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, relative_path, hash, size): the FNV digest of every file."""
    return files.select(*(by or []), "relative_path", digests.fnv(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def folder_digest(listed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, folder_hash, files, bytes): FNV over ``path:hash:size;`` of all files in bytewise order of their paths, by ``fnv_in_order``, so a folder of any
    size is spread over tasks. Null paths and sizes go; without ``by``, no files give the digest of nothing."""
    by = by or []
    line = F.concat(F.concat_ws(":", "relative_path", "hash", F.col("size").cast("string")), F.lit(";"))
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    rows = listed.filter("relative_path is not null and size is not null")
    rows = rows.select(key.alias("g"), F.concat("relative_path", F.lit("\0"), line).alias("at"), F.encode(line, "utf-8").alias("data"), F.col("size").cast("long").alias("size"))
    done = fnv_in_order(rows).select("g", F.col("fnv").alias("folder_hash"), F.col("n").alias("files"), F.col("size").alias("bytes"))
    if by:
        return done.select(F.from_json("g", listed.select(*by).schema).alias("k"), "folder_hash", "files", "bytes").select("k.*", "folder_hash", "files", "bytes")
    return done.groupBy().agg(F.coalesce(F.max("folder_hash"), F.lit(f"{digests.OFFSET:016x}")).alias("folder_hash"), F.coalesce(F.max("files"), F.lit(0)).alias("files"), F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"))


def compare(first: DataFrame, second: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, relative_path, status). Files are identical if digest and size agree."""
    keys = [*(by or []), "relative_path"]
    a = first.select(*keys, F.struct("hash", "size").alias("a"))
    b = second.select(*keys, F.struct("hash", "size").alias("b"))
    status = F.when(F.col("b").isNull(), "only_in_first").when(F.col("a").isNull(), "only_in_second").when(F.col("a") == F.col("b"), "identical").otherwise("modified")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def only_left(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return first.join(second.select(*keys), keys, "left_anti").select(*keys)


def only_right(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return only_left(second, first, keys)


def common(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return first.join(second.select(*keys), keys, "left_semi").select(*keys)


def summary(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, number of paths of each status, are_identical); the paths themselves are the rows of ``compared``. No files at all: identical."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    same = F.coalesce(F.bool_and(F.col("status") == "identical"), F.lit(True)).alias("are_identical")
    return compared.groupBy(*(by or [])).agg(*counts, same)


def same_folders(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """(by, are_identical) by the folders' digests; a folder that one side lacks differs."""
    a = folder_digest(first, by).select(*by, F.col("folder_hash").alias("a"))
    b = folder_digest(second, by).select(*by, F.col("folder_hash").alias("b"))
    return a.join(b, by, "full_outer").select(*by, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("are_identical"))


def report(listed: DataFrame, digest: DataFrame, name: str) -> DataFrame:
    """Lines of a folder's report, in order (n, value): write value as text."""
    head = digest.select(F.lit("").alias("p"), F.array(F.lit(f"Folder: {name}"), F.concat(F.lit("Hash: "), "folder_hash"), F.concat(F.lit("Total Files: "), F.col("files").cast("string")), F.lit("")).alias("lines"))
    body = listed.select(F.col("relative_path").alias("p"), F.array(F.col("relative_path"), F.concat(F.lit("  Hash: "), "hash"), F.concat(F.lit("  Size: "), F.col("size").cast("string"), F.lit(" bytes")), F.lit("")).alias("lines"))
    # outer, as there are always lines: else Spark adds a filter that they are some, and with it a second digest of every file
    return head.unionByName(body).select("p", F.posexplode_outer("lines").alias("n", "value")).orderBy("p", "n").select("value")
