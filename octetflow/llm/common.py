"""Shared pieces of the operators: scratch tables, skew-safe lookups, sampling by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.plans.scratch import delete, folder

#: A key is heavy when it holds more than 1/HEAVY_SLOTS of the rows, so that at most HEAVY_SLOTS keys are.
HEAVY_SLOTS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder. Writing one cuts the lineage and survives lost executors. Operators drop them once read; those that
    a returned frame still reads go with the scope or the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, folder(spark, name)
        self.paths: dict[int, str] = {}
        self.n = 0

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            if path := self.paths.pop(id(df), None):
                delete(self.spark, path)


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, slots: int = HEAVY_SLOTS) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``weight`` the number of rows of ``left``
    with that key (``total``: their sum). Keys with at least 1/slots of the rows are at most ``slots`` (all of
    them if total < slots), so they are broadcast and their rows stay where they are; the others are joined by shuffle, where no
    key is large. Rows of ``left`` with a null key go."""
    keys = [key] if isinstance(key, str) else key
    hot = F.col(weight) * F.lit(slots) >= F.lit(total)
    for k in keys:
        hot = hot & F.col(k).isNotNull()
    heavy, light = right.filter(hot), right.filter(~hot)
    near = left.join(F.broadcast(heavy), keys)
    far = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return near.unionByName(far)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that to ASCII texts, and quickly; others go through translate."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key_of(*values: Column) -> Column:
    """One string for several values that no other values share, nulls included: each value's length stands before it."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts))


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) fixed by the key: the first 8 hex digits of an MD5 over 2**32."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
