"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, ascii_lower, delete, folder, lookup, table

COLUMNS = "digest binary, keep_id long, batch string, added timestamp"


class DigestIndex:
    """A table of the digests seen so far with the id of the document that stays and the batch that brought it, bucketed and sorted by digest.

    New data is deduplicated by a sort-merge anti-join, whose index side needs no shuffle, and what is new is appended.
    The table lies at ``location`` (the warehouse, unless given), which executors share; a later session opens it by the same name. One batch is added at a time.
    A batch whose adding failed at any point, or whose verdicts were lost, is added again: digests that carry its batch name are still its own."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, location: str | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):  # an in-memory catalogue forgets the table, not its files
            at = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
            spark.sql(f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'")
            self.location = at

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        at = getattr(self, "location", None)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if at:
            delete(self.spark, at)

    def _append(self, fresh: DataFrame) -> None:
        fresh.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Adds a batch and returns a row for each of its rows: id_col, keep_id, group_size (rows of the batch with that text), kept, text_sha256.

        Texts are equal when identical after lower-casing A-Z; null counts as empty. Of new texts the largest id stays; a text that another batch
        brought to the index keeps the id that it has there, and none of this batch. ``batch`` names the batch; by default the name is made from its ids and
        digests. Adding a batch of the same name again gives its first verdicts and appends only what is missing. Rows repeated under one id are one
        document and share the verdict. Null ids are never chosen while there are others; a new text with null ids only has a null
        keep_id and its rows are kept. Other columns are ignored; an empty batch returns nothing and adds nothing."""
        scratch = Scratch(self.spark, "exact")
        text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        rows = scratch.write(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))
        n, print_ = rows.agg(F.count("*"), F.sum(F.xxhash64("id", "digest").cast("decimal(38,0)"))).first()
        batch = batch or f"{n}:{print_ or 0}"
        kinds = scratch.write(rows.groupBy("digest").agg(F.max("id").alias("own"), F.count("*").alias("n")))
        index = self.table().select("digest", "keep_id", F.col("batch").eqNullSafe(F.lit(batch)).alias("new"))
        fresh = scratch.write(kinds.join(index.hint("merge"), "digest", "left_anti").select("digest", F.col("own").alias("keep_id"), F.lit(batch).alias("batch"), F.current_timestamp().alias("added")))
        found = kinds.join(index.hint("merge"), "digest").select("digest", "n", "keep_id", "new")
        new = kinds.join(fresh.select("digest"), "digest", "left_semi").select("digest", "n", F.col("own").alias("keep_id"), F.lit(True).alias("new"))
        verdicts = scratch.write(found.unionByName(new))
        self._append(fresh)
        scratch.drop(kinds, fresh)
        kept = F.col("new") & F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
        out = lookup(rows, verdicts, "digest", "n", n)
        return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DigestIndex.add`` of one batch to an index of its own in the scratch folder, which goes once the verdicts are written."""
    name = f"digests_{uuid.uuid4().hex}"
    index = DigestIndex(docs.sparkSession, name, location=folder(docs.sparkSession, name))
    try:
        return index.add(docs, id_col, text_col)
    finally:
        index.drop()


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
