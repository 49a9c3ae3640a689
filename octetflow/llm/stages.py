"""Stages from raw documents to token ids. Each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Decisions are made on ids and small columns; the texts of a stage then pass one semi-join on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from octetflow.llm.bpe import bpe_digests
from octetflow.llm.common import Scratch, table
from octetflow.llm.exact import exact_dedup
from octetflow.llm.mixing import mix
from octetflow.llm.quality import classify
from octetflow.llm.similar import similar_groups
from octetflow.plans.scratch import scope


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Documents with a null id can't be named by later stages and go here."""
    return _keep(docs, classify(docs, table(spark, sf_dir, "labels")).filter("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the largest doc_id stays. Rows repeated under one id stay together."""
    return _keep(docs, exact_dedup(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more of five-word shingles the smallest doc_id stays. SimHash groups are candidates; those links that they miss are searched for exactly."""
    return _keep(docs, similar_groups(docs).filter("doc_id = component_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of nine tenths of the tokens, raked to tempered source, language and topic shares."""
    return _keep(docs, mix(docs).filter("sampled"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe_digests(docs, with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with scope(spark):  # what a stage writes on its way goes when its result is written
            docs = results.write(stage(spark, before, sf_dir))
        results.drop(before)
    return docs
