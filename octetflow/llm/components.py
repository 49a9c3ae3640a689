"""Connected components by alternating large-star and small-star, on tables alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, lookup


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) with the smallest node of their component, without the roots themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _contract(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = local_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _print(df: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``edges``: two long columns a, b. Returns (node, root) for every node of an edge, root included, root being the smallest
    node reachable. Batches are contracted first; after that each round takes minima by partial aggregation
    and hands them out with ``lookup``, so that no node's neighbours meet in one task. Loops and repeated edges are harmless;
    rows with a null end are ignored."""
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    now = scratch.write(pairs.mapInArrow(_contract, "a long, b long").distinct())  # a > b
    seen = _print(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = scratch.write(lookup(both, low, "u", "n", 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        joined = lookup(large, down, "u", "n", large.count())
        small = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select("u", "m"))
        new = scratch.write(small.filter("a <> b").distinct())
        scratch.drop(low, large, down, now)
        now, before = new, seen
        seen = _print(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
