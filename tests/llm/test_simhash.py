import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch
from octetflow.llm.components import connected_components
from octetflow.llm.simhash import VARIANTS, ball, fingerprint, near_pairs, prefix_leaves, simhash_groups

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 4]
    return roots([i for i, _ in fps], pairs)


def corpus():
    r = random.Random(5)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "dé", "eta", "x"]) for _ in range(r.randint(0, 300))) for _ in range(40)]
    texts = base + [t.replace("eta", "ETA", 1) for t in base[:10]] + [t + " end" for t in base[:20]] + base[:5] + [None, "", " \t\n", "one", "ONE", "a b c", "x " * 5000]
    return list(enumerate(texts))


def test_fingerprint_matches_definition():
    for _, t in corpus():
        assert fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("most", [VARIANTS, 20_000])
def test_groups_match_brute_force(spark, most):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in simhash_groups(df, most=most).collect()}
    assert len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == brute(rows)
    assert all(got[i].fingerprint == f"{slow_fingerprint(t):016x}" for i, t in rows)


@pytest.mark.parametrize("most", [VARIANTS, 5_000])
def test_no_link_is_lost_among_close_fingerprints(spark, most):
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(12):
        base = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(25):
            x = base
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = [x - 2**64 if x >= 2**63 else x for x in fps]
    pairs = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    scratch = Scratch(spark, "t")
    out = near_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), most=most)
    got = {r.node: r.root for r in connected_components(out, scratch).collect()}
    want = roots(fps, pairs)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in connected_components(df, Scratch(spark, "t")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == {k: v for k, v in roots(nodes, edges).items() if k in nodes}


def test_empty_nulls_and_repeats(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d", None, None), (7, "a b c d", None, None), (7, "a b c d", None, None), (3, "A B C D", None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(df).collect()), key=str)
    assert got == [(3, 3), (7, 3), (7, 3), (None, None)]
    assert simhash_groups(df).select(F.sum(F.col("group_size"))).first()[0] == 9


def test_odd_radii_are_refused(spark):
    with pytest.raises(ValueError, match="even"):
        near_pairs(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_prefixes_cut_the_space_of_variants_once():
    counts = np.bincount(np.r_[np.full(500, 77), np.arange(200) * 300], minlength=1 << 16)
    leaves = prefix_leaves(counts, 2, 100_000)
    spans = sorted((v << (16 - n), (v + 1) << (16 - n)) for n, v in leaves)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    reach = {p ^ f for p in np.flatnonzero(counts).tolist() for f in ball(16, 2).tolist()}
    assert all(any(lo <= v < hi for lo, hi in spans) for v in reach)
    assert max(n for n, _ in leaves) > min(n for n, _ in leaves)  # the crowded corner is cut finer
