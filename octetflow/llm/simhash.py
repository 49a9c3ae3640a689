"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, lookup, table
from octetflow.llm.components import connected_components, local_roots

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: First bits by which fingerprints are counted, and variants that a task makes and sorts at a time.
PREFIX, VARIANTS = 16, 4_000_000
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included, A-Z lower-cased. Fewer words than a shingle: one of them all; none: nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; white space is \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[x:y], seed) for x, y in zip(starts[:n].tolist(), last[:n].tolist(), strict=True)), np.uint64, n)


def fold_hashes(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes. Of none: 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's shingles. Null and wordless texts: 0."""
    return fold_hashes(shingle_hashes(text, shingle, seed))


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return run


def ball(bits: int, radius: int) -> np.ndarray:
    """All flips of ``radius`` or fewer of the ``bits`` lowest bits, as words to XOR with."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.uint64)


def ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def prefix_leaves(counts: np.ndarray, half: int, most: int) -> list[tuple[int, int]]:
    """Prefixes (length, value) that cut the space of variants so that about ``most`` of them fall to each: full prefixes are cut further, up to the length that ``counts``
    (fingerprints by their first bits) knows. Prefixes that no variant reaches are left out."""
    depth = len(counts).bit_length() - 1
    leaves, open_ = [], np.zeros(1, np.int64)
    for length in range(depth + 1):
        if not len(open_):
            break
        own = counts.reshape(1 << length, -1).sum(1).astype(np.float64)
        at = np.arange(1 << length)
        table = [own] + [np.zeros_like(own) for _ in range(half)]
        for bit in range(length):  # table[k]: fingerprints whose prefix is k flips away
            for k in range(half, 0, -1):
                table[k] = table[k] + table[k - 1][at ^ (1 << bit)]
        load = sum(table[k] * ball_size(BITS - length, half - k) for k in range(half + 1))[open_]
        done = (load <= most) | (length == depth)
        leaves += [(length, int(v)) for v in open_[done & (load > 0)]]
        open_ = (open_[~done][:, None] * 2 + np.arange(2)).ravel()
    return leaves


def _deal(leaves: list[tuple[int, int]], half: int):
    """Fingerprints to (leaf, fp), for each prefix that one of their variants has."""
    plan = []
    for length in sorted({n for n, _ in leaves}):
        number = np.full(1 << length, -1, np.int32)
        for k, (n, v) in enumerate(leaves):
            if n == length:
                number[v] = k
        plan.append((length, number, ball(length, half)))

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for length, number, flips in plan:
                prefix = fp >> np.uint64(BITS - length) if length else np.zeros_like(fp)
                leaf = number[(prefix[:, None] ^ flips[None, :]).astype(np.int64)]
                row, which = np.nonzero(leaf >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[row, which]), pa.array(fp[row].view(np.int64))], ["leaf", "fp"])

    return run


def _variant_links(fp: np.ndarray, away: np.ndarray, length: int, half: int, most: int, balls: dict):
    """Links (a, b), as forests, of fingerprints that share a variant with a given prefix of ``length`` bits; ``away``: flips that each
    has spent on the prefix. More than ``most`` variants are taken prefix by longer prefix."""
    bits = BITS - length
    if len(fp) < 2:
        return
    spent = np.bincount(away, minlength=half + 1)
    if bits and sum(int(c) * ball_size(bits, half - k) for k, c in enumerate(spent)) > most:
        bit = (fp >> np.uint64(bits - 1) & np.uint64(1)).astype(np.int64)
        for child in (0, 1):
            more = away + (bit != child)
            stay = more <= half
            yield from _variant_links(fp[stay], more[stay], length + 1, half, most, balls)
        return
    low = fp & np.uint64(2**bits - 1)
    keys, owners = [], []
    for k in np.flatnonzero(spent).tolist():
        if (bits, half - k) not in balls:
            balls[bits, half - k] = ball(bits, half - k)
        flips, own = balls[bits, half - k], np.flatnonzero(away == k)
        keys.append((low[own][:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(own, len(flips)))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    ordered = np.sort(key)
    shared = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(shared):
        return
    shared = shared[np.r_[True, shared[1:] != shared[:-1]]]
    at = np.searchsorted(shared, key)
    at[at == len(shared)] = 0
    hit = np.flatnonzero(shared[at] == key)
    hit = hit[np.argsort(key[hit], kind="stable")]
    same = np.flatnonzero(key[hit[1:]] == key[hit[:-1]])
    yield local_roots(fp[owner[hit[same]]].view(np.int64), fp[owner[hit[same + 1]]].view(np.int64))


def _meet(leaves: list[tuple[int, int]], half: int, most: int):
    """Rows (leaf, fp) sorted by leaf to links (a, b)."""

    def links(leaf: int, fp: np.ndarray, balls: dict):
        length, value = leaves[leaf]
        fp = fp.view(np.uint64)
        prefix = fp >> np.uint64(BITS - length) if length else np.zeros_like(fp)
        away = np.bitwise_count(prefix ^ np.uint64(value)).astype(np.int64)
        for u, v in _variant_links(fp, away, length, half, most, balls):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])

    def run(batches):
        wait, now, balls = [], -1, {}
        for batch in batches:
            leaf, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf)] if len(leaf) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if leaf[lo] != now:
                    if wait:
                        yield from links(now, np.concatenate(wait), balls)
                    wait, now = [], int(leaf[lo])
                wait.append(fp[lo:hi])
        if wait:
            yield from links(now, np.concatenate(wait), balls)

    return run


def near_pairs(fps: DataFrame, radius: int = RADIUS, most: int = VARIANTS) -> DataFrame:
    """Distinct fingerprints (fp long) to pairs (a, b) whose transitive closure is that of all pairs at ``radius`` or fewer bits.

    Two fingerprints at radius r or less share a variant within r/2 of both, and two that share one are at r or less. So each emits its ball of all
    variants within r/2 (2,081 for r = 4), and a chain through the sharers of each variant is exact, whatever their number; no pairs are compared.
    The variants meet by prefix: a fingerprint is sent once to each prefix that its ball reaches, and its variants with that prefix are made, sorted and
    collided there, ``most`` at a time. Prefixes are as long as their number of variants asks for (known from counts by the first
    ``PREFIX`` bits, a table of fixed size), so a crowded corner of the space is cut into more tasks."""
    if radius % 2:
        raise ValueError(f"radius {radius}: balls of half the radius hold every pair only for even ones")
    half, fps = radius // 2, fps.select("fp")
    seen = fps.groupBy(F.shiftrightunsigned("fp", BITS - PREFIX).alias("prefix")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << PREFIX, np.int64)
    counts[seen.column("prefix").to_numpy()] = seen.column("n").to_numpy()
    leaves = prefix_leaves(counts, half, most)
    tasks = max(1, min(len(leaves), 16 * int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = fps.mapInArrow(_deal(leaves, half), "leaf int, fp long").repartition(tasks, "leaf").sortWithinPartitions("leaf")
    return dealt.mapInArrow(_meet(leaves, half, most), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, most: int = VARIANTS) -> DataFrame:
    """One row a row of ``docs``: id_col, fingerprint (16 hex digits), component_id, group_size (rows of the component).

    Null and wordless texts have fingerprint zero and are linked like others. component_id is the smallest id reachable.
    Rows with a null id get a fingerprint but link nothing; their component_id and group_size are null. A repeated id
    keeps its rows. Other columns are ignored, whatever their names. Empty in, empty out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "id long, fp long"))
    named = rows.filter("id is not null")
    kinds = scratch.write(named.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    links = connected_components(near_pairs(kinds, radius, most), scratch)
    links = scratch.write(links.join(kinds, links["node"] == kinds["fp"]).select("fp", "root", "low", "n"))
    by_root = links.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("kinds"))
    by_root = scratch.write(by_root)
    linked = lookup(links.select("fp", "root", "n"), by_root, "root", "kinds", links.count()).select("fp", "component_id", "group_size", "n")
    alone = kinds.join(links.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), F.col("n").alias("group_size"), "n")
    groups = scratch.write(linked.unionByName(alone))
    scratch.drop(kinds, links, by_root)
    out = lookup(named, groups, "fp", "n", named.count()).select("id", "fp", "component_id", "group_size")
    nobody = rows.filter("id is null").select("id", "fp", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("group_size"))
    return out.union(nobody).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
