"""Near-duplicate texts: all links at a Jaccard similarity of word shingles, with SimHash groups as the first of the candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, lookup
from octetflow.llm.components import connected_components, local_roots
from octetflow.llm.simhash import fold_hashes, near_pairs, shingle_hashes

SIMILARITY, SHINGLE = 0.8, 5
#: Counters of a text's signature, slots of the table of frequent shingles, and rows of a shingle in one cell; fuller shingles are cut into cells of two such parts.
COUNTERS, SLOTS, CELL = 64, 1 << 20, 512
#: Counters of a finer signature, by which pairs are sifted before sets travel: of long texts few counters say little.
FINE = 512
#: Shingles in a part of a cell of sets, and those that are looked up at a time.
ROOM, _CHUNK = 1 << 21, 1 << 20


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Different shingles of a text, as sorted 64-bit hashes. A-Z lower-cased; a text of fewer words has one shingle, a wordless one none."""
    return np.unique(shingle_hashes(text, shingle))


def _sketch(shingle: int):
    """(id, text) to what is kept of every text: SimHash, a 128-bit digest of its set, the set's size, and counters of the set by the hashes' first bits. At its end a task adds
    rows (slot, k) for the slots of shingles that it met far more often than others: a table of fixed size that tells frequent shingles from rare ones."""
    names = ["id", "fp", "digest", "node", "n", "sig", "fine", "slot", "k"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            fp, digest, n, sig, fine = [], [], [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                own = np.unique(h)
                np.add.at(seen, _slot(own), 1)
                fp.append(fold_hashes(h)), digest.append(xxhash.xxh3_128_digest(own.tobytes())), n.append(len(own))
                sig.append(_count(own, COUNTERS)), fine.append(_count(own, FINE))
            columns = [batch.column(0), np.array(fp, np.uint64).view(np.int64), digest, list(map(_node, digest)), n, sig, fine, [None] * len(n), [None] * len(n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)
        often = np.flatnonzero(seen > 4 * seen.mean() + 8)
        columns = [[None] * len(often)] * 7 + [often, seen[often]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def _count(own: np.ndarray, counters: int) -> bytes:
    at = (own >> np.uint64(64 - counters.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=counters), 255).astype(np.uint8).tobytes()


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 20)).astype(np.int64)


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _prefixes(shingle: int, similarity: float, rank: np.ndarray):
    """Texts to rows (token, node): the shingles of each that come first in an order common to all texts, rare ones first, as many
    as it takes for any two texts at the similarity to share one. Texts of equal sets are the same node."""

    def run(batches):
        for batch in batches:
            tokens, nodes = [], []
            for t in batch.column(0):
                own = shingle_set(t.as_py(), shingle)
                if len(own):
                    keep = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                    first = own[np.lexsort((own, rank[_slot(own)]))[:keep]]
                    tokens.append(first)
                    nodes.append(np.full(len(first), _node(xxhash.xxh3_128_digest(own.tobytes())), np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "sh"])

    return run


def _near_counters(sig: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (x, y) sizes and counters do not rule out. The counters' differences add up to no more than the sets' symmetric difference."""
    most = (1 - similarity) / (1 + similarity) * (n[x] + n[y]) + 1e-6
    ok = np.flatnonzero(np.abs(n[x] - n[y]) <= most)
    step = (1 << 22) // sig.shape[1]
    keep = [ok[lo : lo + step][np.abs(sig[x[ok[lo : lo + step]]] - sig[y[ok[lo : lo + step]]]).sum(1) <= most[ok[lo : lo + step]]] for lo in range(0, len(ok), step)]
    return np.concatenate(keep) if keep else ok


def _counters(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1).astype(np.int16)


def _sifted(similarity: float):
    """Pairs (a, b, na, nb, sa, sb) to those (a, b) that sizes and counters leave."""

    def run(batches):
        for batch in batches:
            if m := batch.num_rows:
                sig = np.concatenate([_counters(batch.column(4)), _counters(batch.column(5))])
                n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()]).astype(np.int64)
                keep = pa.array(_near_counters(sig, n, np.arange(m), np.arange(m) + m, similarity))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _whole(judge):
    """Rows sorted by (key, i, j) to what ``judge`` makes of tables of whole cells."""

    def run(batches):
        wait = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if wait is None else pa.concat_tables([wait, pa.Table.from_batches([batch])])
            keys = [table.column(c).to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on
            if cut:
                yield from judge(table.slice(0, cut))
            wait = table.slice(cut)
        if wait is not None:
            yield from judge(wait)

    return run


def _cells(table: pa.Table):
    key, i, j, part, ids, root = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "part", "id", "root"))
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    return start, np.diff(np.r_[start, len(key)]), i == j, part, ids, root


def _candidates(similarity: float):
    """Rows of cells to a forest over the texts in them: two texts of different roots that sizes and counters leave are in one tree."""

    def judge(table: pa.Table):
        start, size, alone, part, ids, root = _cells(table)
        n, sig = table.column("n").to_numpy().astype(np.int64), _counters(table.column("sig").combine_chunks())
        group, small = np.repeat(np.arange(len(size)), size), np.repeat(size <= 32, size)
        a, b = [], []

        def left(x, y):
            ok = (root[x] != root[y]) & (alone[x] | (part[x] != part[y]))
            x, y = x[ok], y[ok]
            keep = _near_counters(sig, n, x, y, similarity)
            return x[keep], y[keep]

        for shift in range(1, int(size[size <= 32].max(initial=1))):  # each row of a small cell with the one that is shift further on, all cells at once
            x = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:])
            x, y = left(x, x + shift)
            a.append(ids[x]), b.append(ids[y])
        for g in np.flatnonzero(size > 32).tolist():
            rows, tree = np.arange(start[g], start[g] + size[g]), np.arange(size[g])
            for lo in range(0, len(rows), 64):
                x, y = (m.ravel() for m in np.meshgrid(rows[lo : lo + 64], rows[lo:], indexing="ij"))
                new = (x < y) & (tree[x - start[g]] != tree[y - start[g]])
                x, y = left(x[new], y[new])
                u, v = local_roots(tree[x - start[g]], tree[y - start[g]])
                over = np.arange(size[g])
                over[u] = v
                tree = over[tree]
            a.append(ids[rows]), b.append(ids[rows[tree]])
        if a:
            yield _pairs(*local_roots(np.concatenate(a), np.concatenate(b)))

    return _whole(judge)


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of its elements each of the sets shares with ``own``; all are sorted."""
    out, lo = np.zeros(len(others), np.int64), 0
    ends = np.cumsum([len(s) for s in others])
    while len(own) and lo < len(others):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK, "right")))
        many = np.concatenate(others[lo:hi])
        seen = np.cumsum(np.r_[0, own[np.minimum(np.searchsorted(own, many), len(own) - 1)] == many])
        out[lo:hi] = np.diff(seen[np.r_[0, np.cumsum([len(s) for s in others[lo:hi]])]])
        lo = hi
    return out


def _links(similarity: float):
    """Rows of cells, with sets, to links (a, b) that connect all of a cell's texts that links connect, given that texts of one root are connected. What is
    connected already is not compared, so a group gives as many links as it takes to join it, however many pairs of it are similar."""

    def judge(table: pa.Table):
        start, size, alone, part, ids, root = _cells(table)
        column = table.column("sh").combine_chunks()
        n = column.value_lengths().to_numpy().astype(np.int64)
        sets = np.split(column.flatten().to_numpy().view(np.uint64), np.cumsum(n)[:-1])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, m in zip(start.tolist(), size.tolist(), strict=True):
            tree = np.unique(root[lo : lo + m], return_inverse=True)[1]
            sig = np.stack([np.frombuffer(_count(s, FINE), np.uint8) for s in sets[lo : lo + m]]).astype(np.int16)
            for x in range(m - 1):
                y = np.arange(x + 1, m)
                y = y[(tree[y] != tree[x]) & (alone[lo] | (part[lo + y] != part[lo + x]))]
                y = y[_near_counters(sig, n[lo : lo + m], np.full(len(y), x), y, similarity)]
                if len(y):
                    both = _overlaps(sets[lo + x], [sets[lo + k] for k in y.tolist()])
                    y = y[both >= similarity * (n[lo + x] + n[lo + y] - both) - 1e-9]
                    met, first = np.unique(tree[y], return_index=True)
                    a.append(np.full(len(met), ids[lo + x])), b.append(ids[lo + y[first]])
                    tree[np.isin(tree, met)] = tree[x]
        u, v = np.concatenate(a), np.concatenate(b)
        yield _pairs(np.minimum(u, v), np.maximum(u, v))

    return _whole(judge)


def _dealt(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (key, id, ...) to cells (key, i, j), sorted; any two rows of a key meet in one. ``counts``: for each key its rows k and over how many parts they are spread."""
    rows = lookup(rows, counts, "key", "k", counts.agg(F.sum("k")).first()[0] or 0).drop("k")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o")).drop("o", "parts")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _parts(count: Column, room: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / F.lit(room))).cast("int")


def _sift(pairs: DataFrame, nodes: DataFrame, signature: str, similarity: float) -> DataFrame:
    ends = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col(signature).alias(f"s{c}"))
    both = pairs.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(_sifted(similarity), "a long, b long").distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, named: DataFrame, scratch: Scratch, similarity: float, shingle: int) -> DataFrame:
    """Of pairs (a, b) those whose sets are that similar. Sets are made anew, of the texts that are in a pair only."""
    pairs = scratch.write(pairs.distinct())
    known = scratch.write(_sift(pairs, nodes, "fine", similarity))
    scratch.drop(pairs)
    pairs = known
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = named.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).mapInArrow(_sets(shingle), "id long, sh array<long>")
    sets = scratch.write(sets)
    x, y = sets.select(F.col("id").alias("a"), F.col("sh").alias("x")), sets.select(F.col("id").alias("b"), F.col("sh").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    out = scratch.write(pairs.join(x, "a").join(y, "b").filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"))
    scratch.drop(pairs, sets)
    return out


def _counts(rows: DataFrame, cell: int, sizes: bool = False) -> DataFrame:
    """Keys whose rows (key, id, root, n) are of several roots, with their rows and over how many parts these are spread."""
    by_key = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("k"), F.sum("n").alias("n")).filter("r0 < r1")
    parts = _parts(F.col("k"), cell)
    return by_key.select("key", "k", (F.greatest(parts, _parts(F.col("n"), ROOM)) if sizes else parts).alias("parts"))


def _joined(forest: DataFrame, nodes: DataFrame, named: DataFrame, roots: DataFrame, scratch: Scratch, similarity: float, shingle: int, cell: int) -> DataFrame:
    """Links that connect, beside ``roots``, all texts of a tree that links connect. Trees are classes of candidates; no pairs travel: the classes' texts meet in cells, first with
    their finer signatures, which cuts the classes down, then with their sets, which are made anew of texts in a class only. Forests pass a shuffle before they are
    contracted, as a task would have two Python workers otherwise."""
    known = roots.select(F.col("node").alias("id"), "root")
    trees = scratch.write(connected_components(forest.distinct(), scratch))
    rows = trees.select(F.col("node").alias("id"), F.col("root").alias("key")).join(nodes.select("id", "n", F.col("fine").alias("sig")), "id").join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    counts = scratch.write(_counts(rows, cell))
    forest = _dealt(rows, counts).mapInArrow(_candidates(similarity), "a long, b long")
    finer = scratch.write(connected_components(forest.distinct(), scratch))
    scratch.drop(trees, counts)
    ids = finer.select(F.col("node").alias("id"), F.col("root").alias("key"))
    sets = named.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).mapInArrow(_sets(shingle), "id long, sh array<long>")
    sets = scratch.write(sets)
    rows = ids.join(sets, "id").join(known, "id", "left").withColumn("root", F.coalesce("root", "id")).withColumn("n", F.size("sh"))
    counts = scratch.write(_counts(rows, cell, sizes=True))
    out = scratch.write(_dealt(rows.drop("n"), counts).mapInArrow(_links(similarity), "a long, b long").filter("a <> b").distinct())
    scratch.drop(finer, sets, counts)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """One row a row of ``docs``: id_col, component_id (smallest id reachable over links, itself included), group_size.

    Two texts are linked when the Jaccard similarity of their sets of ``shingle``-word shingles is ``similarity`` or more; every such link counts, found as follows.
    Texts of equal sets are one node. SimHash groups (``near_pairs``), verified, and each shared shingle's first text with the others, verified, link what is densely linked in as many
    comparisons as there are texts. What still lies in different components is then compared wherever two texts share a shingle of their prefixes: at the similarity they must share one.
    Prefixes put rare shingles first, by a table of fixed size; sizes and counters rule out most pairs, exactly, before sets are compared. A shingle's texts are spread over cells, so that none is too many for a task.
    From a cell go no pairs but forests, so what travels grows with the texts and not with the pairs in a group: candidates make classes, and links join the texts of a class.

    Null and wordless texts are one node. Rows with a null id link nothing; their component_id and group_size are null. Texts under one id are one document, judged by
    the least of those texts in byte order wherever sets are compared. Other columns are ignored. Empty in, empty out."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.filter("id is not null")
    sketched = scratch.write(named.mapInArrow(_sketch(shingle), "id long, fp long, digest binary, node long, n int, sig binary, fine binary, slot int, k long"))
    slots = sketched.filter("slot is not null").groupBy("slot").agg(F.sum("k").alias("k")).toArrow()  # SLOTS rows at most
    base = sketched.filter("slot is null")
    nodes = base.groupBy("digest").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("fine").alias("fine"), F.count("*").alias("rows"))
    nodes = scratch.write(nodes)
    rank = np.zeros(SLOTS, np.int64)
    rank[slots.column("slot").to_numpy()] = slots.column("k").to_numpy()
    source = spark.sparkContext.broadcast(np.ceil(np.log2(rank + 1)).astype(np.uint8))

    def prefixes(batches):
        yield from _prefixes(shingle, similarity, source.value)(batches)

    tokens = scratch.write(named.select("text").mapInArrow(prefixes, "token long, node long"))
    shared = scratch.write(tokens.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1"))
    meet = scratch.write(lookup(tokens, shared, "token", "k", shared.agg(F.sum("k")).first()[0] or 0).select("token", "node").distinct())
    scratch.drop(tokens, shared)
    placed = scratch.write(meet.join(nodes.select("node", "id"), "node").select("token", "id"))
    scratch.drop(meet)
    leads = scratch.write(placed.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("k")).filter("least < most").select("token", "least", "k"))

    by_print = nodes.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("k"))
    first = by_print.select("fp", "least")
    links = near_pairs(by_print)
    across = links.join(first.withColumnRenamed("fp", "a").withColumnRenamed("least", "x"), "a").join(first.withColumnRenamed("fp", "b").withColumnRenamed("least", "y"), "b").select("x", "y")
    within = lookup(nodes.select("fp", "id"), by_print.filter("k > 1"), "fp", "k", nodes.count()).select(F.col("least").alias("x"), F.col("id").alias("y"))
    stars = lookup(placed, leads, "token", "k", leads.agg(F.sum("k")).first()[0] or 0).select(F.col("least").alias("x"), F.col("id").alias("y"))
    early = across.union(within).union(stars).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
    one = _verified(_sift(early, nodes, "sig", similarity), nodes, named, scratch, similarity, shingle)
    roots = scratch.write(connected_components(one, scratch))

    info = nodes.select("id", "n", "sig").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = placed.select(F.col("token").alias("key"), "id").join(info, "id")
    counts = scratch.write(_counts(open_, cell))
    late = _dealt(open_, counts).mapInArrow(_candidates(similarity), "a long, b long")
    two = _joined(late, nodes, named, roots, scratch, similarity, shingle, cell)
    links = scratch.write(one.union(two))
    roots = scratch.write(connected_components(links, scratch))
    scratch.drop(placed, leads, one, two, links, counts)

    return _grouped(rows, base, nodes, roots, scratch, id_col)


def _grouped(rows: DataFrame, base: DataFrame, nodes: DataFrame, roots: DataFrame, scratch: Scratch, id_col: str) -> DataFrame:
    """Components of nodes to a row a row."""
    own: Column = F.coalesce("root", "id")
    rooted = scratch.write(nodes.select("digest", "id", "rows").join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", own.alias("component_id"), "rows"))
    groups = scratch.write(rooted.groupBy("component_id").agg(F.sum("rows").alias("group_size"), F.count("*").alias("kinds")))
    rooted = scratch.write(lookup(rooted, groups, "component_id", "kinds", rooted.count()))
    out = lookup(base.select("id", "digest"), rooted.select("digest", "component_id", "group_size", "rows"), "digest", "rows", base.count()).select("id", "component_id", "group_size")
    nobody = rows.filter("id is null").select("id", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("group_size"))
    return out.union(nobody).withColumnRenamed("id", id_col)
