"""Near-duplicate embeddings by spherical-cap filters from structured random product codes."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, lookup, table
from octetflow.llm.components import connected_components, local_roots

COSINE = 0.9
#: Chance that two vectors at exactly ``COSINE`` share no filter, in the design; more similar ones miss each other far less often.
MISS = 0.003
#: Unrelated vectors that a filter holds on average, in the design.
LOAD = 32
#: Blocks of a product code. With three the directions share so many codewords that recall at cosine 0.9 falls to 93 % (4.5 and 20 million vectors, 64 dimensions); with two it is 99 %.
BLOCKS = 2
#: Product codes, each after a random rotation of its own, that share the filters, and filters for each that independent directions would need: the
#: directions of one code share their codewords, which costs recall (at cosine 0.9 one code finds 70 to 80 %, 32 with twice the filters over 99 %).
ROTATIONS, EXTRA = 32, 2.0
#: Rows of a filter in one cell; fuller filters are cut into cells of two such parts.
CELL = 1024
#: Classes that make up a dense group, at least, and leaders that are tried in a bucket; both are a matter of speed only.
DENSE, LEADERS = 16, 64


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def _together(t: float, rho: float) -> float:
    """P(y >= t | x >= t) of two standard normals with correlation rho."""
    x = np.linspace(t, t + 8, 4001)
    rest = np.array([_tail(v) for v in (t - rho * x) / math.sqrt(1 - rho * rho)])
    return float((np.exp(-x * x / 2) * rest).sum() / np.exp(-x * x / 2).sum())


class CapCode:
    """Filter directions: in each of ``ROTATIONS`` product codes, all concatenations of one codeword a block, after a random rotation. A vector passes a filter
    when its inner product with the direction is ``t`` or more. Threshold and number of filters follow from the number of vectors: ``LOAD``
    unrelated ones a filter, and as many filters a vector as ``MISS`` asks for."""

    def __init__(self, dim: int, n: int, cosine: float = COSINE, miss: float = MISS, load: float = LOAD, seed: int = 7):
        p = min(0.02, load / max(1, n))
        lo, hi = 0.0, 12.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _tail(mid) > p else (lo, mid)
        self.t = lo
        filters = EXTRA * math.log(1 / miss) / _together(self.t, cosine) / p / ROTATIONS
        self.blocks = min(dim, BLOCKS)
        self.words = math.ceil(filters ** (1 / self.blocks))
        cuts = [dim * i // self.blocks for i in range(self.blocks + 1)]
        self.codes = []
        for k in range(ROTATIONS):
            rng = np.random.default_rng([seed, dim, k])
            rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            self.codes.append([rotation[:, a:b] @ rng.standard_normal((b - a, self.words)) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _decode(self, unit: np.ndarray, code: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        scores = [unit @ c for c in code]
        reach = [np.zeros(len(unit))]
        for s in reversed(scores[1:]):
            reach.append(reach[-1] + s.max(axis=1))
        row, total, which = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for s, rest in zip(scores, reversed(reach), strict=True):
            new = total[:, None] + s[row]
            at, word = np.nonzero(new >= (self.t - rest[row])[:, None])
            total, which, row = new[at, word], which[at] * self.words + word, row[at]
        return row, which

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), by row, for every filter that a row passes: block by block, keeping the prefixes that can still reach ``t``."""
        found = [self._decode(unit, code) for code in self.codes]
        row = np.concatenate([r for r, _ in found])
        which = np.concatenate([f + k * self.words**self.blocks for k, (_, f) in enumerate(found)])
        order = np.argsort(row, kind="stable")
        return row[order], which[order]


def _units(raw: pa.BinaryArray, kind: str) -> np.ndarray:
    """Unit vectors from an Arrow column of vectors of one length, read from its buffer."""
    lo, hi = (int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset + k]) for k in (0, len(raw)))
    x = np.frombuffer(raw.buffers()[2], kind, (hi - lo) // np.dtype(kind).itemsize, lo).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(kind: str):
    """(id, embedding) to (id, dim, bytes, digest); dim 0 for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            dims, raws, keys = [], [], []
            for v in batch.column(1):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid else np.zeros(0, kind)
                ok = len(x) > 0 and not v.values.null_count and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x) if ok else 0)
                raws.append((x + 0.0).tobytes() if ok else b"")
                keys.append(hashlib.sha256(raws[-1]).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(keys, pa.binary())], ["id", "dim", "raw", "digest"])

    return run


class _Codes:
    """The code of each vector length, made from its seed where it is needed and kept with the broadcast's value."""

    def __init__(self, sizes: dict[int, int], cosine: float, miss: float, load: float):
        self.sizes, self.rest, self.made = sizes, (cosine, miss, load), {}

    def __getstate__(self):
        return {"sizes": self.sizes, "rest": self.rest, "made": {}}

    def of(self, dim: int) -> CapCode:
        if dim not in self.made:
            self.made[dim] = CapCode(dim, self.sizes[dim], *self.rest)
        return self.made[dim]


def _buckets(source, kind: str):
    """Classes with the pair of nearest codewords of the first code, which vectors close to each other mostly share."""

    def run(batches):
        for batch in batches:
            dims, key = batch.column(1).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at, code = np.flatnonzero(dims == dim), source.value.of(dim)
                unit = _units(batch.column(2).take(pa.array(at)), kind)
                for words in code.codes[0]:
                    key[at] = key[at] * code.words + (unit @ words).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["b", *batch.schema.names])

    return run


def _dense(cosine: float, kind: str):
    """Rows sorted by (dim, b, part, id) to (digest, id, g, others): groups of ``DENSE`` or more classes within half the angle of their leader g, all of which are linked with each other therefore;
    others: the vectors of the group without those of the row. Groups are a shortcut only, so that it is no matter which are found."""
    near = math.sqrt((1 + cosine) / 2) + 1e-9

    def run(batches):
        for part in _stretches(batches, ["dim", "b", "part"]):
            unit = _units(part.column("raw").combine_chunks(), kind)
            ids, mult = part.column("id").to_numpy(), part.column("mult").to_numpy()
            open_, out = np.arange(len(ids)), []
            for _ in range(LEADERS):
                if len(open_) < DENSE:
                    break
                close = unit[open_] @ unit[open_[0]] >= near
                group = open_[close]
                if len(group) >= DENSE:
                    out.append((group, np.full(len(group), ids[group[0]]), mult[group].sum() - mult[group]))
                open_ = open_[~close] if close[0] else open_[1:]
            if out:
                at, g, others = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("digest").combine_chunks().take(pa.array(at)), pa.array(ids[at]), pa.array(g), pa.array(others)], ["digest", "id", "g", "others"])

    return run


def _stretches(batches, keys: list[str]):
    """Tables of the rows with the same keys, of rows sorted by them."""
    wait, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[lo] for c in columns)
            if key != now:
                if wait:
                    yield pa.Table.from_batches(wait)
                wait, now = [], key
            wait.append(batch.slice(lo, hi - lo))
    if wait:
        yield pa.Table.from_batches(wait)


def _filters(source, kind: str):
    """Classes to rows (filter, all its filters, class), for each filter that the vector passes."""

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                every, code = np.flatnonzero(dims == dim), source.value.of(dim)
                step = max(1, min(4096, 4_000_000 // code.words**2))
                for lo in range(0, len(every), step):
                    part = batch.take(pa.array(every[lo : lo + step]))
                    row, which = code.decode(_units(part.column(2), kind))
                    starts = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(which))
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(which), lists.take(pa.array(row)), *out.columns], ["f", "all_f", *batch.schema.names])

    return run


def _cells(cosine: float, kind: str):
    """Rows sorted by (dim, f, i, j, id) to (id, root, n): links verified in that cell, each counted in its pair's first common filter only. Members of one dense group are not compared."""

    def links(part: pa.Table):
        unit = _units(part.column("raw").combine_chunks(), kind)
        chunk, group, ids, mult = (part.column(c).to_numpy() for c in ("chunk", "g", "id", "mult"))
        f, i, j = (part.column(c)[0].as_py() for c in ("f", "i", "j"))
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        found = []
        for g in np.unique(group[left]).tolist():
            mine, other = left[group[left] == g], right if g < 0 else right[group[right] != g]
            for lo in range(0, len(mine), 512):
                a, b = np.nonzero(unit[mine[lo : lo + 512]] @ unit[other].T >= cosine)
                a, b = mine[lo + a], other[b]
                found.append((a[a < b], b[a < b]) if i == j else (a, b))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (left[:0], left[:0])
        if not len(a):
            return None
        lists = part.column("all_f").combine_chunks()
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy()[lists.offsets[0].as_py() :]
        row = np.repeat(np.arange(len(ids)), sizes)
        before = flat < f
        width = max(1, int(np.bincount(row[before], minlength=len(ids)).max()))
        table = np.full((2, len(ids), width), -1, np.int64)
        table[1] = -2
        place = np.cumsum(before) - np.repeat(np.r_[0, np.cumsum(before)][np.r_[0, np.cumsum(sizes)[:-1]]], sizes) - 1
        table[:, row[before], place[before]] = flat[before]
        step = max(1, 8_000_000 // width**2)
        first = np.concatenate([~(table[0][a[k : k + step], :, None] == table[1][b[k : k + step], None, :]).any(axis=(1, 2)) for k in range(0, len(a), step)])
        a, b = a[first], b[first]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a, mult[b])
        np.add.at(n, b, mult[a])
        root = ids.copy()
        if len(a):
            node, top = local_roots(ids[a], ids[b])
            root[np.searchsorted(ids, node)] = top  # ids of a cell come in order
        has = n > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(root[has]), pa.array(n[has])], ["id", "root", "n"])

    def run(batches):
        for part in _stretches(batches, ["dim", "f", "i", "j"]):
            if part.num_rows > 1 and (out := links(part)) is not None:
                yield out

    return run


def near_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS, load: float = LOAD, cell: int = CELL) -> DataFrame:
    """One row a row of ``df``: id_col, n_links, component_id, kept.

    Equal vectors make up one class, linked with each other without search. So do classes within half the angle of a common leader (dense groups, sought where many share their nearest codewords). Each class's vector is list-decoded to all filters whose cap holds it; classes that
    share a filter are verified by their cosine in double precision. A filter's rows are spread over cells of at most about
    2 * ``cell`` rows, so that a large cluster is compared by many tasks; members of one dense group are not compared. A pair counts in its first common filter only.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0, component_id their own, kept. Vectors of different
    lengths never link. Rows with a null id are in no class: n_links 0, component_id null, kept false. A repeated id with an equal vector counts as another vector; ids that are the smallest of several
    different vectors stand for all of these: they share links and component. Other columns are ignored."""
    spark = df.sparkSession
    kind = "<f4" if "float" in df.schema[vector_col].dataType.simpleString() else "<f8"
    scratch = Scratch(spark, "embeddings")
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = scratch.write(given.mapInArrow(_vectors(kind), "id long, dim int, raw binary, digest binary"))
    good = rows.filter("dim > 0 and id is not null")
    classes = scratch.write(good.groupBy("digest").agg(F.min("id").alias("cid"), F.count("*").alias("mult"), F.first("dim").alias("dim"), F.first("raw").alias("raw")))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a vector length
    source = spark.sparkContext.broadcast(_Codes(sizes, cosine, miss, load))
    plain = classes.select(F.col("cid").alias("id"), "dim", "raw", "mult", "digest")

    spots = plain.repartition("id").mapInArrow(_buckets(source, kind), "b long, id long, dim int, raw binary, mult long, digest binary").drop("raw")
    spots = scratch.write(spots)
    full = spots.groupBy("dim", "b").agg(F.count("*").alias("size")).filter(F.col("size") >= DENSE)
    full = scratch.write(full)
    crowded = lookup(spots, full, ["dim", "b"], "size", spots.count()).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(4 * cell))).cast("int"))
    crowded = crowded.select("dim", "b", "part", "id", "mult", "digest").join(plain.select("digest", "raw"), "digest")
    dense = crowded.repartition("dim", "b", "part").sortWithinPartitions("dim", "b", "part", "id").mapInArrow(_dense(cosine, kind), "digest binary, id long, g long, others long")
    dense = scratch.write(dense)

    grouped = plain.join(dense.select("digest", "g"), "digest", "left").select("id", "dim", "raw", "mult", F.coalesce("g", F.lit(-1)).alias("g"))
    found = grouped.repartition("id").mapInArrow(_filters(source, kind), "f long, all_f array<long>, id long, dim int, raw binary, mult long, g long")
    found = scratch.write(found)
    per = Window.partitionBy("dim", "f")
    sizes = found.groupBy("dim", "f", "g").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / F.lit(cell)).cast("int"))
    sizes = sizes.withColumns({"every": F.sum("size").over(per), "chunks": F.sum("parts").over(per).cast("int"), "start": (F.sum("parts").over(per.orderBy("g")) - F.col("parts")).cast("int")})
    sizes = scratch.write(sizes.filter((F.col("every") > 1) & ~((F.col("g") >= 0) & (F.col("size") == F.col("every")))).drop("every"))
    placed = lookup(found, sizes, ["dim", "f", "g"], "size", sizes.agg(F.sum("size")).first()[0] or 0)
    placed = placed.withColumn("chunk", F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    partners = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: (F.col("g") < 0) | (c < F.col("start")) | (c >= F.col("start") + F.col("parts")))
    placed = placed.withColumn("k", F.explode(partners)).withColumn("i", F.least("chunk", "k")).withColumn("j", F.greatest("chunk", "k")).select("f", "i", "j", "chunk", "all_f", "id", "dim", "raw", "mult", "g")
    checked = placed.repartition("dim", "f", "i", "j").sortWithinPartitions("dim", "f", "i", "j", "id").mapInArrow(_cells(cosine, kind), "id long, root long, n long")
    links = scratch.write(checked.union(dense.select("id", F.col("g").alias("root"), F.col("others").alias("n"))))
    scratch.drop(spots, full, dense, found, sizes)
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    n_links = links.groupBy("id").agg(F.sum("n").alias("other"))
    result = classes.select("digest", "cid", "mult").join(n_links, classes["cid"] == n_links["id"], "left").drop("id").join(roots, F.col("cid") == F.col("node"), "left")
    result = scratch.write(result.select("digest", "mult", (F.coalesce("other", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id")))
    linked = lookup(good.select("id", "digest"), result, "digest", "mult", good.count()).select("id", "n_links", "component_id")
    alone = rows.filter("dim = 0 or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = v.vec_id
"""
