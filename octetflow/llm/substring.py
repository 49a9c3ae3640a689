"""Removal of repeated passages: seeds are winnowed anchors, extension decides each window of words, both ways from its seed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, lookup, table

WINDOW, GRAM = 50, 16
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Two independent 64-bit polynomial hashes of any run of words, from running sums."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.sums, self.powers = [], []
        for k, odd in enumerate(_ODD):
            back = np.full(n + 1, pow(odd, -1, 2**64), np.uint64)
            back[0] = 1
            back = np.multiply.accumulate(back)
            power = np.full(n + 1, odd, np.uint64)
            power[0] = 1
            self.powers.append(np.multiply.accumulate(power))
            terms = (w if k == 0 else mixed(w ^ np.uint64(odd))) * back[:n]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def of(self, start: np.ndarray, length, k: int) -> np.ndarray:
        s = self.sums[k]
        return mixed((s[start + length] - s[start]) * self.powers[k][start])


def blocks(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Runs of consecutive windows with the same anchor: anchor hash, two hashes of the words that the run covers, first and last window start.

    A window's anchor is the leftmost least hash among its word grams, so it depends on the window's words alone, and equal windows
    have equal anchors wherever they stand. Successive windows mostly share theirs: about two runs a window's length."""
    n, span = len(words), window - gram + 1
    if n < window:
        return None
    roll = Rolling(words)
    g = roll.of(np.arange(n - gram + 1), gram, 0)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.concatenate([view[i : i + 65536].argmin(axis=1) + np.arange(i, min(len(view), i + 65536)) for i in range(0, len(view), 65536)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    length = last - first + window
    place = ((at[first] - first).astype(np.uint64) << np.uint64(32)) | length.astype(np.uint64)
    return g[at[first]], mixed(roll.of(first, length, 0) ^ place), mixed(roll.of(first, length, 1) ^ place), first, last


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: white space is \x20 and \x09-\x0D


def _batch(names: list[str], kinds: list, columns: list) -> pa.RecordBatch:
    parts = [pa.array(np.concatenate(c).view(np.int64) if c and c[0].dtype == np.uint64 else np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(parts, names)


def _seeds(window: int, gram: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                if (found := blocks(_split(t.as_py()), window, gram)) is not None:
                    a, b1, b2, first, last = found
                    for c, x in zip(out, (a, b1, b2, np.full(len(a), i.as_py(), np.int64), first, last), strict=True):
                        c.append(x)
            yield _batch(["a", "b1", "b2", "id", "lo", "hi"], [pa.int64()] * 6, out)

    return run


def _windows(window: int):
    """(id, text, runs) to the hashes of the windows of those runs."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, t, runs in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                roll = Rolling(_split(t.as_py()))
                lo = np.array([r["lo"] for r in runs.as_py()], np.int64)
                size = np.array([r["hi"] for r in runs.as_py()], np.int64) - lo + 1
                first = np.repeat(lo, size)
                at = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
                for c, x in zip(out, (roll.of(at, window, 0), roll.of(at, window, 1), np.full(len(at), i.as_py(), np.int64), first, at), strict=True):
                    c.append(x)
            yield _batch(["w1", "w2", "id", "lo", "at"], [pa.int64()] * 5, out)

    return run


def _cut(window: int, with_text: bool):
    """(id, text, covered) to the counts and the kept words; covered: arrays [first, last] of window starts."""

    def run(batches):
        for batch in batches:
            n, gone, sha, texts = [], [], [], []
            for t, covered in zip(batch.column(1), batch.column(2), strict=True):
                words = _split(t.as_py())
                n.append(len(words))
                if spans := covered.as_py():
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [x["lo"] for x in spans], 1)
                    np.add.at(edge, [x["hi"] + window for x in spans], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                gone.append(n[-1] - len(words))
                line = b" ".join(words)
                sha.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    texts.append(line.decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, ["id", "n", "gone", "sha", "kept"][: 4 + with_text])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a row of ``docs``: id_col, n_words, n_removed, kept_sha256, and with ``with_text`` the kept words (kept_text).

    A word goes if a window of ``window`` consecutive words of its document covers it whose words also start in a document with a smaller id.

    Seeds: each window has one winnowed anchor, and windows that share it form a run (``blocks``). Documents meet on the runs'
    anchors. Extension: runs that are equal as a whole, to both sides of the anchor, are settled at once: only the smallest id keeps its words. Where an
    anchor has several different runs, one place of each has all its windows compared by hash (128 bits), which finds how far the repeats reach to either side. Overlapping
    covered windows make up the maximal repeats. Runs and windows are counted by partial aggregation and looked up without gathering a
    group in one task; no pairs of documents are made.

    Null texts and those of fewer words than a window lose nothing. Rows with a null id lose nothing and take nothing from others. Rows repeated under one id
    are one document: their windows are pooled and removed alike where both have them. Other columns are ignored."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = rows.filter("id is not null")
    seeds = scratch.write(named.mapInArrow(_seeds(window, gram), "a long, b1 long, b2 long, id long, lo long, hi long").withColumns({"lo": F.col("lo").cast("int"), "hi": F.col("hi").cast("int")}))
    runs = scratch.write(seeds.groupBy("b1", "b2").agg(F.first("a").alias("a"), F.min(F.struct("id", "lo", "hi")).alias("m"), F.count("*").alias("n")))  # equal runs have equal anchors
    runs_by_anchor = runs.groupBy("a").agg(F.count("*").alias("kinds"), F.min("m.id").alias("least"), F.max("m.id").alias("most"))
    several = scratch.write(runs_by_anchor.filter("least < most").select("a", "kinds"))
    open_ = scratch.write(lookup(runs.select("a", "m"), several, "a", "kinds", several.agg(F.sum("kinds")).first()[0] or 0).select("m.*").distinct())
    places = open_.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # of one document
    windows = scratch.write(named.join(places, "id").select("id", "text", "runs").mapInArrow(_windows(window), "w1 long, w2 long, id long, lo long, at long").withColumns({"lo": F.col("lo").cast("int"), "at": F.col("at").cast("int")}))
    least = scratch.write(windows.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least < most"))
    late = lookup(windows, least, ["w1", "w2"], "n", windows.count()).filter("id > least").select("id", "lo", "at").distinct()
    partly = late.groupBy("id", "lo").agg(F.collect_list(F.col("at") - F.col("lo")).alias("late"))  # of one run
    partly = partly.select(F.col("id").alias("m_id"), F.col("lo").alias("m_lo"), "late")
    known = runs.select("b1", "b2", F.col("m.id").alias("m_id"), F.col("m.lo").alias("m_lo"), "n").join(partly, ["m_id", "m_lo"], "left")
    known = scratch.write(known.filter("n > 1 or late is not null"))
    scratch.drop(runs, several, open_, windows, least)
    hits = lookup(seeds.select("b1", "b2", "id", "lo", "hi"), known.drop("m_lo"), ["b1", "b2"], "n", seeds.count())
    whole = hits.filter("id > m_id").select("id", "lo", "hi")
    part = hits.filter("id = m_id and late is not null").select("id", F.explode(F.transform("late", lambda x: F.col("lo") + x)).alias("lo")).select("id", "lo", F.col("lo").alias("hi"))
    covered = whole.unionByName(part).distinct().groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("covered"))  # of one document
    names = [id_col, "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + with_text]
    return rows.join(covered, "id", "left").select("id", "text", "covered").mapInArrow(_cut(window, with_text), "id long, n long, gone long, sha string" + ", kept string" * with_text).toDF(*names)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM w WHERE len(words) >= 50),
h AS MATERIALIZED (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
c AS (SELECT doc_id, unnest(range(pos, pos + 50)) AS k FROM h JOIN m USING (h) WHERE doc_id > least),
g AS (SELECT doc_id, list(DISTINCT k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [x FOR x, i IN words IF NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
