"""Language identification by interpolated Kneser-Ney character models, one a language, in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import table, unit_hash
from octetflow.llm.quality import fit_logistic

ORDER = 4
#: Documents of one language from which models and calibration are fitted, at most (in expectation); the choice is by a hash of the id, of whole texts.
FIT_DOCS = 500
#: Languages that are learned, at most: those of the most documents, ties by name. Others are never predicted, and their documents get the nearest learned one.
LANGS = 256
#: Sampled documents that a language needs before some of them calibrate instead of being counted.
ENOUGH = 8
#: Share of them that calibrates; characters that no model knows share what is left over an alphabet of this size.
CALIBRATE, ALPHABET = 0.25, 65536
THRESHOLD = 0.5
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Runs of letters, lower-cased, one space before and after each."""
    found = [w for w in _LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]  # of digits like ² alone, none
    return f" {' '.join(found)} " if found else ""


def hashes(line: str, order: int) -> list[np.ndarray]:
    """For n = 0 .. order the hash of the n characters that end at each place; before the text there are spaces. The same function serves tables and texts."""
    c = np.frombuffer((" " * (order - 1) + line).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [np.zeros(len(c), np.uint64)], np.zeros(len(c), np.uint64)
    for _ in range(order):
        h = (np.concatenate([np.zeros(1, np.uint64), h[:-1]]) + np.uint64(1)) * _P + c
        h ^= h >> np.uint64(29)
        out.append(h)
    return [h[order - 1 :] for h in out]


def gram_hashes(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams of one length, as ``hashes`` gives them."""
    n = len(grams[0]) if grams else 0
    if not n:
        return np.zeros(len(grams), np.uint64)
    c = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n)
    h = np.zeros(len(grams), np.uint64)
    for k in range(n):
        h = (h + np.uint64(1)) * _P + c[:, k]
        h ^= h >> np.uint64(29)
    return h


class KneserNey:
    """Models of all languages over one set of arrays: for each order the sorted hashes of the n-grams seen in any language with the log
    probabilities of their last characters in every language, and the sorted hashes of contexts with their log back-off weights."""

    def __init__(self, counts: dict[str, Counter], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        kn: dict[int, list[Counter]] = {order: [counts[x] for x in self.langs]}
        for n in range(order - 1, 0, -1):  # how many characters an n-gram was seen after
            kn[n] = [Counter(g[1:] for g in c) for c in kn[n + 1]]
        self.grams, self.contexts = {}, {}
        lower: dict[str, np.ndarray] = {"": np.full(len(self.langs), 1 / ALPHABET)}
        for n in range(1, order + 1):
            cuts, totals, types = [], [], []
            for c in kn[n]:
                ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
                cuts.append(min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5)
                total, kind = Counter(), Counter()
                for g, v in c.items():
                    total[g[:-1]] += v
                    kind[g[:-1]] += 1
                totals.append(total), types.append(kind)
            contexts = sorted(set().union(*totals))
            back = {x: np.array([cuts[k] * types[k][x] / totals[k][x] if totals[k][x] else 1.0 for k in range(len(self.langs))]) for x in contexts}
            probs = {}
            for g in sorted(set().union(*kn[n])):
                x = g[:-1]
                seen = np.array([max(0.0, kn[n][k][g] - cuts[k]) / totals[k][x] if kn[n][k].get(g) else 0.0 for k in range(len(self.langs))])
                probs[g] = seen + back[x] * lower[g[1:]]
            self.contexts[n] = self._sorted(contexts, [back[x] for x in contexts])
            self.grams[n] = self._sorted(list(probs), list(probs.values()))
            lower = probs

    def _sorted(self, names: list[str], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = gram_hashes(names)
        at = np.argsort(keys)
        return keys[at], np.log(np.array(values).reshape(len(names), len(self.langs))[at]).astype(np.float32)

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return at, keys[at] == h

    def entropies(self, text: str | None) -> tuple[np.ndarray, int]:
        """Cross-entropy a character (nats) in each language, and the number of characters; of the whole text."""
        line = letters(text)
        total = np.zeros(len(self.langs))
        for lo in range(0, len(line), 1 << 18):  # long texts in parts that overlap by a context
            part = line[max(0, lo - self.order + 1) : lo + (1 << 18)]
            skip = min(lo, self.order - 1)
            open_, h = None, hashes(part, self.order)
            prior = [np.concatenate([x[:1], x[:-1]])[skip:] for x in h]  # the context: what ends one place before
            h = [x[skip:] for x in h]
            if not skip and len(prior[0]):
                first = " " * self.order
                for n in range(1, self.order + 1):
                    prior[n][0] = gram_hashes([first[:n]])[0]
            for n in range(self.order, 0, -1):
                hn, cn = (h[n], prior[n - 1]) if open_ is None else (h[n][open_], prior[n - 1][open_])
                keys, logs = self.grams[n]
                at, hit = self._find(keys, hn)
                total += logs[at[hit]].sum(axis=0, dtype=np.float64)
                if hit.all():
                    open_ = np.zeros(0, np.int64)
                    break
                miss = np.flatnonzero(~hit)
                keys, logs = self.contexts[n]
                at, hit = self._find(keys, cn[miss])
                total += logs[at[hit]].sum(axis=0, dtype=np.float64)
                open_ = miss if open_ is None else open_[miss]
            total -= len(open_) * np.log(ALPHABET)
        return -total / max(1, len(line)), len(line)


class Identifier:
    """Models with the calibration of their verdicts."""

    def __init__(self, model: KneserNey, usual: np.ndarray, spread: np.ndarray, weights: np.ndarray, bias: float):
        self.model, self.usual, self.spread, self.weights, self.bias = model, usual, spread, weights, bias

    def signs(self, entropy: np.ndarray, n: int) -> tuple[int, list[float]]:
        best = int(entropy.argmin())
        margin = float(np.partition(entropy, 1)[1] - entropy[best]) if len(entropy) > 1 else 1.0
        excess = max(0.0, float(entropy[best] - self.usual[best]) / self.spread[best])
        return best, [min(3.0, margin), min(10.0, margin * np.sqrt(n) / 3), min(10.0, excess) * n / (n + 10)]

    def predict(self, text: str | None) -> tuple[str, float]:
        entropy, n = self.model.entropies(text)
        if not n or not len(entropy):
            return UNKNOWN, 0.0
        best, x = self.signs(entropy, n)
        return self.model.langs[best], float(1 / (1 + np.exp(-np.clip(self.bias + np.dot(self.weights, x), -30, 30))))


def _count(order: int):
    """(lang, text) to (lang, n-gram, count), added up batch by batch."""

    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if line := letters(text):
                    line = " " * (order - 1) + line
                    counts.setdefault(lang, Counter()).update(line[k : k + order] for k in range(len(line) - order + 1))
            rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "g", "n"])

    return run


def fit(examples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, fit_docs: int = FIT_DOCS, langs: int = LANGS) -> Identifier:
    """Fits to a hash sample of at most ``fit_docs`` documents (in expectation) of each of at most ``langs`` languages: n-grams are counted on the executors and added
    up; the two bounds hold what reaches the driver. Nulls in id, text or language are no examples."""
    known = examples.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null and id is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    shares = examples.sparkSession.createDataFrame([(r["lang"], min(1.0, fit_docs / r["n"]), CALIBRATE if min(r["n"], fit_docs) >= ENOUGH else 0.0) for r in sizes], "lang string, share double, aside double")
    sample = known.join(F.broadcast(shares), "lang").filter(unit_hash(F.col("id"), "fit") < F.col("share"))
    side = unit_hash(F.col("id"), "calibrate") < F.col("aside")
    grams = sample.filter(~side).select("lang", "text").mapInArrow(_count(order), "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, Counter] = {}
    for lang, g, n in zip(*(grams.column(c).to_pylist() for c in ("lang", "g", "n")), strict=True):
        counts.setdefault(lang, Counter())[g] = n
    model = KneserNey(counts, order)
    source = examples.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            found = [source.value.entropies(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(e) for e, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64())], ["lang", "e", "n"])

    held = sample.filter(side).select("lang", "text").mapInArrow(measure, "lang string, e array<double>, n long").toArrow().to_pylist()
    held = sorted((r for r in held if r["n"] and r["lang"] in model.langs), key=lambda r: (r["lang"], r["n"], r["e"]))
    usual, spread = np.full(len(model.langs), 3.0), np.full(len(model.langs), 0.5)
    for k, lang in enumerate(model.langs):
        if own := [r["e"][k] for r in held if r["lang"] == lang]:
            usual[k], spread[k] = np.median(own), max(0.05, 1.5 * np.median(np.abs(np.array(own) - np.median(own))))
    out = Identifier(model, usual, spread, np.zeros(3), 0.0)
    if held:
        signs = [out.signs(np.array(r["e"]), r["n"]) for r in held]
        x, y = np.array([s for _, s in signs]), np.array([model.langs[b] == r["lang"] for (b, _), r in zip(signs, held, strict=True)], float)
        flat = np.array([[0.0, 0.0, 10.0]] * max(1, len(x) // 20))  # texts of no language: no margin, far from usual
        out.weights, out.bias = fit_logistic(np.concatenate([x, flat]), np.concatenate([y, np.zeros(len(flat))]))
    return out


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of ``docs``: id_col, lang_pred (lowest cross-entropy; ties by name; "und" where there is no letter), score (calibrated chance of being right), accepted (score at
    least ``threshold``). Null and repeated ids keep their rows; other columns are ignored; no shuffle."""
    source = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [source.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang string, score double")
    return rows.select(F.col("id").alias(id_col), F.col("lang").alias("lang_pred"), "score", (F.col("score") >= threshold).alias("accepted"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = identify(docs, fit(docs.filter(~held_out)))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
