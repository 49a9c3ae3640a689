"""Quality classification by hierarchical empirical Bayes: document evidence with host and path posteriors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, key_of, lookup, table, unit_hash

FEATURES = ["upper", "symbols", "digits", "stutter", "bare", "tails", "repeats", "top", "variety", "word_len", "long_words", "short_words", "sentences", "line_copies", "short", "size"]
#: Labelled documents to which the document classifier is fitted, at most: the first by a hash of the id.
FIT_ROWS = 20_000
THRESHOLD = 0.5
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PROSE = b".,;:'\"?!-()"
_MARK = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SYMBOL = bytes(b for b in _MARK if b not in _PROSE)
_IS_MARK = np.isin(np.arange(256), list(_MARK))
_END = (b".", b"!", b"?")
#: Words' worth of an ordinary text that is added to what is counted of a short one, so that figures of few words say little.
_USUAL = 20


def features(text: str | None) -> list[float]:
    """Shares and means over the whole text (UTF-8 bytes), each about 0 to 1: upper case, symbols, digits, marks that repeat the mark before them (stutter), words of marks alone (bare) and words that end in a symbol or in
    doubled marks (tails), repeated words, the commonest word, different words, lengths, sentence ends, copied lines. All are smooth in the text's length; null and empty texts have 0 but for ``variety`` and ``short``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    if not n:
        return [0.0] * 8 + [1.0] + [0.0] * 5 + [1.0, 0.0]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    kinds, a = list(counts.items()), np.frombuffer(raw, np.uint8)
    stutter = int(np.count_nonzero((a[1:] == a[:-1]) & _IS_MARK[a[1:]]))
    bare = sum(c for w, c in kinds if not w.strip(_MARK))
    tails = sum(c for w, c in kinds if w[-1] in _SYMBOL or (len(w) > 2 and w[-1] == w[-2] and w[-1] in _MARK))
    return [
        share(_UPPER), share(_SYMBOL), share(_DIGIT), stutter / size * 10, bare / n, tails / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, (max(counts.values()) - 1) / (n + _USUAL), (len(counts) + _USUAL) / (n ** 0.75 + _USUAL),
        min(2.0, (size / n - 1) / 10), sum(c for w, c in kinds if len(w) > 20) / n, sum(c for w, c in kinds if len(w) < 4) / n,
        sum(c for w, c in kinds if w.endswith(_END)) / n, 1 - len(set(lines)) / max(1, len(lines)), 1.0 / (1 + n / 10), min(1.0, np.log1p(n) / 12),
    ]


def _featured(batches):
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "host", "path", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method with a ridge on standardised features."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / std, float(w[-1] - (w[:-1] * mean / std).sum())


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, parent: str) -> float:
    """Number of documents that the parent's mean is worth: from the spread of group means around it beyond what chance makes (method of moments), between 1 and 1000."""
    chance = F.col(parent) * (1 - F.col(parent))
    spread, noise, within = groups.filter("n > 1").agg(F.avg((F.col("s") / F.col("n") - F.col(parent)) ** 2), F.avg(chance / F.col("n")), F.avg(chance)).first()
    if spread is None:
        return 1.0
    between = spread - noise
    return float(min(1000.0, max(1.0, within / between - 1))) if between > 0 else 1000.0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
             label_col: str = "quality", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of ``docs``: id_col, p_doc, host_posterior, path_posterior, quality, kept.

    A logistic classifier over whole-text features, fitted to at most ``fit_rows`` labelled ids, gives each document's evidence
    p_doc. Sites are the hosts (host_col) and, below them, the paths (host_col/path_col). A host's posterior is the mean evidence of its documents
    shrunk to the global mean, a path's that of its documents shrunk to its host's; how strongly is estimated from all groups,
    so that sparse sites lean on their parents. The document's own evidence is taken out of its path's before
    the two are combined: log odds of p_doc plus log odds of the path less those of the global mean. Sums go through partial
    aggregation; only fixed-size figures reach the driver.

    Null host or path: a site of its own. Null and empty texts have features of their own (``short``). Rows with a null id, and repeated rows, are
    classified like others. Without labels of both kinds nothing can be told: p_doc is 0.5 and all are kept. Null labels are ignored; of repeated ones the mean counts, and of
    texts repeated under a labelled id one."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key_of(F.col(host_col)).alias("host"), key_of(F.col(host_col), F.col(path_col)).alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.write(rows.mapInArrow(_featured, "id long, host string, path string, x array<double>"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.avg("y").alias("y")).orderBy(unit_hash(F.col("id"), "fit"), "id").limit(fit_rows)
    sample = rows.select("id", "x").join(known, "id").groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toArrow()
    x, y = np.array(sample.column("x").to_pylist(), float), np.array(sample.column("y").to_pylist(), float)
    if len(set(y > 0.5)) == 2:
        order = np.lexsort((*x.T, y))  # rows arrive in any order; sums should not depend on it
        w, bias = fit_logistic(x[order], (y[order] > 0.5).astype(float))
    else:
        w, bias = np.zeros(len(FEATURES)), 0.0
    score = F.lit(float(bias))
    for i, v in enumerate(w):
        score = score + F.col("x")[i] * F.lit(float(v))
    scored = rows.select("id", "host", "path", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))).alias("p"))
    scored = scratch.write(scored.withColumn("micro", F.round(F.col("p") * 1_000_000).cast("long")))  # whole numbers: sums are the same in any order
    paths = scratch.write(scored.groupBy("path").agg(F.first("host").alias("host"), (F.sum("micro") / 1e6).alias("s"), F.count("*").alias("n")))
    total, n_all = paths.agg(F.sum("s"), F.sum("n")).first()
    prior = total / n_all if n_all else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("paths")).withColumn("prior", F.lit(prior))
    hosts = hosts_table = scratch.write(hosts)
    k_host = strength(hosts, "prior")
    hosts = hosts.withColumn("host_posterior", (F.col("s") + k_host * F.lit(prior)) / (F.col("n") + k_host)).select("host", "paths", "host_posterior")
    paths = scratch.write(lookup(paths, hosts, "host", "paths", paths.count()))
    k_path = strength(paths, "host_posterior")
    scratch.drop(rows, hosts_table)
    out = lookup(scored.drop("host"), paths.select("path", "s", "n", "host_posterior"), "path", "n", n_all or 0)
    out = out.withColumn("path_posterior", (F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path))
    others = (F.greatest(F.lit(0.0), F.col("s") - F.col("p")) + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    odds = logit(F.col("p")) + logit(others) - logit(F.lit(prior))
    quality = 1 / (1 + F.exp(-odds))
    return out.select(F.col("id").alias(id_col), F.col("p").alias("p_doc"), "host_posterior", "path_posterior", quality.alias("quality"), (quality >= threshold).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
