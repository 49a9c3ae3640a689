"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import Scratch, ascii_lower, key_of, lookup, table, unit_hash

ALPHA = {"source": 0.7, "lang": 0.7, "topic": 0.8}
KEEP, SALT = 0.9, "mix"
#: Raking goes on until no marginal is further than this share of all tokens from its target, or stands still; that is looked at every ROUNDS rounds, MOST rounds at most.
TOLERANCE, ROUNDS, MOST = 1e-6, 10, 1000
#: Up to this many cells are raked in one task, which needs no exchange.
ONE_TASK = 200_000
#: Words that stand for topics, the shortest and longest that can, and the share of the documents that one may be in: commoner words say nothing of a topic.
TOPICS, SHORTEST, LONGEST, COMMON = 24, 4, 20, 20
OTHER = "-"
_SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none of a null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SPACE), "")


def topic_words(docs: DataFrame, text: Column, topics: int = TOPICS) -> list[str]:
    """The ``topics`` words of ``SHORTEST`` to ``LONGEST`` characters that most documents have, among those that no more than one in ``COMMON`` has; the most frequent
    first, ties by name. Counted over all documents by partial aggregation; only the chosen words reach the driver."""
    each = docs.select(F.explode(F.array_distinct(words_of(text))).alias("word"))
    seen = each.filter(F.char_length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    most = docs.count() // COMMON
    return [r["word"] for r in seen.filter((F.col("n") > 1) & (F.col("n") <= F.lit(most))).orderBy(F.desc("n"), "word").limit(topics).collect()]


def with_topic(docs: DataFrame, topics: list[str], words: str = "words") -> DataFrame:
    """``docs`` with a column ``topic``: the topic word that is most often among the words (a column), the rarer one of equals; ``OTHER`` where there is none. The few topic words of a text
    are taken out first, in a projection of their own, so that the text is gone through once."""
    if not topics:
        return docs.withColumn("topic", F.lit(OTHER))
    every = F.array(*(F.lit(t) for t in topics))
    own = docs.withColumn("_own", F.filter(words, lambda w: w.isin(topics)))
    scored = F.transform(F.array_distinct("_own"), lambda t: F.struct(F.size(F.filter("_own", lambda w: w == t)).alias("n"), F.array_position(every, t).alias("rank"), t.alias("word")))
    return own.withColumn("topic", F.coalesce(F.array_max(scored)["word"], F.lit(OTHER))).drop("_own")


def tempered(cells: DataFrame, column: str, alpha: float) -> DataFrame:
    """Targets for one marginal: token shares to the power alpha, made to sum to 1. (column, share)"""
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("t")).withColumn("p", F.when(F.col("t") > 0, F.pow(F.col("t"), F.lit(alpha))).otherwise(0.0))
    every = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select(column, (F.col("p") / F.lit(every)).alias("share"))


def _rounds(state: DataFrame, columns: list[str], every: float, small: bool, n: int) -> DataFrame:
    """``n`` rounds of raking; ``gap`` is the largest distance between a marginal's share and its target before a step of the last round.
    Few cells are one partition, where windows need no exchange; the rounds are one text, as a plan built call by call is analysed at each."""
    spark, names = state.sparkSession, ", ".join(f"`{c}`" for c in state.columns if c not in ("w", "gap"))
    query = f"(SELECT {names}, w, 0D AS gap FROM {{state}})"
    for i, c in enumerate(columns * n):
        sums = f"(SELECT *, sum(w) OVER (PARTITION BY {c}) AS sum FROM {query})" if small else f"(SELECT * FROM {query} JOIN (SELECT {c}, sum(w) AS sum FROM {query} GROUP BY {c}) USING ({c}))"
        fixed, share, gap = f"{c}_share IS NULL OR sum <= 0", f"{c}_share", "gap" if i % len(columns) else "0D"
        query = f"""(SELECT {names}, CASE WHEN {fixed} THEN w ELSE w * {share} / sum * {every!r}D END AS w,
            CASE WHEN {fixed} THEN {gap} ELSE greatest({gap}, abs(sum / {every!r}D - {share})) END AS gap FROM {sums})"""
    return spark.sql(f"SELECT * FROM {query}", state=state.coalesce(1) if small else state)


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, tolerance: float = TOLERANCE, most: int = MOST, strict: bool = False) -> DataFrame:
    """``cells``: one row a combination of the columns of ``targets`` (not null), with ``tokens`` (double). Adds ``ratio``, the product of one
    factor a column by which tokens are multiplied so that each column's marginal takes its target share of all tokens.

    Each step sets one column's factors from the sums of the cells under the other columns' factors. Cells, not documents, are
    visited. Rounds go on until no marginal is further than ``tolerance`` from its target. Where a gap stands still (the cells cannot meet all targets) or after ``most`` rounds
    a warning tells the gap, or, ``strict``, an error. Values without a target keep factor 1; values with a target but no tokens have none to scale."""
    total, n = cells.agg(F.sum("tokens"), F.count("*")).first()
    every, small = float(total or 0.0), n <= ONE_TASK
    state = cells.withColumn("w", F.col("tokens"))
    for column, target in targets.items():
        state = state.join(target.select(column, F.col("share").alias(f"{column}_share")), column, "left")
    state, done, gap = scratch.write(state.coalesce(1) if small else state), 0, float("inf")
    while done < ROUNDS or (gap > tolerance and done < most):
        now = ROUNDS if small else 1
        new = scratch.write(_rounds(state, list(targets), every, small, now))
        scratch.drop(state)
        state, done = new, done + now
        if done % ROUNDS == 0:
            gap, before = new.agg(F.max("gap")).first()[0] or 0.0, gap
            if done > ROUNDS and before - gap < 1e-6 * gap:
                break
    if gap > tolerance:
        said = f"raking did not settle: a marginal is {gap:.2g} of all tokens from its target after {done} rounds"
        if strict:
            raise ValueError(said)
        logging.getLogger(__name__).warning(said)
    return state.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)).select(*cells.columns, "ratio")


def calibrate(cells: DataFrame, keep: float | None = KEEP) -> DataFrame:
    """Adds ``prob``: min(1, k * ratio), with k such that the expected tokens are ``keep`` of all. Where cells reach 1, the others share what is left, again and again
    until k stands still. Cells that reach 1 fall short of their weight; with ``keep`` None k is the largest with which none does, 1 / max(ratio)."""
    if keep is None:
        top = cells.filter("tokens > 0").agg(F.max("ratio")).first()[0]
        return cells.withColumn("prob", F.least(F.lit(1.0), F.col("ratio") / F.lit(top or 1.0)))
    k = 0.0
    while True:
        full = F.col("ratio") * F.lit(k) >= 1.0  # k only grows
        every, taken, left = cells.agg(F.sum("tokens"), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("ratio")))).first()
        if not left:
            k = k or 1.0
            break
        new = max(0.0, keep * every - taken) / left
        if new <= k * (1 + 1e-12):
            break
        k = new
    return cells.withColumn("prob", F.least(F.lit(1.0), F.lit(k) * F.col("ratio")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
        targets: dict[str, DataFrame] | None = None, alpha: dict[str, float] = ALPHA, keep: float | None = KEEP, salt: str = SALT, tolerance: float = TOLERANCE, strict: bool | None = None) -> DataFrame:
    """One row a row of ``docs``: id_col, source, lang, topic, n_tokens (words), weight, prob, sampled.

    The topic is a word learned from all documents (``topic_words``, ``with_topic``) unless ``topic`` gives another one.
    ``targets``: for source, lang or topic a table (that column, share); where none is given, the token shares tempered
    by ``alpha``. Raking and filling go on until they settle; targets that the cells cannot meet are an error if they were given and a warning if they were tempered (``strict`` says otherwise).
    At ``keep`` 0.9 most cells that should grow are full and targets are missed; with None they are reached in expectation, by fewer documents. weight is the raked ratio of the
    document's cell; prob the calibrated chance of being sampled; sampled is fixed by a hash of the id, so that a
    rerun, or a retried task, samples the same documents. Null is a source, language or topic like others. Null and empty texts have no tokens;
    they are sampled like their cell. A null id is never sampled. Repeated rows count each and share their fate. No documents, no rows."""
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), *([] if topic is None else [topic.cast("string").alias("topic")]), words_of(text).alias("words"))
    rows = (with_topic(rows, topic_words(docs, text)) if topic is None else rows).select("id", "source", "lang", "topic", F.size("words").cast("long").alias("n_tokens"))
    keys = {c: f"{c}_key" for c in ("source", "lang", "topic")}
    rows = scratch.write(rows.withColumn("cell", key_of(*(F.col(c) for c in keys))))
    named = rows.select("cell", "n_tokens", *(key_of(F.col(c)).alias(k) for c, k in keys.items()))
    cells = scratch.write(named.groupBy("cell", *keys.values()).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("n")))
    given = targets or {}
    wanted = {k: given[c].select(key_of(F.col(c)).alias(k), "share") if c in given else scratch.write(tempered(cells, k, alpha[c])) for c, k in keys.items()}
    raked = scratch.write(rake(cells, wanted, scratch, tolerance, strict=bool(given) if strict is None else strict))
    out = lookup(rows, calibrate(raked, keep).select("cell", "n", "ratio", "prob"), "cell", "n", rows.count())
    sampled = F.coalesce(unit_hash(F.col("id"), salt) < F.col("prob"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", F.round("ratio", 6).alias("weight"), F.round("prob", 6).alias("prob"), sampled.alias("sampled"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in SQL: raking and filling as recursion with the same tests of having settled."""
    step = "(SELECT * FROM r)"
    for i, c in enumerate(ALPHA):
        step = f"""(SELECT * REPLACE (CASE WHEN s <= 0 THEN w ELSE w * {c}_share / s * every END AS w, CASE WHEN s <= 0 THEN {"gap" if i else "0"} ELSE greatest({"gap" if i else "0"}, abs(s / every - {c}_share)) END AS gap)
            FROM (SELECT * EXCLUDE s, sum(w) OVER (PARTITION BY {c}) AS s FROM {step}))"""
    shares = " ".join(f"t_{c} AS MATERIALIZED (SELECT {c}, p / sum(p) OVER () AS {c}_share FROM (SELECT {c}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {a}) ELSE 0 END AS p FROM c0 GROUP BY {c}))," for c, a in ALPHA.items())
    joins = " ".join(f"JOIN t_{c} ON c0.{c} IS NOT DISTINCT FROM t_{c}.{c}" for c in ALPHA)
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in ALPHA)
    going = f"it < {ROUNDS} OR (it < {MOST} AND NOT (it % {ROUNDS} = 0 AND (worst <= {TOLERANCE} OR (it > {ROUNDS} AND before - worst < 1e-6 * worst))))"
    return f"""WITH RECURSIVE
    w0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, lang, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS word FROM w0) WHERE length(word) BETWEEN {SHORTEST} AND {LONGEST} GROUP BY word),
    tw AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM df WHERE n > 1 AND n <= (SELECT count(*) // {COMMON} FROM w0) ORDER BY rank LIMIT {TOPICS}),
    hits AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM w0) JOIN tw USING (word) GROUP BY rid, word),
    topics AS (SELECT rid, arg_max(word, n * 1000 + rank) AS topic FROM hits JOIN tw USING (word) GROUP BY rid),
    d AS MATERIALIZED (SELECT w0.rid, doc_id, source, lang, coalesce(topic, '{OTHER}') AS topic, len(words) AS n_tokens FROM w0 LEFT JOIN topics USING (rid)),
    c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL), {shares}
    r AS (SELECT 0 AS it, c0.source, c0.lang, c0.topic, tokens, tokens AS w, sum(tokens) OVER () AS every, {", ".join(f"{c}_share" for c in ALPHA)}, 0.0::DOUBLE AS s, 0.0::DOUBLE AS gap, 'inf'::DOUBLE AS worst, 'inf'::DOUBLE AS before FROM c0 {joins}
        UNION ALL SELECT it + 1, source, lang, topic, tokens, w, every, {", ".join(f"{c}_share" for c in ALPHA)}, s, gap, max(gap) OVER (), CASE WHEN it % {ROUNDS} = 0 THEN worst ELSE before END FROM {step} WHERE {going}),
    p0 AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN w / tokens ELSE 1 END AS ratio FROM r WHERE it = (SELECT max(it) FROM r)),
    f AS (SELECT 0.0::DOUBLE AS k, 0 AS it UNION ALL SELECT CASE WHEN open > 0 THEN greatest(0.0, {KEEP} * every - taken) / open WHEN k > 0 THEN k ELSE 1.0 END AS new, it + 1
        FROM (SELECT k, it, sum(tokens) AS every, sum(CASE WHEN ratio * k >= 1 THEN tokens ELSE 0 END) AS taken, sum(CASE WHEN ratio * k >= 1 THEN 0 ELSE tokens * ratio END) AS open FROM f, p0 GROUP BY k, it)
        WHERE CASE WHEN open > 0 THEN greatest(0.0, {KEEP} * every - taken) / open WHEN k > 0 THEN k ELSE 1.0 END > k * (1 + 1e-12))
    SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(ratio, 6) AS weight, round(least(1.0, ratio * (SELECT max(k) FROM f)), 6) AS prob,
    coalesce(CAST(('0x' || substr(md5(doc_id || '{SALT}'), 1, 8)) AS BIGINT) / 4294967296.0 < least(1.0, ratio * (SELECT max(k) FROM f)), false) AS sampled
    FROM d JOIN p0 ON {same("d", "p0")}"""


ORACLE = _oracle()
