import duckdb
import pandas as pd
import pytest

from octetflow.llm.common import Scratch
from octetflow.llm.mixing import ALPHA, ORACLE, OTHER, TOLERANCE, calibrate, mix, rake, tempered, topic_words, with_topic

SCHEMA = "doc_id long, text string, lang string, source string, prob string, cell string"


def rows(n=400):
    out = []
    for i in range(n):
        text = ["plain words here " * (i % 7 + 1), "a | b | c | d", "x=1 y", "mail me @home", "WOW!! YES!!", "10%%% off"][i % 6]
        out.append((i, text, ["en", "en", "en", "de", "fr"][i % 5], "hot" if i % 3 else f"s{i % 11}", "clash", "clash"))
    return out


def test_raked_marginals_meet_their_targets(spark):
    cells = spark.createDataFrame([(s, la, float(10 + 7 * i + 3 * j)) for i, s in enumerate("abc") for j, la in enumerate("xy")], "source string, lang string, tokens double")
    want = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, share double")}
    got = rake(cells, want, Scratch(spark, "t")).toPandas()
    got["w"] = got.tokens * got.ratio
    all_ = got.tokens.sum()
    assert dict(got.groupby("source").w.sum() / all_) == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2}, rel=1e-6)
    assert dict(got.groupby("lang").w.sum() / all_) == pytest.approx({"x": 0.1, "y": 0.9}, rel=1e-6)


def test_same_as_sql_with_nulls_and_repeats(spark):
    data = rows() + [(900, None, None, "hot", None, None), (901, "", "en", None, None, None), (902, "word " * 50_000, "xx", "big", None, None), (3, "again", "en", "hot", None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df).toPandas().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    documents = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "prob", "cell"])  # noqa: F841
    want = duckdb.sql(ORACLE).df().sort_values(["doc_id", "n_tokens"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, atol=2e-6)
    expected = (got.prob * got.n_tokens).sum()
    assert expected == pytest.approx(0.9 * got.n_tokens.sum(), rel=1e-3)


def test_empty_and_null_id(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    (r,) = mix(spark.createDataFrame([(None, "a b", "en", "s", None, None)], SCHEMA), keep=1.0).collect()
    assert not r.sampled and r.n_tokens == 2


def skewed(spark, off):
    """A hot source with a third of the tokens; each source almost in one language and one topic."""
    cells = []
    for s in range(12):
        for la in range(4):
            for t in range(5):
                near = ((1 - off) if la == s % 4 else off / 3) * ((1 - off) if t == s % 5 else off / 4)
                cells.append((f"s{s}", f"l{la}", f"t{t}", 1e6 * near * (1 / 3 if s == 0 else 2 / 33)))
    return spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")


def test_raking_goes_on_until_skewed_cells_meet_their_targets(spark, caplog):
    cells = skewed(spark, 0.05)
    want = {c: tempered(cells, c, a) for c, a in ALPHA.items()}
    got = rake(cells, want, Scratch(spark, "t")).toPandas()
    for c in want:
        share = (got.tokens * got.ratio).groupby(got[c]).sum() / got.tokens.sum()
        target = want[c].toPandas().set_index(c).share
        assert (share - target).abs().max() <= 2 * TOLERANCE
    assert not caplog.records


def test_targets_that_cannot_be_met_are_reported(spark, caplog):
    cells = spark.createDataFrame([("a", "x", 30.0), ("b", "y", 70.0)], "source string, lang string, tokens double")
    want = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, share double")}
    assert rake(cells, want, Scratch(spark, "t")).count() == 2
    assert "did not settle" in caplog.text and "0.4" in caplog.text
    with pytest.raises(ValueError, match="did not settle"):
        rake(cells, want, Scratch(spark, "t"), strict=True)


def test_filling_goes_on_until_the_sum_is_right(spark):
    cells = spark.createDataFrame([(1.0, 2.0**i) for i in range(40)], "tokens double, ratio double")
    assert calibrate(cells, 0.9).selectExpr("sum(tokens * prob) / sum(tokens)").first()[0] == pytest.approx(0.9, abs=1e-9)


def test_keys_cannot_clash_and_nulls_are_values_of_their_own(spark):
    rows = [(1, "a b", "c", "x\x01y", "", ""), (2, "a b c", "y\x01c", "x", "", ""), (3, "a", None, "(none)", "", ""), (4, "a b c d", "(none)", None, "", ""), (5, "a b", "-", "1:x", "", "")]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.source, r.lang) for r in got) == [(i, s, la) for i, _, la, s, _, _ in rows]


def test_topics_are_learned_from_all_documents(spark):
    rows = [(i, ("Harbour ships " if i % 30 == 0 else "football goals goals " if i % 30 == 1 else "") + f"common words here number{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    topics = topic_words(df, df.text, topics=3)
    assert topics == ["football", "goals", "harbour"]  # 20 documents each; common words are in too many, numbers in too few
    from octetflow.llm.mixing import words_of

    got = {r.doc_id: r.topic for r in with_topic(df.select("doc_id", words_of(df.text).alias("words")), topics).collect()}
    assert got[0] == "harbour" and got[1] == "goals" and got[2] == OTHER
    assert topic_words(df.limit(0), df.text) == []


def test_sampled_marginals_meet_their_targets_where_no_cell_is_full(spark):
    langs, sources = ["en"] * 6 + ["de", "de", "fr"], ["hot"] * 3 + ["a", "b"]
    df = spark.createDataFrame([(i, "w " * 20, langs[i % 9], sources[i // 9 % 5]) for i in range(9000)], "doc_id long, text string, lang string, source string")
    whole, most = (mix(df, keep=k).toPandas() for k in (None, 0.9))
    gaps = []
    for got in (whole, most):
        took = got[got.sampled].groupby("lang").n_tokens.sum() / got[got.sampled].n_tokens.sum()
        have = got.groupby("lang").n_tokens.sum() ** ALPHA["lang"]
        gaps.append((took - have / have.sum()).abs().sum())
    assert gaps[0] < 0.03 < gaps[1]
