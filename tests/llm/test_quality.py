import numpy as np
import pytest

from octetflow.llm.quality import FEATURES, classify, features

SCHEMA = "doc_id long, text string, lang string, source string, p string, n string"
DATA = "/root/testdata/sf0.01"


def test_features_are_whole_text_and_finite():
    for t in [None, "", " \n", "a", "Word " * 100_000, "x" * 200_000, "É!! ### | 1\n" * 50]:
        f = features(t)
        assert len(f) == len(FEATURES) and np.isfinite(f).all()
    assert features("a " * 1000 + "### " * 1000) != features("a " * 1000)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = classify(docs, labels.filter("doc_id % 2 = 0")).toPandas().set_index("doc_id")
    assert len(got) == docs.count()
    held = labels.filter("doc_id % 2 = 1").toPandas().set_index("doc_id")
    p = got.loc[held.index]
    assert (p.kept == (held.quality == 1)).mean() > 0.97
    assert p.kept[held.quality == 1].mean() > 0.99


def test_sites_match_brute_force_and_sparse_ones_shrink(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = classify(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").toPandas()
    got["micro"] = (got.p_doc * 1e6).round() / 1e6
    prior = got.micro.mean()
    for key, parent, column in ((["source"], None, "host_posterior"), (["source", "lang"], "host_posterior", "path_posterior")):
        got["parent"] = prior if parent is None else got[parent]
        g = got.groupby(key).agg(s=("micro", "sum"), n=("micro", "size"), up=("parent", "first"), post=(column, "first"))
        m = g[g.n > 1]
        spread, noise, within = ((m.s / m.n - m.up) ** 2).mean(), (m.up * (1 - m.up) / m.n).mean(), (m.up * (1 - m.up)).mean()
        k = min(1000.0, max(1.0, within / (spread - noise) - 1)) if spread > noise else 1000.0
        assert np.allclose(g.post, (g.s + k * g.up) / (g.n + k))


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "good words here", "en", "s", "x", "x"), (1, "good words here", "en", "s", "x", "x"), (2, None, None, None, None, None), (None, "", "", "", "", ""), (3, "w " * 90_000, "en", None, "", "")]
    out = classify(spark.createDataFrame(rows, SCHEMA), labels)
    assert out.count() == 5 and out.filter("quality is null or kept is null").count() == 0
    assert classify(spark.createDataFrame([], SCHEMA), labels).count() == 0
    none = classify(spark.createDataFrame(rows, SCHEMA), labels.limit(0)).collect()
    assert len(none) == 5 and all(r.kept and r.p_doc == pytest.approx(0.5) for r in none)


def test_whole_result_matches_brute_force(spark):
    """p_doc, quality and kept of every document, from the texts and labels alone."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = classify(docs, labels).toPandas().set_index("doc_id").sort_index()
    d = docs.toPandas().set_index("doc_id").sort_index()
    x = np.array([features(t) for t in d.text])
    y = labels.toPandas().groupby("doc_id").quality.mean()
    fit = d.index.isin(y.index)
    z, t = x[fit], (y.loc[d.index[fit]].to_numpy() > 0.5).astype(float)
    mean, std = z.mean(0), z.std(0)
    std[std < 1e-9] = 1.0
    z, w, c = (z - mean) / std, np.zeros(x.shape[1]), 0.0
    for _ in range(60):  # ridge of 1 on standardised features
        p = 1 / (1 + np.exp(-(z @ w + c)))
        a = np.column_stack([z, np.ones(len(z))])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1.0] * len(w) + [1e-6]), a.T @ (t - p) - np.r_[w, 0.0])
        w, c = w + step[:-1], c + step[-1]
    d["p"] = 1 / (1 + np.exp(-np.clip((x - mean) / std @ w + c, -30, 30)))
    assert np.allclose(got.p_doc, d.p, atol=1e-5)
    d["m"] = (got.p_doc * 1e6).round() / 1e6
    prior = d.m.mean()

    def shrunk(key, up):
        g = d.assign(up=up).groupby(key).agg(s=("m", "sum"), n=("m", "size"), up=("up", "first"))
        m = g[g.n > 1]
        gap = ((m.s / m.n - m.up) ** 2).mean() - (m.up * (1 - m.up) / m.n).mean()
        k = min(1000.0, max(1.0, (m.up * (1 - m.up)).mean() / gap - 1)) if gap > 0 else 1000.0
        back = lambda c: g[c].reindex(d.set_index(key).index).to_numpy()
        return back("s"), back("n"), k

    s, n, k = shrunk(["source"], prior)
    host = (s + k * prior) / (n + k)
    s, n, k = shrunk(["source", "lang"], host)
    others = (np.maximum(0.0, s - got.p_doc) + k * host) / (n - 1 + k)
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    quality = 1 / (1 + np.exp(-(logit(got.p_doc) + logit(others) - logit(prior))))
    assert np.allclose(got.quality, quality, atol=1e-5)
    assert (got.kept == (quality >= 0.5)).all()


def test_fit_is_bounded_whatever_repeats_there_are(spark, monkeypatch):
    from octetflow.llm import quality

    seen = []
    fit = quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, y, *a: seen.append(len(x)) or fit(x, y, *a))
    rows = [(i % 3, f"word {i} here" if i % 3 else "### !! ###", "en", "s", "x", "x") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 3 > 0, 0) for i in [0, 1, 2] * 5], "doc_id long, quality boolean, toxic int")
    assert classify(spark.createDataFrame(rows, SCHEMA), labels, fit_rows=2).count() == 900
    assert classify(spark.createDataFrame(rows, SCHEMA), labels, fit_rows=10).count() == 900
    assert all(n <= 3 for n in seen) and seen[-1] == 3


def test_sites_are_not_mixed_up(spark):
    rows = [(1, "a b", "c", "x\x01y", "", ""), (2, "a b", "y\x01c", "x", "", ""), (3, "a b", None, "x", "", ""), (4, "a b", "-", "x", "", "")]
    out = classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.count() == 4
