import math
from collections import Counter

import numpy as np
import pytest

from octetflow.llm.langid import ALPHABET, KneserNey, fit, identify, letters, op7_langid

DATA = "/root/testdata/sf0.01"


def counts(text, order):
    line = " " * (order - 1) + letters(text)
    return Counter(line[k : k + order] for k in range(len(line) - order + 1))


def slow(counts_of, order, line):
    """Log probability of a line by the textbook recursion."""
    kn = {order: counts_of}
    for n in range(order - 1, 0, -1):
        kn[n] = Counter(g[1:] for g in kn[n + 1])

    def p(g):
        if not g:
            return 1 / ALPHABET
        c, x = kn[len(g)], g[:-1]
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        after = [v for k, v in c.items() if k[:-1] == x]
        if not after:
            return p(g[1:])
        return max(0.0, c[g] - d) / sum(after) + d * len(after) / sum(after) * p(g[1:])

    padded = " " * (order - 1) + line
    return sum(math.log(p(padded[k : k + order])) for k in range(len(padded) - order + 1))


@pytest.mark.parametrize("order", [2, 4])
def test_same_as_textbook(order):
    texts = {"a": "the cat sat on the mat and the rat", "b": "die Katze saß auf der Matte, dort"}
    model = KneserNey({k: counts(t, order) for k, t in texts.items()}, order)
    for t in ["the rat", "Katze", "zzz qqq", "ö", "the the the", "cat saß x漢字"]:
        e, n = model.entropies(t)
        line = letters(t)
        assert n == len(line)
        assert e == pytest.approx([-slow(counts(texts[k], order), order, line) / n for k in "ab"], rel=1e-5)


def test_probabilities_sum_to_one():
    text = "abracadabra bar"
    c = counts(text, 3)
    chars = set("".join(c)) | {"q"}
    for ctx in ["ab", "zz", " a"]:
        total = sum(math.exp(slow(c, 3, ctx + x) - slow(c, 3, ctx)) for x in chars)
        assert total < 1 + 1e-9


def test_long_text_in_parts():
    model = KneserNey({"a": counts("the cat sat", 4), "b": counts("der Hund", 4)}, 4)
    t = "the hund sat " * 45_000
    e, n = model.entropies(t)
    h = len("the hund sat ") * 1000
    small, m = model.entropies(t[:h])
    assert n > 1 << 19 and np.allclose(e, small, rtol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = op7_langid(spark, DATA).join(docs, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and 250 < len(held) < 400
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all() and held.accepted.mean() > 0.9
    assert held[held.lang_pred == held.lang].score.mean() > 0.9


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, t, la, "c") for i, (t, la) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)] + [(100, "x", None, None), (101, None, "en", None), (None, "the", "en", None)]
    train = spark.createDataFrame(rows, schema)
    model = fit(train)
    odd = spark.createDataFrame([(1, None, "en", "c"), (2, "", None, None), (3, "123 ?! 😀 ½ ²", None, None), (4, "the", None, None), (4, "the", None, None), (None, "Hund", None, None), (5, "the cat " * 100_000, None, None)], schema)
    got = sorted(((r.doc_id, r.lang_pred) for r in identify(odd, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "en")], key=str)
    assert identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(train.limit(0))).collect()} == {"und"}


def test_languages_are_bounded_and_small_ones_learned(spark):
    rows = [(i, text, lang, "c") for i, (text, lang) in enumerate([("the cat and the dog", "en")] * 12 + [("der Hund und die Katze", "de")] * 9 + [("il gatto e il cane", "it")])]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    assert fit(train).model.langs == ["de", "en", "it"]  # one document is enough to be learned
    assert fit(train, langs=2).model.langs == ["de", "en"]
