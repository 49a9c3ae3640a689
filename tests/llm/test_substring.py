import hashlib
import random

import pytest

from octetflow.llm.substring import substring_dedup

SCHEMA = "doc_id long, text string, id string, covered string, n long"


def brute(rows, window):
    docs = [(i, (t or "").split()) for i, t in rows]
    least = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in docs:
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def texts(seed, words):
    r = random.Random(seed)
    pick = lambda n: [f"w{r.randrange(words)}" for _ in range(n)]
    shared = [pick(r.randint(20, 160)) for _ in range(5)]
    out = []
    for _ in range(60):
        t = []
        for _ in range(r.randint(0, 5)):
            s = r.choice(shared)
            lo = r.randrange(len(s))
            t += pick(r.randint(0, 60)) + s[lo : lo + r.randint(1, 160)]
        out.append(" ".join(t))
    out += [out[3], out[7] + " more", "x " + out[9], "a " * 500, "a " * 300, "b a " * 200, "", None, " ".join(pick(49)), " ".join(pick(50))]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "words", "window", "gram"), [(1, 5000, 50, 16), (2, 2, 20, 6), (3, 30, 50, 16)])
def test_same_as_brute_force(spark, seed, words, window, gram):
    rows = texts(seed, words)
    df = spark.createDataFrame([(i, t, "c", "c", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window=window, gram=gram).collect()}
    assert got == brute(rows, window)
    assert any(v[1] for v in got.values())


def test_edges(spark):
    long = " ".join(f"k{i}" for i in range(60_000))
    rows = [(5, long, None, None, None), (9, "start " + long, None, None, None), (9, "start " + long, None, None, None), (None, long, None, None, None), (2, "é x \x1c y", None, None, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text[:20]) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()), key=str)
    assert got == sorted([(5, 60_000, 0, long[:20]), (9, 60_001, 60_000, "start"), (9, 60_001, 60_000, "start"), (None, 60_000, 0, long[:20]), (2, 3, 0, "é x \x1c y")], key=str)
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
