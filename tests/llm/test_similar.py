import random

import numpy as np
import pytest

from octetflow.llm import similar
from octetflow.llm.similar import similar_groups

SCHEMA = "doc_id long, text string, fp string, component_id string, token string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def corpus():
    """Unrelated texts, copies with edits at, above and below the similarity, chains, a shared passage, and short texts."""
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        base = words(r.choice([8, 20, 60, 200]))
        texts.append(base)
        for edits in (1, 2, 3, 4, 6):
            other = list(base)
            for _ in range(edits):
                other[r.randrange(len(other))] = f"x{r.randrange(10**6)}"
            texts.append(other)
    chain = words(120)
    for k in range(30):  # each like the one before, far from the first
        chain = list(chain)
        chain[(4 * k) % 120] = f"c{k}"
        texts.append(chain)
    passage = words(60)
    texts += [passage + words(r.choice([3, 8, 12, 20])) for _ in range(60)]
    texts += [["only"], ["Only"], ["a", "b"], [], ["same"] * 50, ["same"] * 60]
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, " ")]


@pytest.mark.parametrize("cell", [512, 7])
def test_groups_match_brute_force(spark, cell):
    rows = corpus()
    got = {r.doc_id: r for r in similar_groups(spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], SCHEMA), cell=cell).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.group_size == sum(v == want[i] for v in want.values()) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 40


def test_edges(spark):
    assert similar_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", None, None, None), (7, "a b c", None, None, None), (7, "a b c", None, None, None), (3, "A B C", None, None, None), (8, "Word " * 100_000, None, None, None)]
    got = sorted(((r.doc_id, r.component_id, r.group_size) for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, None, None), (7, 3, 3), (7, 3, 3), (3, 3, 3), (8, 8, 1)], key=str)


@pytest.mark.parametrize("room", [similar.ROOM, 2000])
def test_a_large_group_makes_no_table_of_its_pairs(spark, monkeypatch, room):
    """Copies of a text that is not there itself, about as far from each other as the similarity allows: some pairs are links, most nearly are."""
    r = random.Random(3)
    base, rows, written, write = [f"w{r.randrange(4000)}" for _ in range(200)], [], [], similar.Scratch.write
    for i in range(400):
        text = list(base)
        for _ in range(3):
            text[r.randrange(len(text))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(text), "c", "c", "c"))

    def counted(self, df, *more):
        out = write(self, df, *more)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(similar.Scratch, "write", counted)
    monkeypatch.setattr(similar, "ROOM", room)
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([(i, t) for i, t, *_ in rows])
    assert got == want and 1 < len(set(want.values())) < 300
    assert max(written) < 20 * len(rows)


def test_overlaps(monkeypatch):
    monkeypatch.setattr(similar, "_CHUNK", 10)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 30, n)).astype(np.uint64) for n in (3, 0, 40, 8, 0, 1, 25)]
    for own in sets:
        assert similar._overlaps(own, sets).tolist() == [len(np.intersect1d(own, s)) for s in sets]
