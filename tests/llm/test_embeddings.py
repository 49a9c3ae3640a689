import numpy as np
import pytest

from octetflow.llm.embeddings import CapCode, near_embeddings


def clusters(seed, n, dim=24, noise=0.06):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, dim))
    x = np.concatenate([centres[rng.integers(0, len(centres), n // 2)] + noise * 5 * rng.standard_normal((n // 2, dim)), rng.standard_normal((n - n // 2, dim))])
    x[1] = x[0]
    return x.astype(np.float32).astype(float)


def brute(x, cosine=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return near, root
        root = new


@pytest.mark.parametrize("cell", [1024, 16])
def test_recall_and_no_false_links(spark, cell):
    x = clusters(1, 600)
    near, root = brute(x)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, "c") for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int, id string")
    got = {r.vec_id: r for r in near_embeddings(df, cell=cell).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert len(got) == len(x) and (n <= near.sum(1)).all()
    assert n.sum() >= 0.97 * near.sum()
    same = np.array([got[i].component_id for i in range(len(x))])
    assert (same >= root).all() and (same == root).mean() > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    dim, n = 64, 1500
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((n, dim))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * o
    for size in (500, 50_000):
        code = CapCode(dim, size)
        hits = [set() for _ in range(n)]
        for r, f in zip(*code.decode(a), strict=True):
            hits[r].add(f)
        met = np.zeros(n, bool)
        for r, f in zip(*code.decode(b), strict=True):
            met[r] |= f in hits[r]
        assert met.mean() > 0.97


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_embeddings(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (9, 3, 1, False), (9, 3, 1, False), (None, 0, None, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11)]
    assert got == sorted(want, key=str)
    assert near_embeddings(df.limit(0)).count() == 0


def test_one_id_for_different_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.component_id) for r in near_embeddings(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_recall_at_the_threshold_of_large_tables():
    rng = np.random.default_rng(0)
    dim, n = 64, 200
    a, o = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * o / np.linalg.norm(o, axis=1, keepdims=True)
    for size in (4_500_000, 20_000_000):
        code, met = CapCode(dim, size), 0
        for lo in range(0, n, 10):
            pairs = [set(zip(*(x.tolist() for x in code.decode(v[lo : lo + 10])), strict=True)) for v in (a, b)]
            met += len({r for r, _ in pairs[0] & pairs[1]})
        assert met / n > 0.97


def test_dense_clusters_are_counted_exactly_without_comparing_their_members(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(24)
    x = np.concatenate([centre + 0.05 * rng.standard_normal((3000, 24)), centre + 0.55 * rng.standard_normal((300, 24)), rng.standard_normal((200, 24))]).astype(np.float32).astype(float)
    near, root = brute(x)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_embeddings(df, cell=256).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= near.sum(1)).all() and (n[:3000] >= 2999).all() and n.sum() >= 0.99 * near.sum()
    assert np.mean([got[i].component_id == root[i] for i in got]) > 0.99


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e-300, 0.0]), (3, [5e-324, 0.0]), (4, [0.0, 1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
