import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import dualtree, vectors as shared
from logframe.llm.ann import CentreGraph, nearest_neighbours, top_products
from logframe.llm.dualtree import CoverTree, dual_search, largest_products
from logframe.llm.vectors import balanced_centres

RNG = np.random.default_rng(4)
SCHEMA = "vec_id long, embedding array<float>, label int, list int, ids string, vector string"


def brute_force(rows, queries, k, score):
    out = []
    for q, v in queries:
        found = sorted(((-score(v, w), i) for i, w in rows if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def clean(rows, zeros):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    return sorted((i, v) for i, v in good if len(v) == 8 and (zeros or any(v)))


@pytest.fixture(scope="module")
def rows():
    data = RNG.normal(size=(900, 8)).astype(np.float32)
    data[300:420] = data[300]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    rows += [(5, rows[5][1]), (2000, None), (2020, []), (2040, [0.0] * 8), (2060, [None] * 8), (2080, [float("nan")] * 8)]
    return rows + [(2100, [float("inf")] + [0.0] * 7), (2120, [1.0] * 3), (None, [1.0] * 8)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, v, None, 1, "own", "own") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("block", [4096, 50])
def test_posting_lists(table, rows, monkeypatch, block):
    monkeypatch.setattr(shared, "VECTOR_BLOCK", block)
    good = clean(rows, False)
    wanted = brute_force(good, [r for r in good if r[0] % 20 == 0], 20, lambda a, b: float(np.dot(a, b)))
    got = sorted(map(tuple, nearest_neighbours(table, table.filter("vec_id % 20 = 0"), 20, list_size=40).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    hits = {(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in wanted}
    assert len(hits) >= 0.9 * len(wanted)
    scores = {(w[0], w[2]): w[3] for w in brute_force(good, good, 1000, lambda a, b: float(np.dot(a, b))) if w[0] % 20 == 0}
    assert all(g[3] == pytest.approx(scores[g[0], g[2]], rel=1e-12) for g in got)
    everything = nearest_neighbours(table, table.filter("vec_id % 20 = 0"), 20, list_size=40, prune=1e9)
    assert [r[:3] for r in sorted(map(tuple, everything.collect()))] == [w[:3] for w in wanted]


@pytest.mark.parametrize("ones", [False, True])
def test_posting_lists_are_exact(spark, ones):
    """With far more lists than are looked at first, and with scores of which many tie."""
    data = RNG.integers(0, 2, (1500, 6)) if ones else RNG.normal(size=(1500, 32))
    data[:, 0] += 1
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    asked = rows[::50]
    wanted = brute_force(rows, asked, 20, lambda a, b: float(np.dot(a, b)))
    columns = "vec_id long, embedding array<double>"
    got = nearest_neighbours(spark.createDataFrame(rows, columns), spark.createDataFrame(asked, columns), 20, list_size=5)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [w[:3] for w in wanted]


def test_ties_beyond_the_k_th_score():
    vectors = np.concatenate([np.ones((40, 3)), [[2.0, 1.0, 1.0]]])
    places, scores = top_products(5)(np.ones((1, 3)), np.array([-np.inf]), vectors)[0]
    assert places.tolist() == [40, 0, 1, 2, 3] and scores.tolist() == [4.0, 3.0, 3.0, 3.0, 3.0]


@pytest.mark.parametrize("block", [4096, 30])
def test_dual_tree(table, rows, monkeypatch, block):
    monkeypatch.setattr(shared, "VECTOR_BLOCK", block)
    monkeypatch.setattr(dualtree, "LEAF", 8)
    whole = [(i, tuple(np.floor(np.array(v, np.float64) * 1024).astype(int))) for i, v in clean(rows, True)]
    wanted = brute_force(whole, [r for r in whole if r[0] % 100 == 0 or r[0] == 310], 10, lambda a, b: int(np.dot(a, b)))
    got = largest_products(table, table.filter("vec_id % 100 = 0 OR vec_id = 310"), 10)
    assert sorted(map(tuple, got.collect())) == wanted


def test_few_and_no_vectors(spark, table):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    for search in (nearest_neighbours, largest_products):
        got = search(few, few.filter("vec_id % 20 = 0"), 20).select("query_id", "rank", "vec_id").collect()
        assert sorted(map(tuple, got)) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
        assert search(few.limit(0), few.limit(0)).count() == 0
        assert search(few, few.limit(0)).count() == 0


def test_graph_finds_nearest_centres():
    points = RNG.normal(size=(3000, 16))
    centres = balanced_centres(points, 200, 1)
    assert centres.shape == (200, 16)
    found, squares = CentreGraph(centres).nearest(points[:200], 10)
    exact = ((points[:200, None] - centres) ** 2).sum(axis=2)
    assert np.mean([len(set(f) & set(e)) for f, e in zip(found, np.argsort(exact, axis=1)[:, :10])]) > 9
    assert np.allclose(np.take_along_axis(exact, found, axis=1), squares)


def test_cover_tree_covers(monkeypatch):
    monkeypatch.setattr(dualtree, "LEAF", 4)
    centres = RNG.normal(size=(6, 3)) * 50
    points = np.concatenate([c + RNG.normal(size=(60, 3)) for c in centres] + [np.repeat(centres[:1], 20, axis=0)])
    tree = CoverTree(points)
    assert len(tree.centre) > 6
    for node, rows in enumerate(tree.members):
        gaps = np.sqrt(((points[rows] - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert gaps.max() <= tree.reach[node] + 1e-9
        if tree.children[node]:
            assert sorted(np.concatenate([tree.members[c] for c in tree.children[node]])) == sorted(rows)
    queries = np.round(points[::9])
    for (places, scores), q in zip(dual_search(5, True)(queries, np.full(len(queries), -np.inf), np.round(points)), queries):
        every = np.round(points) @ q
        assert np.array_equal(np.sort(scores)[::-1], np.sort(every)[::-1][:5])
        assert list(places) == list(np.lexsort((np.arange(len(every)), -every))[:5])
