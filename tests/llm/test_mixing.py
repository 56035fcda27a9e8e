import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logframe.llm.mixing import FlowNetwork, fair_targets, mix, mixed_rows, route

from .conftest import frame


def test_documents_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        total[r.sources[0]] += r.size
        taken[r.sources[0]] += r.taken
        target[r.sources[0]] = r.target
    assert all(r.source_size == total[r.sources[0]] for r in rows)
    assert sum(target.values()) == pytest.approx(sum(total.values()))
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_targets():
    assert fair_targets([10, 10, 10], [5, 2, 1], 3, 30) == [18.75, 7.5, 3.75]
    # The first stops at 3 times its size; what is above goes to the others, of which the second stops too.
    assert fair_targets([1, 2, 100], [5, 2, 1], 3, 103) == [3.0, 6.0, 94.0]
    assert fair_targets([0, 5], [5, 2], 3, 5) == [0.0, 5.0]
    assert fair_targets([], [], 3, 0) == [] and fair_targets([0], [1], 3, 0) == [0.0]


def test_flow_is_cheapest():
    """Against all ways to split small sizes."""
    patterns, sizes, quotas = [[0], [0, 1], [1, 2]], [2, 2, 3], [4, 3, 2]
    plan = route(patterns, sizes, quotas, 3)
    cost = lambda taken: sum(max(0, t - k * n) * 1 for t, n in zip(taken, sizes) for k in (1, 2))
    best = None
    for a, b0, b1, c1, c2 in itertools.product(range(7), range(7), range(7), range(10), range(10)):
        if a <= 6 and b0 + b1 <= 6 and c1 + c2 <= 9 and a + b0 <= 4 and b1 + c1 <= 3 and c2 <= 2:
            key = (-(a + b0 + b1 + c1 + c2), cost((a, b0 + b1, c1 + c2)))
            best = key if best is None or key < best else best
    assert (-sum(plan.taken), cost(plan.taken)) == best
    for s, quota in enumerate(quotas):
        assert sum(n for (_, t), n in plan.routed.items() if t == s) <= quota
    net = FlowNetwork(2)
    net.send(0, 1)


def test_overlapping_sources(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(k, words(10 + k % 5)) for k in range(300)]
    docs = frame(spark, rows).withColumn(
        "of", F.expr("CASE doc_id % 3 WHEN 0 THEN array('a') WHEN 1 THEN array('b', 'a', 'b') ELSE array('c', NULL) END")
    )
    got = mix(docs, "of").collect()
    assert {tuple(r.sources) for r in got} == {("a",), ("a", "b"), ("c", None)}
    # Together about as many words are taken as there are.
    assert sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.02)


def test_edges(edges, nothing):
    got = mix(edges).collect()
    assert len(got) == edges.count() and {tuple(r.sources) for r in got} == {("a",), (None,)}
    assert all(r.taken <= 3 * r.size for r in got)
    rows = mixed_rows(edges)
    assert rows.columns == edges.columns
    assert rows.count() == sum(r.copies for r in got)
    assert mix(nothing).count() == 0 and mixed_rows(nothing).count() == 0


@pytest.mark.parametrize("ids", ["none", "one", "third"])
def test_rows_that_share_id_and_size(spark, ids):
    """Rows without ids, with one id, or a third without: m of n equal rows are taken, and reruns agree."""
    words = lambda n: " ".join(["w"] * n)
    of = {"none": lambda k: None, "one": lambda k: 7, "third": lambda k: k if k % 3 else None}[ids]
    rows = [(of(k), words(12), f"s{k % 3}") for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.sources[0]] += r.taken
        target[r.sources[0]] = r.target
        assert r.copies <= 3
    assert len(got) == 1800 and all(abs(taken[s] - t) <= 12 for s, t in target.items())
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(3)).collect()))
    assert mixed_rows(docs).count() == sum(r.copies for r in got)


def test_too_many_patterns(spark):
    docs = frame(spark).withColumn("source", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="sets of sources"):
        mix(docs, most_patterns=3)
