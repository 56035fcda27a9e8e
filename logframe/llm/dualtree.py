"""Exact largest inner products with two cover trees, one of queries and one of vectors."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .vectors import balanced_centres, best, common_length, distinct_vectors, per_row, sample_of, search_lists, usable

#: A node with so few points is not split further.
LEAF = 64
#: Nor one whose points fall into more groups than this at the next level, most of them small.
FAN = 64


class CoverTree:
    """Points under nodes; a node's point covers its descendants, and each level's covers are half as wide.

    Among a node's children, no child's point lies in the cover of a child before it. ``reach`` is the distance of the
    farthest descendant, which is what bounds use.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.centre: list[int] = []
        self.reach: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        rows = np.arange(len(points))
        gaps = self._gaps(0, rows)
        self._grow(0, rows, gaps, float(gaps.max()))

    def _gaps(self, centre: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _grow(self, centre: int, rows: np.ndarray, gaps: np.ndarray, cover: float) -> int:
        node = len(self.centre)
        self.centre.append(centre)
        self.reach.append(float(gaps.max()))
        self.children.append([])
        self.members.append(rows)
        if len(rows) > LEAF and cover > 0:
            cover = min(cover, self.reach[node]) / 2
            groups = []
            # The node's point is the first child's point; then the first point that is not covered yet.
            while len(rows):
                inside = gaps <= cover
                groups.append((centre, rows[inside], gaps[inside]))
                rows = rows[~inside]
                if len(rows) and len(groups) >= FAN:
                    # Points this far from each other have no groups at this level; the node stays a leaf.
                    groups = []
                    break
                if len(rows):
                    centre = int(rows[0])
                    gaps = self._gaps(centre, rows)
            if len(groups) > 1 and sum(len(g[1]) > 1 for g in groups) > len(groups) // 4:
                self.children[node] = [self._grow(*group, cover) for group in groups]
        return node


def dual_search(k: int, exact: bool):
    """The ``k`` largest inner products of each query of a block that reach its floor; ties go to the earlier vector."""

    def search(queries: np.ndarray, floors: np.ndarray, vectors: np.ndarray) -> list:
        asked, known = CoverTree(queries), CoverTree(vectors)
        scores = np.full((len(queries), min(k, len(vectors))), -np.inf)
        places = np.full(scores.shape, -1)
        norms = [np.sqrt((t.points[t.centre] ** 2).sum(axis=1)) for t in (asked, known)]
        reach = [np.array(t.reach) for t in (asked, known)]

        def bounds(a: list[int], b: list[int]) -> np.ndarray:
            """No query below a node of ``a`` has a larger product with a vector below a node of ``b``."""
            products = asked.points[[asked.centre[i] for i in a]] @ known.points[[known.centre[i] for i in b]].T
            wide_a, wide_b = reach[0][a][:, None], reach[1][b]
            most = products + wide_a * norms[1][b] + norms[0][a][:, None] * wide_b + wide_a * wide_b
            return most + 1e-9 * np.abs(most) + 1e-9

        def needed(a: int) -> float:
            """The least that can change a result below a node: its queries' worst k-th score or floor."""
            rows = asked.members[a]
            return float(np.maximum(scores[rows, -1], floors[rows]).min())

        queue = [(-float(bounds([0], [0])[0, 0]), 0, 0)]
        while queue:
            most, a, b = heapq.heappop(queue)
            if -most < needed(a):
                continue
            lower, upper = asked.children[a] or [a], known.children[b] or [b]
            if lower == [a] and upper == [b]:
                rows, own = asked.members[a], known.members[b]
                found = product(queries[rows], vectors[own], exact)
                both = np.concatenate([scores[rows], found], axis=1)
                of = np.concatenate([places[rows], np.broadcast_to(own, found.shape)], axis=1)
                order = np.lexsort((of, -both), axis=1)[:, : scores.shape[1]]
                scores[rows] = np.take_along_axis(both, order, axis=1)
                places[rows] = np.take_along_axis(of, order, axis=1)
                continue
            for i, row in zip(lower, bounds(lower, upper)):
                worst = needed(i)
                for j, value in zip(upper, row):
                    if value >= worst:
                        heapq.heappush(queue, (-float(value), i, j))
        known_rows = np.isfinite(scores)
        return [(p[ok], s[ok].astype(np.int64)) for p, s, ok in zip(places, scores, known_rows)]

    return search


def product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers: in doubles where those hold them exactly, else in 64-bit integers."""
    return a @ b.T if exact else (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


def largest_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 1024,
    most_lists: int = 512,
    sample: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` largest inner products of each query with all vectors, exactly: ``query_id, rank, vec_id, score``.

    Components x count as ``floor(scale * x)``; ties go to the smaller id. ``queries`` has the columns of ``vectors``; a
    vector is no answer to the query of its own id. Null and non-finite vectors, those of another length than the
    commonest, and rows without an id take no part; rows that repeat an id and vector count once. Other columns are
    ignored; empty tables give no rows. Scores must be below 2**53 in size.

    Vectors are dealt to the nearest of some centres. Each query is first answered from its own centre's list, and
    then goes only to the lists that can hold a score above its k-th one so far. In a task, a cover tree of the
    list's vectors and one of its queries are searched together: a pair of nodes is left out if the covering radii
    show that it can't beat the worst k-th score among the node's queries.
    """
    whole = F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * scale).cast("double") + F.lit(0.0))
    valid = lambda frame: frame.filter(usable(F.col(vector_column), True)).select(
        F.col(id_column).cast("long").alias("vec_id"), whole.alias("vector")
    )
    entries = stored(distinct_vectors(common_length(valid(vectors)), k + 1), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    about = entries.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(F.size("vector")).alias("size")).first()
    asked = valid(queries).filter("vec_id IS NOT NULL").distinct().filter(F.size("vector") == (about["size"] or 0))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("double").alias("floor"), "vector")
    points = sample_of(entries.select("vector"), sample, seed)
    if not len(points):
        return asked.selectExpr("query_id", "1 AS rank", "query_id AS vec_id", "CAST(floor AS LONG) AS score").limit(0)
    exact = about.square < 2.0**53
    centres = balanced_centres(points, max(1, min(most_lists, about.n // 1024)), seed)

    def own(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nearest = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        return np.arange(len(rows)), nearest

    lists = stored(per_row(entries, own), "lists")
    first = stored(per_row(asked, own), "routed")
    # One more, as a query may find its own vector.
    search = dual_search(k + 1, exact)
    answers = stored(search_lists(lists, first, k, search, "long"), "answers")

    # How far each list's vectors are from its centre: one row for each list.
    middle = first.sparkSession.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "list long, middle array<double>")
    gap = F.aggregate(F.zip_with("vector", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)
    wide = {r.list: r.reach for r in lists.join(middle, "list").groupBy("list").agg(F.sqrt(F.max(gap)).alias("reach")).collect()}
    reach = np.array([wide.get(n, -np.inf) for n in range(len(centres))])

    ranked = best(answers, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floor = F.when(F.col("n") == k, F.col("least").cast("double")).otherwise(F.lit(None).cast("double"))
    again = first.drop("floor").withColumnRenamed("list", "own").join(ranked, "query_id", "left")
    again = again.select("query_id", floor.alias("floor"), "own", "vector")

    def others(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The last two components are the floor and the own list.
        rows, floors, lists_ = rows[:, :-2], rows[:, -2], rows[:, -1].astype(np.int64)
        most = rows @ centres.T + np.sqrt((rows**2).sum(axis=1))[:, None] * reach
        possible = (most + 1e-9 * np.abs(most) + 1e-9 >= floors[:, None]) & np.isfinite(reach)
        possible[np.arange(len(rows)), lists_] = False
        return np.nonzero(possible)

    packed = F.concat("vector", F.array(F.coalesce("floor", F.lit(float("-inf"))), F.col("own").cast("double")))
    routed = per_row(again.select("query_id", "floor", packed.alias("vector")), others)
    routed = routed.withColumn("vector", F.slice("vector", 1, F.size("vector") - 2))
    more = search_lists(lists, stored(routed, "routed"), k, search, "long")
    return best(answers.unionByName(more), k)
