"""Approximate nearest neighbours with balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .vectors import (
    VECTOR_BLOCK,
    balanced_centres,
    best,
    common_length,
    distinct_vectors,
    matrix,
    per_row,
    sample_of,
    search_lists,
    usable,
)


class CentreGraph:
    """Centres as nodes, linked to their nearest ones both ways; searched best first from spread-out entries."""

    def __init__(self, centres: np.ndarray, links: int = 16) -> None:
        self.centres = centres
        n, links = len(centres), min(links, len(centres) - 1)
        self.gaps = distances(centres, centres)
        near = np.argsort(self.gaps + np.diag(np.full(n, np.inf)), axis=1, kind="stable")[:, :links]
        rng = np.random.default_rng(3)
        # Each node also links to its neighbours' side and to a few far nodes, so that all can be reached.
        self.links = np.concatenate([near, rng.integers(0, n, (n, 4))], axis=1)
        self.entries = rng.choice(n, min(n, 8), replace=False)

    def nearest(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centres found for each point, and their squared distances; -1 where there are fewer."""
        n, count = len(points), len(self.centres)
        beam = min(beam, count)
        norms = (self.centres**2).sum(axis=1)
        rows = np.arange(n)[:, None]
        seen, open_ = np.zeros((n, count), bool), np.full((n, count), False)
        known = np.full((n, count), np.inf)

        def look(nodes: np.ndarray) -> None:
            fresh = ~seen[rows, nodes]
            values = norms[nodes] - 2 * np.einsum("nd,nkd->nk", points, self.centres[nodes])
            known[rows, nodes] = np.where(fresh, values, known[rows, nodes])
            open_[rows, nodes] |= fresh
            seen[rows, nodes] = True

        look(np.broadcast_to(self.entries, (n, len(self.entries))))
        for _ in range(count):
            # The worst value that still belongs to the beam.
            worst = np.partition(known, beam - 1, axis=1)[:, beam - 1]
            waiting = np.where(open_, known, np.inf)
            step = np.argsort(waiting, axis=1)[:, : max(1, beam // 8)]
            value = waiting[rows, step]
            live = np.isfinite(value) & (value <= worst[:, None])
            if not live.any():
                break
            for k in range(step.shape[1]):
                at = np.flatnonzero(live[:, k])
                open_[at, step[at, k]] = False
            nodes = self.links[step].reshape(n, -1)
            look(np.where(np.repeat(live, self.links.shape[1], axis=1), nodes, step[:, :1]))
        chosen = np.argsort(known, axis=1, kind="stable")[:, :beam]
        squares = known[rows, chosen] + (points**2).sum(axis=1)[:, None]
        return np.where(np.isfinite(squares), chosen, -1), np.maximum(squares, 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def lifted(points: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """One more component, with which all vectors are as long as the longest: nearest then means largest product."""
    rest = np.zeros(len(points)) if query else np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
    return np.concatenate([points, rest[:, None]], axis=1)


def top_products(k: int):
    """The ``k`` largest inner products of each query with a block of vectors, of equal ones the earlier vectors."""

    def search(queries: np.ndarray, floors: np.ndarray, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rough = queries @ vectors.T
        most = min(k, len(vectors))
        # What rounding can move a product by, whichever way it is summed.
        sizes = np.sqrt((queries**2).sum(axis=1) * (vectors**2).sum(axis=1).max())
        margin = 4 * np.finfo(float).eps * vectors.shape[1] * sizes
        least = np.maximum(np.partition(rough, len(vectors) - most, axis=1)[:, len(vectors) - most], floors) - 2 * margin
        out = []
        for query, row, lowest, floor in zip(queries, rough, least, floors):
            places = np.flatnonzero(row >= lowest)
            # Summed in one order wherever a vector stands, so that what is equal comes out equal.
            scores = (query * vectors[places]).sum(axis=1)
            places, scores = places[scores >= floor], scores[scores >= floor]
            order = np.lexsort((places, -scores))[:most]
            out.append((places[order], scores[order]))
        return out

    return search


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    list_size: int = 200,
    most_lists: int = 4096,
    sample: int = 50_000,
    replicas: int = 4,
    closure: float = 0.1,
    ahead: int = 8,
    prune: float = 0.4,
    seed: int = 3,
) -> DataFrame:
    """The ``k`` vectors found with the largest inner product with each query: ``query_id, rank, vec_id, score``.

    ``queries`` has the columns of ``vectors``; a vector is no answer to the query of its own id. The score is the
    product of the original vectors in double precision; ties go to the smaller id. Null, zero and non-finite vectors,
    those of another length than the commonest, and rows without an id take no part; rows that repeat an id and
    vector count once. Other columns are ignored; empty tables give no rows.

    A sample of at most ``sample`` vectors is halved into groups of one size, about one for ``list_size`` vectors but
    at most ``most_lists``; their means are the lists' centres. Every vector goes to its nearest centre's list, and near a
    border to up to ``replicas`` lists: those at most ``1 + closure`` times as far away, unless another of its lists'
    centres is nearer to that centre than the vector is. A query is first answered from the nearest ``ahead``
    lists that are found over the centres' graph. It then goes to every list of which the distances of centre and members
    do not show that none reaches its k-th score so far (and to those whose centres are at most ``1 + prune`` times as far
    away as the nearest one, whatever they show), where each vector stands in its nearest list only. So no answer is
    lost, at any number of lists; where distances hardly differ, all vectors are compared. For this, lists near each other
    are joined to groups of about ``VECTOR_BLOCK`` vectors. Equal vectors are one entry with its ``k + 1`` smallest ids;
    long lists are searched in blocks by many tasks.
    """
    column = F.transform(F.col(vector_column), lambda x: x.cast("double") + F.lit(0.0)).alias("vector")
    valid = lambda frame: frame.select(F.col(id_column).cast("long").alias("vec_id"), column).filter(usable(F.col("vector"), False))
    entries = stored(distinct_vectors(common_length(valid(vectors)), k + 1), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    about = entries.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.max(F.size("vector")).alias("size")).first()
    asked = valid(queries).filter("vec_id IS NOT NULL").distinct().filter(F.size("vector") == (about["size"] or 0))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("double").alias("floor"), "vector")
    longest = about.longest or 0.0
    points = lifted(sample_of(entries.select("vector"), sample, seed), longest, False)
    if not len(points):
        return asked.selectExpr("query_id", "1 AS rank", "query_id AS vec_id", "floor AS score").limit(0)
    centres = balanced_centres(points, max(1, min(most_lists, about.n // list_size)), seed)
    count = len(centres)
    middles = balanced_centres(centres, min(count, max(1, about.n // VECTOR_BLOCK)), seed)
    group_of = distances(centres, middles).argmin(axis=1)

    def place(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        graph = CentreGraph(centres)
        found, squares = graph.nearest(lifted(rows, longest, False), 16 * replicas)
        gaps = np.sqrt(squares)
        taken = np.zeros(found.shape, bool)
        for j in range(found.shape[1]):
            near = (found[:, j] >= 0) & (gaps[:, j] <= (1 + closure) * gaps[:, 0]) & (taken.sum(axis=1) < replicas)
            for i in range(j):
                near &= ~(taken[:, i] & (graph.gaps[found[:, i], found[:, j]] < gaps[:, j]))
            taken[:, j] = near | (j == 0)
        rows, places = np.nonzero(taken)
        # The list's number, and whether it is the vector's own list, in one.
        return rows, 2 * found[rows, places] + (places > 0)

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(count, -np.inf)
        for batch in batches:
            of = batch.column("list").to_numpy()
            gaps = lifted(matrix(batch.column("vector")), longest, False) - centres[of]
            np.maximum.at(most, of, np.sqrt((gaps**2).sum(axis=1)))
        used = np.flatnonzero(np.isfinite(most))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(most[used])], ["list", "reach"])

    def ask(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, _ = CentreGraph(centres).nearest(lifted(rows, longest, True), ahead)
        rows, places = np.nonzero(found >= 0)
        return rows, found[rows, places]

    placed = stored(per_row(entries, place), "lists")
    lists = placed.withColumn("list", F.shiftright("list", 1))
    own = placed.filter("list % 2 = 0").withColumn("list", F.shiftright("list", 1))
    wide = own.mapInArrow(reaches, "list long, reach double").groupBy("list").agg(F.max("reach").alias("reach"))
    reach = np.full(count, -np.inf)
    for row in wide.collect():
        reach[row.list] = row.reach
    search = top_products(k + 1)
    near = stored(search_lists(lists, stored(per_row(asked, ask), "routed"), k, search, "double"), "answers")
    floors = best(near, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floor = F.when(F.col("n") == k, F.col("least")).alias("floor")
    again = asked.drop("floor").join(floors, "query_id", "left").select("query_id", floor, "vector")

    def others(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The last component is the floor.
        rows, floors = rows[:, :-1], rows[:, -1]
        gaps = distances(lifted(rows, longest, True), centres)
        sizes = (rows**2).sum(axis=1)[:, None] + longest**2
        # Lifted vectors are all as long as the longest, so the least distance tells the largest product.
        most = (sizes - np.maximum(gaps - reach, 0) ** 2) / 2
        possible = (most + 1e-6 * sizes >= floors[:, None]) | (gaps <= (1 + prune) * gaps.min(axis=1, keepdims=True))
        possible &= np.isfinite(reach)
        asked_ = np.zeros((len(rows), len(middles)), bool)
        at, which = np.nonzero(possible)
        asked_[at, group_of[which]] = True
        return np.nonzero(asked_)

    packed = F.concat("vector", F.array(F.coalesce("floor", F.lit(float("-inf")))))
    routed = per_row(again.select("query_id", "floor", packed.alias("vector")), others)
    routed = routed.withColumn("vector", F.slice("vector", 1, F.size("vector") - 1))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.array(group_of[batch.column("list").to_numpy()], pa.int64())
            yield pa.RecordBatch.from_arrays([groups, batch.column("ids"), batch.column("vector")], ["list", "ids", "vector"])

    joined = own.select("list", "ids", "vector").mapInArrow(grouped, "list long, ids array<long>, vector array<double>")
    far = search_lists(joined, stored(routed, "routed"), k, search, "double")
    return best(near.unionByName(far), k)
