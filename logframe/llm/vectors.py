"""What both vector searches share: usable vectors, copies, balanced centres, and blocks of queries against lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .groups import meet_in_blocks, sorted_groups

#: So many queries meet so many different vectors in one group.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def usable(vector: Column, zeros: bool) -> Column:
    """Not null or empty, without null or non-finite components, and with one other than zero unless ``zeros``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & finite
    return good if zeros else good & F.exists(vector, lambda x: x != 0)


def common_length(vectors: DataFrame) -> DataFrame:
    """Only the vectors of the commonest length, the shorter one of two that are as common."""
    lengths = vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "length").first()
    return vectors.filter(F.size("vector") == (first.length if first else 0))


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """``ids, vector``: every different vector once, with the ``ids`` smallest ids that have it, smallest first.

    Of equal vectors only those can be among a query's nearest, so a vector that a third of all rows share is one
    row. Spark cuts the ranks down before the shuffle.
    """
    known = vectors.filter("vec_id IS NOT NULL").distinct()
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = known.withColumn("rank", rank).filter(F.col("rank") <= ids)
    return first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "vector")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def sample_of(vectors: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most so many vectors, the first in a seeded order."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(most).toArrow()
    return matrix(rows.column("vector").combine_chunks()) if rows.num_rows else np.zeros((0, 1))


def balanced_centres(points: np.ndarray, leaves: int, seed: int) -> np.ndarray:
    """Means of ``leaves`` groups of the same size: each group is halved again and again at the middle between two means."""
    rng = np.random.default_rng(seed)
    groups = [points]
    while len(groups) < leaves and max(map(len, groups)) > 1:
        groups.sort(key=len)
        group = groups.pop()
        means = group[rng.choice(len(group), 2, replace=False)]
        for _ in range(8):
            side = ((group - means[0]) ** 2).sum(axis=1) - ((group - means[1]) ** 2).sum(axis=1)
            order = np.argsort(side, kind="stable")
            half = len(group) // 2
            means = np.stack([group[order[:half]].mean(axis=0), group[order[half:]].mean(axis=0)])
        groups += [group[order[:half]], group[order[half:]]]
    return np.stack([g.mean(axis=0) for g in groups])


def per_row(frame: DataFrame, run: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows of ``frame`` once for each list that ``run`` names: it gives row numbers and list numbers for a matrix."""
    names = frame.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows, lists = run(matrix(part.column("vector")))
                chosen = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *chosen.columns], ["list", *names])

    return frame.mapInArrow(each, "list long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema))


Search = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def search_lists(lists: DataFrame, queries: DataFrame, k: int, search: Search, kind: str) -> DataFrame:
    """``query_id, vec_id, score``: for each query of a list the best ``k`` of each block of the list.

    ``lists`` has ``list, ids, vector``, ``queries`` has ``list, query_id, floor, vector``. Both are dealt out by hash
    to blocks of about ``VECTOR_BLOCK`` and ``QUERY_BLOCK``, so a list with a third of all rows is many groups.
    ``search`` gets the queries, their floors (scores that must be reached) and the vectors, in the order of their
    smallest ids. It gives for each query the places and scores of at least the best ``k + 1`` that reach its floor,
    ties to the earlier ones. ``kind`` is the type of a score.
    """
    asking = queries.select("list", F.array("query_id").alias("ids"), "floor", "vector")
    answering = lists.select("list", "ids", F.lit(None).cast("double").alias("floor"), "vector")
    together = meet_in_blocks(
        asking, answering, "list", F.col("ids"), F.col("vector"), QUERY_BLOCK, VECTOR_BLOCK
    )

    def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
        is_query = rows.column("kind").to_numpy() == 0
        n, vectors = int(is_query.sum()), matrix(rows.column("vector"))
        own = rows.column("ids").flatten().to_numpy()[:n]
        floors = rows.column("floor").slice(0, n).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        ids = rows.column("ids").slice(n).to_pylist()
        # Vectors in the order of their smallest ids.
        order = np.argsort([i[0] for i in ids], kind="stable").astype(np.int64)
        ids = [ids[k] for k in order]
        out: tuple[list, list, list] = ([], [], [])
        if n and len(ids):
            for query, (places, scores) in zip(own, search(vectors[:n], floors, vectors[n:][order])):
                found = [(-s, i) for p, s in zip(places, scores) for i in ids[p] if i != query]
                for score, i in sorted(found)[:k]:
                    out[0].append(query)
                    out[1].append(i)
                    out[2].append(-score)
        types = (pa.int64(), pa.int64(), pa.int64() if kind == "long" else pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["list", "q", "v"]):
            yield answer(rows)

    return together.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def best(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best answers to each query, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
