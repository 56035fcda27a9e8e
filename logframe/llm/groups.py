"""Groups of rows as Arrow tables, and groups cut into blocks so that none is too large for a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, which must come one after the other; keys are whole numbers without nulls."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = tuple(columns[:, a])
            if waiting and key != last:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
            waiting.append(batch.slice(a, b - a))
            last = key
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def meet_in_blocks(
    left: DataFrame, right: DataFrame, key: str, left_by: Column, right_by: Column, left_rows: int, right_rows: int
) -> DataFrame:
    """Rows of both sides that share a key, in groups of a block of each side: sorted by ``key, q, v, kind``.

    Both frames have the same columns. Each side of a key is dealt out by a hash of ``left_by`` or ``right_by`` to blocks
    of about so many rows, and goes to as many groups as the other side has blocks; ``kind`` is 0 for the left side. A
    key on one side only is left out.
    """
    ours = left.groupBy(key).agg(F.ceil(F.count("*") / left_rows).alias("q_blocks"))
    theirs = right.groupBy(key).agg(F.ceil(F.count("*") / right_rows).alias("v_blocks"))
    blocks = stored(ours.join(theirs, key), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda value, n: F.pmod(F.xxhash64(value), F.col(n))
    rest = [c for c in left.columns if c != key]
    one = left.join(blocks, key).select(
        key, of(left_by, "q_blocks").alias("q"), every("v_blocks").alias("v"), F.lit(0).alias("kind"), *rest
    )
    other = right.join(blocks, key).select(
        key, every("q_blocks").alias("q"), of(right_by, "v_blocks").alias("v"), F.lit(1).alias("kind"), *rest
    )
    return one.unionByName(other).repartition(key, "q", "v").sortWithinPartitions(key, "q", "v", "kind")
