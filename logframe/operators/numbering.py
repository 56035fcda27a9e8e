"""Gap-free row numbers without passing the rows through one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

# monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_ROW_BITS = 33


def number_rows(frame: DataFrame, column: str, order_by: Sequence[str] = (), start: int = 1, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Add consecutive numbers from ``start``, in the order of ``order_by`` or else in any order.

    Ordered rows are range-partitioned and sorted; rows that tie are spread by a hash of the whole row, so that
    a frequent value does not fill one partition. The placed rows are materialized, because their partitioning
    must not change between counting them and numbering them, by ``keep``. What is summed up in one task and broadcast is
    one row per partition.
    """
    if order_by:
        keys = [F.col(c) for c in order_by] + [F.xxhash64(*[F.col(c) for c in frame.columns])]
        frame = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = keep(frame.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.select(
        *frame.columns,
        F.shiftright("_place", _ROW_BITS).alias("_partition"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    running = Window.partitionBy(F.lit(0)).orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        placed.groupBy("_partition")
        .agg(F.count("*").alias("_n"))
        .select("_partition", (F.coalesce(F.sum("_n").over(running), F.lit(0)) + start).alias("_offset"))
    )
    numbered = placed.join(F.broadcast(offsets), "_partition")
    return numbered.select(*frame.columns, (F.col("_offset") + F.col("_row")).alias(column))
