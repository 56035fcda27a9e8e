"""Predicates, counts and previews over records and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import LINE_ORDER


def security_events(records: DataFrame) -> DataFrame:
    return records.filter(F.col("event_type") != "UNKNOWN")


def network_events(records: DataFrame) -> DataFrame:
    return records.filter(F.col("ip").isNotNull())


def user_events(records: DataFrame) -> DataFrame:
    return records.filter(F.col("user").isNotNull())


def summary_counts(
    records: DataFrame,
    dimensions: Sequence[str] = ("event_type", "severity", "process"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Record counts per value of each dimension: ``dimension, value, n``.

    Records are first counted per combination of values, map-side; only the combinations are then spread over
    the dimensions, where grouping sets would have multiplied the records. A stream may be grouped only once: its
    records are spread first, and counted map-side per value, so that one state holds the counts of all dimensions.
    """
    if records.isStreaming:
        cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))
        return records.select(*by, cells.alias("cell")).groupBy(*by, "cell.dimension", "cell.value").agg(F.count("*").alias("n"))
    combined = records.groupBy(*by, *dimensions).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))
    spread = combined.select(*by, cells.alias("cell"), "n").select(*by, "cell.dimension", "cell.value", "n")
    return spread.groupBy(*by, "dimension", "value").agg(F.sum("n").alias("n"))


def record_counts(records: DataFrame, by: Sequence[str] = ("log_type",)) -> DataFrame:
    return records.groupBy(*by).agg(F.count("*").alias("n_records"))


def preview(records: DataFrame, n: int = 5, order_by: Sequence[str] = tuple(LINE_ORDER)) -> DataFrame:
    """The first n records in file order: each task keeps its own n, then the n best of those are merged."""
    return records.orderBy(*order_by).limit(n)


def chars_read(lines: DataFrame, by: Sequence[str] = ("file_path",), text_col: str = "line") -> DataFrame:
    """Characters per input, line terminators not counted."""
    return lines.groupBy(*by).agg(
        F.count("*").alias("n_lines"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n_chars")
    )
