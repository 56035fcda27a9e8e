"""Whole jobs: from files to records, and a report on a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.parse import FORMATS, LogFormat, is_match, match_lines, parse_all
from ..sources.files import catalog_files, catalog_paths, existing_roots, mark_existing
from ..sources.lines import read_lines


EMPTY_LINES = "file_path string, filename string, log_type string, block_start bigint, line_id bigint, line string"


class UnsupportedLogType(ValueError):
    """Files were given for which there is no format."""


def process_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    formats: Mapping[str, LogFormat] = FORMATS,
    strict: bool = True,
    tolerant: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(files, records)`` for all log files under the paths; they join on ``path`` = ``file_path``.

    One scan reads the files of all formats' types and no others. Files without a format are an error, or with
    ``strict=False`` just not read. ``tolerant`` leaves out paths under which there is nothing, and what can't be read;
    ``run_report`` tells of both.
    """
    if tolerant:
        paths = existing_roots(spark, [paths] if isinstance(paths, str) else paths)
        if not paths:
            nothing = spark.createDataFrame([], "path string, length bigint")
            lines = spark.createDataFrame([], EMPTY_LINES)
            return catalog_paths(nothing), parse_all(lines, formats)
    files = catalog_files(spark, paths)
    if strict:
        unsupported = files.filter(~F.col("log_type").isin(*formats)).select("path", "log_type").take(1)
        if unsupported:
            raise UnsupportedLogType(f"no format for log type {unsupported[0].log_type!r} of {unsupported[0].path}")
    return files, parse_all(read_lines(spark, paths, list(formats), tolerant), formats)


def run_report(
    files: DataFrame,
    lines: DataFrame,
    formats: Mapping[str, LogFormat] = FORMATS,
    expected: DataFrame | None = None,
    broken: DataFrame | None = None,
) -> DataFrame:
    """One row per file: its metadata, how many lines and records it gave, and a status.

    The status is failed for files of ``broken`` (as ``broken_files`` gives them; what could be read of them is
    counted), else ok, empty (no record), unsupported (no format) or, for paths of ``expected`` (column ``path``)
    that are not among the files, missing. Lines are counted per file where they are read; the join sees one
    row per file on either side.
    """
    per_file = (
        match_lines(lines, list(formats.values()))
        .groupBy("file_path")
        .agg(F.count("*").alias("n_lines"), F.count_if(is_match()).alias("n_records"))
    )
    shown = ["path", "filename", "log_type", "reader", "compressed", "rotation"]
    report = files.select(*shown).join(per_file, F.col("path") == F.col("file_path"), "left")
    n_records = F.coalesce("n_records", F.lit(0))
    status = (
        F.when(~F.col("log_type").isin(*formats), F.lit("unsupported"))
        .when(n_records == 0, F.lit("empty"))
        .otherwise(F.lit("ok"))
    )
    if broken is not None:
        names = broken.select(F.col("path").alias("_broken")).distinct()
        report = report.join(names, report["path"] == names["_broken"], "left")
        status = F.when(F.col("_broken").isNotNull(), F.lit("failed")).otherwise(status)
    report = report.select(
        *shown, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), n_records.alias("n_records"), status.alias("status")
    )
    if expected is not None:
        missing = mark_existing(expected.select("path"), files).filter(~F.col("exists"))
        rows = missing.select("path", F.lit("missing").alias("status"), F.lit(0).alias("n_lines"), F.lit(0).alias("n_records"))
        report = report.unionByName(rows, allowMissingColumns=True)
    return report


def report_totals(report: DataFrame) -> DataFrame:
    """Files processed (those with a format) and records in total."""
    return report.agg(
        F.count_if(F.col("status").isin("ok", "empty")).alias("files_processed"),
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("total_records"),
    )
