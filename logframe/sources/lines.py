"""Line scans of plain and gzip text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths as path_functions
from ..functions.text import clean_utf8
from .spread import spread


def decoded_path(encoded: Column) -> Column:
    """The scan's metadata columns hold percent-encoded paths; a plus sign in them is just a plus sign."""
    plain = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(encoded, F.lit("%")), plain).otherwise(encoded)


def any_case_glob(prefix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in prefix) + "*"


def read_lines(
    spark: SparkSession,
    paths: str | Sequence[str],
    log_type: str | Sequence[str] | None = None,
    tolerant: bool = False,
    spread_out: bool = False,
) -> DataFrame:
    """One row per physical line: ``file_path, filename, log_type, block_start, line_id, line``.

    Gzip files are told by their extension. ``log_type`` limits the listing to files of that type, or of
    those types, so the other files are not opened at all. ``tolerant`` skips files that vanish or are corrupt. A gzip file cannot be
    split: where a few big ones would leave most cores idle, ``spread_out`` deals their lines out.
    """
    scan = spark.read.option("recursiveFileLookup", "true")
    if log_type is not None:
        types = [log_type] if isinstance(log_type, str) else list(log_type)
        scan = scan.option("pathGlobFilter", "{" + ",".join(map(any_case_glob, types)) + "}")
    if tolerant:
        scan = scan.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    lines = (
        scan.text(paths if isinstance(paths, str) else list(paths))
        .select(
            decoded_path(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
            clean_utf8(F.col("value")).alias("line"),
        )
        .withColumn("filename", path_functions.filename(F.col("file_path")))
    )
    type_column = F.lit(log_type) if isinstance(log_type, str) else path_functions.log_type(F.col("filename"))
    lines = lines.select("file_path", "filename", type_column.alias("log_type"), "block_start", "line_id", "line")
    return spread(lines) if spread_out else lines
