"""JSON and CSV sinks: folders of part files, written and read by all tasks at once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from ..schema import RECORD_SCHEMA

# A line feed as separator both ways keeps carriage returns inside values as they are.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _read_or_empty(reader: DataFrameReader, form: str, path: str, schema: T.StructType, spark: SparkSession) -> DataFrame:
    try:
        return reader.schema(schema).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_json(records: DataFrame, path: str) -> str:
    """One JSON object per line, nulls included. What was there is overwritten."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def read_json(
    spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA, array_file: bool = False
) -> DataFrame:
    """No rows if the path is missing. ``array_file`` reads files that hold one JSON array."""
    return _read_or_empty(spark.read.option("multiLine", array_file), "json", path, schema, spark)


def clear_json(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> None:
    write_json(spark.createDataFrame([], schema), path)


def write_csv(records: DataFrame, path: str) -> str:
    """A header and the columns in alphabetical order; null and empty text look the same."""
    records.select(*sorted(records.columns)).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(
    spark: SparkSession, path: str, columns: list[str] = RECORD_SCHEMA.names, multi_line: bool = False
) -> DataFrame:
    """All values as text, null as empty text; no rows if the path is missing.

    ``columns`` are those that were written. ``multi_line`` is for values with line breaks; records have none,
    and without it big files are split among tasks.
    """
    names = sorted(columns)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
    rows = _read_or_empty(reader, "csv", path, schema, spark)
    return rows.select(*[F.coalesce(name, F.lit("")).alias(name) for name in names])


def clear_csv(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> None:
    write_csv(spark.createDataFrame([], schema), path)
