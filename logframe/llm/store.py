"""Tables in the shared folder, which cut lineage: a lost executor costs no more than the running step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path


#: Paths of the tables stored since the innermost scratch() began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(frame: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a frame below ``spark.checkpoint.dir`` and read it again; with a folder for each value of the column ``by``."""
    path = scratch_path(frame.sparkSession, label)
    written = _written.get()
    if written is not None:
        written.append(path)
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path).select(*frame.columns)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete, at the end, all tables stored meanwhile but those stored by what this gives, a ``stored`` that lasts.

    Tables that last are left to the scratch() around this one, if there is one.
    """
    outer, own = _written.get(), []
    token = _written.set(own)

    def keep(frame: DataFrame, label: str) -> DataFrame:
        inner = _written.set(outer)
        try:
            return stored(frame, label)
        finally:
            _written.reset(inner)

    try:
        yield keep
    finally:
        _written.reset(token)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(frame: DataFrame) -> Column:
    """All columns as one, so that others can stand beside them under any name."""
    return F.struct(*[F.col(f"`{name}`") for name in frame.columns]).alias("row")


def discard(table: DataFrame, but: str | None = None) -> None:
    """Delete a stored table that nothing reads any more, all folders but one if it has folders."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if not but or not folder.endswith(f"/{but}"):
            _delete(table.sparkSession, folder)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let Python get so many rows at a time, for jobs that run meanwhile and have large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
