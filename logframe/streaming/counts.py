"""Running counts of a stream, kept as tables of what each batch changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from .batches import BatchTable

#: Batches whose changes are joined to one table of all counts.
COMPACT_EVERY = 20


def write_counts(counts: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> DataStreamWriter:
    """A stream writer for a grouped stream with a count ``n``, such as ``summary_counts`` of a stream of records.

    The state holds one count for each group. Each batch writes the counts that it changed below ``path``, in a folder of its
    own number, so that a batch that runs again writes the same; every ``compact_every`` batches one folder takes all
    counts so far, which ``read_counts`` then starts from. Start it as any writer: ``write_counts(...).start()``.
    """

    def write(changed: DataFrame, batch: int) -> None:
        table = BatchTable(changed.sparkSession, path, changed.schema)
        table.write(batch, changed)
        if batch % compact_every == compact_every - 1:
            table.write_all(batch, read_counts(changed.sparkSession, path, changed.schema, until=batch))

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def read_counts(spark: SparkSession, path: str, schema: str | StructType, until: int | None = None) -> DataFrame:
    """The counts after the last batch, or after batch ``until``: of each group the ones it got last.

    ``schema`` is that of the counts, with the column ``n``; nothing written gives no rows.
    """
    rows = BatchTable(spark, path, schema).read(until)
    names = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(*[c for c in names if c != "n"]).agg(F.max_by("n", "batch").alias("n"))
    return last.select(*names)
