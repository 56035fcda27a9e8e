"""Tables that a stream adds to batch by batch, in folders that a batch which runs again replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class BatchTable:
    """``<path>/changes/batch=N`` holds what batch N wrote, ``<path>/all/batch=N`` all there is after batch N.

    A folder counts once its writer has marked it as finished. The newest table of everything is what reading starts
    from, so that the folders read are no more than the batches since.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _finished(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.path}/{kind}")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        done = [n for n in names if n.startswith("batch=") and files.exists(path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch=")) for n in done)

    def write(self, batch: int, changes: DataFrame) -> None:
        changes.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")

    def write_all(self, batch: int, frame: DataFrame) -> None:
        """Keep all there is after a batch, which must be finished."""
        frame.write.mode("overwrite").parquet(f"{self.path}/all/batch={batch}")

    def read(self, until: int | None = None) -> DataFrame:
        """All rows written up to batch ``until``, with the ``batch`` that they are from (for rows of a table of
        everything, its batch)."""
        upto = lambda n: until is None or n <= until
        since = max(filter(upto, self._finished("all")), default=-1)
        folders = [f"{self.path}/all/batch={since}"] if since >= 0 else []
        folders += [f"{self.path}/changes/batch={n}" for n in self._finished("changes") if n > since and upto(n)]
        if not folders:
            # Not from a local list, which Python workers of its own would read.
            return self.spark.range(0).select(F.from_json(F.lit("{}"), self.schema).alias("row"), F.col("id").alias("batch")).select("row.*", "batch")
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        number = F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/[^/]*$", 1).cast("bigint")
        return rows.select("*", number.alias("batch"))
