"""An append-only table of ``id, data``, where ids are never given twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import materialize
from .files import _read_or_empty

_LOG = "batch bigint, part int, first_id bigint, next_id bigint, cleared boolean"
_ROWS = "part int, place bigint, data string"
# monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
_ROW_BITS = 33


class KeyedTable:
    """Parquet rows, one folder for each append below ``<path>/rows``, and a small table ``<path>/log`` of appends.

    A row keeps its partition and its place there; the log says for each append and partition which id its first row has.
    So rows are written once, and ids come from counts. An append is in the table once its log rows are: what a
    broken one has left is replaced by the next. Clearing is a row in the log, after which the rows are deleted; if
    that breaks off they are only left over. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows_path = f"{path}/rows"
        self.log_path = f"{path}/log"

    def _log(self) -> DataFrame:
        return _read_or_empty(self.spark.read, "parquet", self.log_path, T.StructType.fromDDL(_LOG), self.spark)

    def _last(self) -> tuple[int, int]:
        """Number of the last append or clearing, and the next id."""
        last = self._log().agg(F.max("batch"), F.max("next_id")).first()
        return last[0] or 0, last[1] or 1

    def last_id(self) -> int:
        """The last id ever given, also to rows that were cleared."""
        return self._last()[1] - 1

    def append(self, records: DataFrame, order_by: Sequence[str] = ()) -> None:
        """Add each record as a JSON object. Ids go on from the last one, in the given order or else in any.

        Rows that tie are spread by a hash of the whole row, so that a frequent value does not fill one partition.
        """
        batch, next_id = self._last()
        path = f"{self.rows_path}/{batch + 1}"
        if order_by:
            # Read twice, for the bounds of ranges and for the rows; what made the records runs once.
            records = materialize(records)
            keys = [F.col(c) for c in order_by] + [F.xxhash64(*[F.col(c) for c in records.columns])]
            records = records.repartitionByRange(*keys).sortWithinPartitions(*keys)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        data = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        rows = records.select(F.spark_partition_id().alias("part"), place.alias("place"), data.alias("data"))
        rows.write.mode("overwrite").parquet(path)
        # What meets in one task is one row for each partition.
        counts = self.spark.read.schema(_ROWS).parquet(path).groupBy("part").agg(F.count("*").alias("n"))
        running = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        until = next_id + F.sum("n").over(running)
        log = counts.select(
            F.lit(batch + 1).cast("bigint").alias("batch"),
            "part",
            (until - F.col("n")).alias("first_id"),
            until.alias("next_id"),
            F.lit(False).alias("cleared"),
        )
        log.coalesce(1).write.mode("append").parquet(self.log_path)

    def read(self) -> DataFrame:
        log = self._log()
        cleared = log.filter("cleared").agg(F.max("batch")).first()[0] or 0
        live = log.filter(~F.col("cleared") & (F.col("batch") > cleared)).select("batch", "part", "first_id")
        # One row for each append comes to the driver.
        batches = [r.batch for r in live.select("batch").distinct().collect()]
        if not batches:
            return self.spark.createDataFrame([], "id bigint, data string")
        rows = self.spark.read.schema(_ROWS).option("recursiveFileLookup", "true")
        rows = rows.parquet(*[f"{self.rows_path}/{batch}" for batch in batches])
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2).cast("bigint").alias("batch")
        joined = rows.select(folder, "part", "place", "data").join(live, ["batch", "part"])
        return joined.select((F.col("first_id") + F.col("place")).alias("id"), "data")

    def count(self) -> int:
        """The log has the ids of each append and partition, so no rows are read."""
        log = self._log()
        cleared = log.filter("cleared").agg(F.max("batch")).first()[0] or 0
        live = log.filter(~F.col("cleared") & (F.col("batch") > cleared))
        return live.agg(F.sum(F.col("next_id") - F.col("first_id"))).first()[0] or 0

    def clear(self) -> None:
        batch, next_id = self._last()
        row = [(batch + 1, None, None, next_id, True)]
        self.spark.createDataFrame(row, _LOG).coalesce(1).write.mode("append").parquet(self.log_path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.rows_path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
