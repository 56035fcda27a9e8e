"""Log files made by Spark from the event lines, in the shared folder, for the queries that scan or follow files."""

from __future__ import annotations

import os
import re
import shutil
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop_path, hadoop_path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source: str, target: str) -> None:
    hadoop_path, file_system = _file_system(spark, source)
    if not file_system.rename(hadoop_path(source), hadoop_path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename into a folder that need not be there yet."""
    hadoop_path, file_system = _file_system(spark, target)
    file_system.mkdirs(hadoop_path(target).getParent())
    rename(spark, source, target)


def cut_in_half(spark: SparkSession, path: str) -> None:
    """Keep the first half of a file's bytes."""
    hadoop_path, file_system = _file_system(spark, path)
    half = file_system.getFileStatus(hadoop_path(path)).getLen() // 2
    hadoop = spark._jvm.org.apache.hadoop
    source = hadoop.util.LimitInputStream(file_system.open(hadoop_path(path)), half)
    # The bytes do not pass through Python. The last argument closes both.
    hadoop.io.IOUtils.copyBytes(source, file_system.create(hadoop_path(path + ".half")), 1 << 20, True)
    file_system.delete(hadoop_path(path), False)
    rename(spark, path + ".half", path)


def write_parts(lines: DataFrame, folder: str, compression: str = "none") -> list[str]:
    """Write the column ``line`` as text, one file per task; gives the files' paths."""
    lines.select("line").write.option("compression", compression).text(folder)
    spark = lines.sparkSession
    hadoop_path, file_system = _file_system(spark, folder)
    names = [status.getPath().getName() for status in file_system.listStatus(hadoop_path(folder))]
    return [f"{folder}/{name}" for name in sorted(names) if name.startswith("part-")]


def write_logs(lines: DataFrame, scratch: str, folder: str, name: str, compression: str = "none") -> list[str]:
    """Write lines to files ``<folder>/<name with {} for the file's number>``."""
    spark = lines.sparkSession
    parts = write_parts(lines, scratch, compression)
    hadoop_path, file_system = _file_system(spark, folder)
    file_system.mkdirs(hadoop_path(folder))
    targets = [f"{folder}/{name.format(number)}" for number in range(len(parts))]
    for part, target in zip(parts, targets):
        rename(spark, part, target)
    return targets


def write_files(lines: DataFrame, number: str, scratch: str, files: list[str], compression: str = "none") -> None:
    """Write each line to the file of its number, all files at once, one task for each."""
    spark = lines.sparkSession
    dealt = lines.repartitionById(len(files), F.col(number).cast("int"))
    parts = {int(re.search(r"/part-(\d+)", part)[1]): part for part in write_parts(dealt, scratch, compression)}
    for place, file in enumerate(files):
        # A task without lines writes no file.
        part = parts.get(place) or write_parts(lines.limit(0).coalesce(1), f"{scratch}-{place}", compression)[0]
        move(spark, part, file)


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def _append(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            with open(row.target, "r+b") as target, open(row.source, "rb") as source:
                # A task that runs again starts from the same length.
                target.truncate(row.length)
                target.seek(row.length)
                shutil.copyfileobj(source, target)
        yield batch


def append_files(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Append each source file to its target, one task per pair. Both are on a disk that all executors share."""
    rows = [(_local(s), _local(t), os.path.getsize(_local(t))) for s, t in pairs]
    schema = "source string, target string, length bigint"
    frame = spark.createDataFrame(rows, schema).repartition(len(rows), "target")
    frame.mapInPandas(_append, schema).write.format("noop").mode("overwrite").save()
