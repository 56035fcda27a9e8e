"""File catalogue: one row of metadata per path."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import paths as path_functions


def catalog_paths(frame: DataFrame, path_col: str = "path") -> DataFrame:
    """Add type, compression, rotation, extension, reader and path parts to a frame of paths."""
    others = [c for c in frame.columns if c != path_col]
    named = frame.select(F.col(path_col).alias("path"), path_functions.filename(F.col(path_col)).alias("filename"), *others)
    name = F.col("filename")
    return named.select(
        "path",
        "filename",
        path_functions.log_type(name).alias("log_type"),
        path_functions.is_compressed(name).alias("compressed"),
        path_functions.rotation(name).alias("rotation"),
        path_functions.extension(name).alias("extension"),
        path_functions.reader(name).alias("reader"),
        path_functions.directory(F.col("path")).alias("directory"),
        path_functions.stem(name).alias("stem"),
        path_functions.suffix(name).alias("suffix"),
        *others,
    )


def catalog_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Catalogue the files under the paths. The listing's content column is pruned: no file is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths if isinstance(paths, str) else list(paths))
        .select("path", "length")
    )
    return catalog_paths(listing)


def qualified(spark: SparkSession, path: Column) -> Column:
    """A path as listings have it: with its file system in front, that of the session's default if it names none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.FileSystem
    default = hadoop.getDefaultUri(spark._jsc.hadoopConfiguration()).toString().rstrip("/")
    full = F.when(F.startswith(path, F.lit("/")), F.concat(F.lit(default), path)).otherwise(path)
    return F.regexp_replace(full, "^([A-Za-z][A-Za-z0-9+.-]*:)//+(?=/)", "$1")


def mark_existing(paths: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """Tell for each path whether the listing has it. Paths with and without a file system in front are the same."""
    spark = paths.sparkSession
    listed = files.select(qualified(spark, F.col("path")).alias("_listed")).distinct()
    joined = paths.join(listed, qualified(spark, paths[path_col]) == listed["_listed"], "left")
    return joined.select(*paths.columns, F.col("_listed").isNotNull().alias("exists"))


def existing_roots(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths, or patterns of paths, under which there is something."""
    found = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root):
            found.append(path)
    return found


def broken_files(files: DataFrame) -> DataFrame:
    """``path, reason`` of the catalogued files that cannot be read to their end: vanished ones, and torn gzip files.

    Each gzip file is unpacked once, block by block, by one task; of the others only the first byte is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, problem(path)) for path in batch.column("path").to_pylist()]
            found = [f for f in found if f[1]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["path", "reason"])

    def problem(path: str) -> str | None:
        try:
            store, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
            with store.open_input_stream(place, compression=None) as file:
                if not place.lower().endswith(".gz"):
                    file.read(1)
                    return None
                with gzip.GzipFile(fileobj=file) as unpacked:
                    while unpacked.read(1 << 20):
                        pass
        except (OSError, EOFError, zlib.error) as error:
            return f"{type(error).__name__}: {error}"
        return None

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path").repartition(cores).mapInArrow(run, "path string, reason string")
