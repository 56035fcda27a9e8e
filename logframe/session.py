"""Session set-up, and the shared folder that cuts lineage and holds intermediate tables."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIB, GIB = 1 << 20, 1 << 30


def sizing(data_bytes: int) -> dict[str, int]:
    """Split and shuffle sizes for an input of so many bytes.

    Splits grow from 128 MiB to 1 GiB and shuffles from 200 to 50,000 partitions, so that tasks of some GiB at
    most do not come with more map and reduce pairs than the driver can keep track of.
    """
    split = min(max(data_bytes // 100_000, 128 * MIB), GIB)
    partitions = min(max(data_bytes // GIB, 200), 50_000)
    return {"spark.sql.files.maxPartitionBytes": split, "spark.sql.shuffle.partitions": partitions}


def build_session(
    app_name: str = "logframe", master: str | None = None, data_bytes: int | None = None, **conf: object
) -> SparkSession:
    """A session with the settings the operators are tuned for; ``data_bytes`` adds those of ``sizing``.

    Keyword names use ``__`` for dots.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # HotSpot leaves longer methods uncompiled; beyond this Spark generates smaller ones per operator.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    settings = sizing(data_bytes) if data_bytes else {}
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder: on a cluster a folder of one machine
    would be out of reach for the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="logframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_root(spark)}/logframe/{label}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Let frames made meanwhile delete their shuffles at the end of their run, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(frame: DataFrame) -> DataFrame:
    """Compute a frame once and keep it in the shared folder, so that lost executors cost no recomputation.

    Its shuffles are deleted as soon as it is kept.
    """
    checkpoint_root(frame.sparkSession)
    with shuffles_deleted(frame.sparkSession):
        # The caller's own frame keeps its shuffles.
        return frame.select("*").checkpoint()


def arrow_bytes(table: pa.Table) -> bytes:
    """A table as one compressed stream; ``pa.ipc.open_stream`` reads it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def materialize_packed(frame: DataFrame) -> DataFrame:
    """As ``materialize``, for large tables of short columns: rows are kept as compressed Arrow batches, in a tenth or so of the
    room. Reading them takes Python workers."""
    packed = arrow_bytes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"rows": pa.array([packed(pa.Table.from_batches([batch]))], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                yield from pa.ipc.open_stream(rows.as_buffer())

    return materialize(frame.mapInArrow(pack, "rows binary")).mapInArrow(unpack, frame.schema)
