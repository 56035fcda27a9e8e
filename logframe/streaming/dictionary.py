"""A dictionary that grows with a stream, batch by batch, and the messages normalised with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.dictionary import Dictionary, build_dictionary, seed_dictionary
from ..operators.normalize import normalize_messages
from ..schema import DICTIONARY_SCHEMA
from ..session import materialize
from .batches import BatchTable

#: Batches whose new words are joined to one table of all words.
COMPACT_EVERY = 20
#: What orders the lines of a batch of followed logs.
TAIL_ORDER = ("log_path", "segment", "byte_offset")


def stream_dictionary(spark: SparkSession, path: str, until: int | None = None) -> Dictionary:
    """The dictionary after the last finished batch, or after batch ``until``; the seed one before all batches."""
    entries = BatchTable(spark, f"{path}/dictionary", DICTIONARY_SCHEMA).read(until).drop("batch")
    seeds = seed_dictionary(spark)
    # Seed words are in the table of the first batch.
    last = entries.agg(F.max("token_no")).first()[0]
    return seeds if last is None else Dictionary(entries, last + 1)


def normalize_stream(
    records: DataFrame,
    path: str,
    checkpoint: str,
    text_col: str = "message",
    order_by: Sequence[str] = TAIL_ORDER,
    compact_every: int = COMPACT_EVERY,
) -> DataStreamWriter:
    """A stream writer that extends a dictionary by each batch's new words and writes the batch's messages in tokens.

    Below ``path``, ``dictionary`` holds the new words of each batch and ``messages`` its records, each in a folder of the
    batch's number. A batch takes the dictionary as the batch before left it, so one that runs again gives its words the
    same numbers and replaces what it wrote. If the batches come in the order of ``order_by``, which must tell a batch's
    records apart, words get the numbers that one batch of all records would give them. Read with ``stream_dictionary``
    and ``stream_messages``; one stream for each folder.
    """

    def write(frame: DataFrame, batch: int) -> None:
        spark = frame.sparkSession
        words = BatchTable(spark, f"{path}/dictionary", DICTIONARY_SCHEMA)
        batch_records = materialize(frame)
        known = stream_dictionary(spark, path, until=batch - 1)
        extended = build_dictionary(batch_records, text_col, order_by, known)
        first = words.read(batch - 1).isEmpty()
        fresh = extended.entries if first else extended.entries.filter(F.col("token_no") >= known.counter)
        words.write(batch, fresh)
        after = Dictionary(words.read(batch).drop("batch"), known.counter)
        tokens = normalize_messages(batch_records, after, text_col, order_by)
        BatchTable(spark, f"{path}/messages", frame.schema).write(batch, tokens)
        if batch % compact_every == compact_every - 1:
            words.write_all(batch, after.entries)

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def stream_messages(spark: SparkSession, path: str, schema) -> DataFrame:
    """The normalised records of all finished batches, with the ``batch`` of each."""
    return BatchTable(spark, f"{path}/messages", schema).read()
