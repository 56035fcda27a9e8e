"""From raw documents to packed token sequences, in stages that each write a table the next one reads.

All stages but the last return the columns of ``documents``. Empty tables pass through; a null text is an empty one; rows
are told apart by keys of their own, so those that repeat an id, or have none, are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logframe.llm.minhash import near_duplicates
from logframe.llm.mixing import mixed_rows
from logframe.llm.packing import pack_documents
from logframe.llm.quality import fit_quality, score_quality
from logframe.llm.queries import table, tokenizer
from logframe.llm.store import discard, scratch, stored, whole_row
from logframe.llm.suffixes import cut_repeats

#: Documents that are less likely to be good than this go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose compressed size speaks for bad text. Learns from the labelled ones among ``docs``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(docs.select("doc_id", "text"), labels)
    scored = score_quality(docs.select(whole_row(docs), "text"), model)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one with the smallest id, where none comes before all others.

    Rows are nodes by a stored key, not by their ids: of equal rows with one id, or without one, a single one stays, so
    that the next stage does not take them for each other's copies and cut the text out of all of them.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("key"), whole_row(docs)), "near-rows")
    with scratch(spark) as keep:
        found = near_duplicates(rows.select("key", F.col("row.text").alias("text")), "key").withColumnRenamed("doc_id", "key")
        ids = rows.select("key", F.col("row.doc_id").alias("id"))
        first = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
        kept = keep(first.select("first.key"), "near-kept")
    # What is kept grows with the rows, so it is not broadcast.
    return rows.join(kept.hint("merge"), "key", "left_semi").select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that also begin elsewhere out of the texts; halves of characters go with them."""
    cut = cut_repeats(docs.select(whole_row(docs), "doc_id", "text"), as_text=True)
    changed = F.size("removed") > 0
    new = {
        "text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's share says: not at all, or up to three times."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document stands. A document taken twice has its pieces twice."""
    pieces = pack_documents(docs, tokenizer())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no tokenizer, compressor or seeded hash of these kinds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        # What a stage keeps goes when its result is stored.
        with scratch(spark) as keep:
            done = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(docs)
        docs = done
    return docs
