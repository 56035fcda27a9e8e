"""Bounded, seeded samples of labelled documents to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: So many labels at most are broadcast with their numbers of documents.
MOST_LABELS = 10_000


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, most_chars: int, seed: int) -> DataFrame:
    """``label, doc_id, text`` of at most ``per_label`` documents of each label, chosen by a hash of their id.

    ``docs`` has ``doc_id, text`` and ``labels`` has ``doc_id, label``. Of a text with more than ``most_chars``
    characters, so many from a place chosen by the hash are taken. Only ids are ranked, of a label with many
    documents only those with the first orders, and the chosen ids, a number known beforehand, are broadcast to the texts. A document is chosen once per label.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    first = Window.partitionBy("label").orderBy("order", "doc_id")
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("label", "doc_id", order.alias("order"))
    # Orders are even over all 64-bit numbers: so many of them hold the first ones of a label almost surely.
    sizes = known.groupBy("label").agg(F.count("*").alias("n"))
    share = (F.col("order").cast("double") + 2.0**63) / 2.0**64
    # A row for each label, to all labelled ids, which need not move for it.
    if sizes.count() <= MOST_LABELS:
        sizes = F.broadcast(sizes)
    few = known.join(sizes, "label").filter((F.col("n") <= 4 * per_label) | (share * F.col("n") <= 2 * per_label + 100))
    ranked = few.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_label)
    chosen = ranked.select("label", "doc_id", "order").distinct()
    joined = docs.filter("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    spare = F.greatest(F.length("text") - most_chars, F.lit(0))
    start = (F.pmod("order", spare + 1) + 1).cast("int")
    text = F.coalesce(F.substring("text", start, F.lit(most_chars)), F.lit(""))
    return joined.select("label", "doc_id", text.alias("text"))
