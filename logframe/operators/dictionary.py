"""The token dictionary: words and the ``TKnnnn`` tokens that stand for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.words import first_token_words, token_words
from ..schema import DICTIONARY_SCHEMA, LINE_ORDER
from ..session import materialize, materialize_packed
from .numbering import number_rows

# The words a new dictionary starts with, in token order.
SEED_WORDS = ("failed", "password", "authentication", "connection")

#: What ``token_of`` gives.
TOKEN_FORM = "^TK[0-9]{4,}$"

JSON_SCHEMA = "counter bigint, word_to_token map<string,string>"


@dataclass(frozen=True)
class Dictionary:
    """``entries`` are ``word, token, token_no``; ``counter`` is the number the next new word gets.

    ``token_form`` is a regular expression that all tokens match, or None if they may be any words.
    """

    entries: DataFrame
    counter: int = 1
    token_form: str | None = TOKEN_FORM

    def size(self) -> int:
        return self.entries.count()


def token_of(number: Column) -> Column:
    """Four digits at least; longer numbers are not cut."""
    return F.format_string("TK%04d", number)


def clear_dictionary(spark: SparkSession) -> Dictionary:
    """An empty dictionary, whose first new word gets number 1."""
    return Dictionary(spark.createDataFrame([], DICTIONARY_SCHEMA), 1)


def seed_dictionary(spark: SparkSession) -> Dictionary:
    words = F.posexplode(F.array(*map(F.lit, SEED_WORDS))).alias("place", "word")
    entries = spark.range(1).select(words).withColumn("token_no", F.col("place").cast("bigint") + 1)
    return Dictionary(entries.select("word", token_of(F.col("token_no")).alias("token"), "token_no"), len(SEED_WORDS) + 1)


def first_occurrences(records: DataFrame, text_col: str, order_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Each word that needs a token, with the columns that put words in the order of their first occurrence.

    A record sends each of its words once, and with a number to order by, a batch of records sends each of its words for
    the first of them only. Words are counted down map-side, so a word that most records hold is one row per task when it
    is shuffled. Hash aggregation needs keys of a fixed width: one order column is such a key.
    Of several, the last two go into one decimal with the place in the record, and words are first reduced to one for
    each combination of the others (for scanned lines, of each block of a file); those few are then numbered.
    """
    kinds = dict(records.dtypes)
    numbered = len(order_by) == 1 and kinds[order_by[0]] in ("bigint", "int")
    listed = first_token_words(F.col(text_col), F.col(order_by[0])) if numbered else token_words(F.col(text_col))
    words = records.select(*order_by, F.posexplode(listed).alias("place", "word"))
    packed = order_by[-2:] if len(order_by) > 2 and kinds[order_by[-1]] == "int" else order_by[-1:]
    if len(order_by) == 1 or any(kinds[c] not in ("bigint", "int") for c in packed):
        key = F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)
        words = words.select("word", key.alias("record_order"), "place").groupBy("word")
        first = words.agg(F.min_by("place", "record_order").alias("place"), F.min("record_order").alias("record_order"))
        return first, ["record_order", "place"]
    groups = [c for c in order_by if c not in packed]
    # Negative numbers keep their order too; an int and a place take 32 bits each.
    number = F.col(packed[0]).cast("decimal(20,0)")
    for column in (*packed[1:], "place"):
        offset = F.lit(1 << 31) if column != "place" else F.lit(0)
        number = (number * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(38,0)") + (F.col(column).cast("bigint") + offset)
        number = number.cast("decimal(38,0)")
    words = words.select("word", *groups, number.alias("packed"))
    blocks = materialize(words.groupBy("word", *groups).agg(F.min("packed").alias("packed")))
    numbered = number_rows(blocks.select(*groups).distinct(), "block", order_by=groups)
    same = [blocks[c].eqNullSafe(numbered[c]) for c in groups]
    placed = blocks.join(numbered, same).select("word", "block", "packed")
    first = placed.groupBy("word").agg(F.min_by("packed", "block").alias("packed"), F.min("block").alias("block"))
    return first, ["block", "packed"]


def build_dictionary(
    records: DataFrame,
    text_col: str = "message",
    order_by: Sequence[str] = tuple(LINE_ORDER),
    dictionary: Dictionary | None = None,
) -> Dictionary:
    """Extend a dictionary (the seed one if none is given) by the new words of the records.

    ``order_by`` must tell all records apart: new words are numbered by where they first occur.
    """
    known = dictionary or seed_dictionary(records.sparkSession)
    words, order = first_occurrences(records, text_col, order_by)
    new_words = words.join(known.entries.select("word"), "word", "left_anti")
    numbered = number_rows(new_words, "token_no", order_by=order, start=known.counter, keep=materialize_packed)
    fresh = numbered.select("word", token_of(F.col("token_no")).alias("token"), "token_no")
    return Dictionary(known.entries.unionByName(fresh), known.counter + fresh.count(), known.token_form)


def contains_words(words: DataFrame, dictionary: Dictionary, word_col: str = "word") -> DataFrame:
    """The rows whose word is an entry. The test is case-sensitive, entries are in lower case."""
    entries = dictionary.entries.select(F.col("word").alias("_entry"))
    return words.join(entries, words[word_col] == entries["_entry"], "left_semi")


def save_dictionary(dictionary: Dictionary, path: str) -> str:
    """Add the dictionary to a folder as its newest version.

    A version is a table of entries and, written after it, a row in a small table of versions: what a broken save has
    left is no version, and the next save replaces it. Other versions are not touched, so a dictionary may be saved
    where it was loaded from. One writer at a time.
    """
    spark = dictionary.entries.sparkSession
    version = (_latest_version(spark, path) or (0,))[0] + 1
    dictionary.entries.write.mode("overwrite").parquet(f"{path}/entries/{version}")
    row = [(version, dictionary.counter, dictionary.token_form)]
    spark.createDataFrame(row, _VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return path


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """The newest version of a saved dictionary; an empty one if nothing was saved."""
    latest = _latest_version(spark, path)
    if latest is None:
        return clear_dictionary(spark)
    return Dictionary(spark.read.schema(DICTIONARY_SCHEMA).parquet(f"{path}/entries/{latest[0]}"), latest[1], latest[2])


def drop_old_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete the entries of all but the newest versions. Nobody may be reading them."""
    latest = _latest_version(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/entries")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder) if latest else ():
        if int(status.getPath().getName()) <= latest[0] - keep:
            files.delete(status.getPath(), True)


_VERSION_SCHEMA = "version bigint, counter bigint, token_form string"


def _latest_version(spark: SparkSession, path: str) -> tuple[int, int, str | None] | None:
    """Number, counter and token form. The table has one row for each save; no entries are read."""
    try:
        rows = spark.read.schema(_VERSION_SCHEMA).parquet(f"{path}/versions")
        newest = rows.agg(F.max(F.struct("version", "counter", "token_form"))).first()[0]
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return None if newest is None else tuple(newest)


def parse_dictionary_json(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """The entries of dictionaries in JSON form, one dictionary per row:
    ``counter, token_no, word, token`` and the other columns.

    Empty and malformed texts give no row. A missing counter is 1. ``token_no`` is the place in the text. Of a word
    that a text has more than once, the last entry counts, as for Python's own reader.
    """
    others = [c for c in texts.columns if c != text_col]
    parsed = texts.select(
        *others, F.monotonically_increasing_id().alias("_text"), F.from_json(F.col(text_col), JSON_SCHEMA).alias("_parsed")
    )
    entries = parsed.select(
        *others,
        "_text",
        F.coalesce("_parsed.counter", F.lit(1)).cast("bigint").alias("counter"),
        F.posexplode("_parsed.word_to_token").alias("_place", "word", "token"),
    )
    last = F.max(F.struct("_place", "token", "counter", *others)).alias("_last")
    return entries.groupBy("_text", "word").agg(last).select(
        *[F.col(f"_last.{c}").alias(c) for c in others],
        "_last.counter",
        (F.col("_last._place") + 1).cast("bigint").alias("token_no"),
        "word",
        "_last.token",
    )


def import_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """A dictionary from one JSON file; empty if the file is missing, empty or malformed."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return clear_dictionary(spark)
    counter = texts.select(F.from_json("value", JSON_SCHEMA)["counter"]).first()
    entries = parse_dictionary_json(texts).select("word", "token", "token_no")
    return Dictionary(entries, counter[0] if counter and counter[0] is not None else 1, None)
