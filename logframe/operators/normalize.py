"""Messages to tokens and back."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..functions.text import needs_token
from ..functions.words import ROWS, cleaned, lowered, opened, replaced
from ..schema import LINE_ORDER
from ..session import arrow_bytes, materialize, materialize_packed
from .dictionary import Dictionary, build_dictionary

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The head of a dictionary is broadcast. These defaults bound its size whatever the dictionary holds: at most
# this many entries, of at most this many characters.
HEAD_ENTRIES = 500_000
HEAD_WORD_CHARS = 64

# A chunk of records that asks for words beyond the head ends at so many distinct ones, or bytes.
CHUNK_WORDS, CHUNK_BYTES = 100_000, 16 << 20


def split_head(lookup: DataFrame, entries: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """Cut ``from, to, token_no`` into a head of bounded size and the rest.

    Tokens are numbered by first occurrence, so the words that most messages hold are in the head, and the
    shuffled join with the rest sees rare words only.
    """
    short = (F.length("from") <= chars) & (F.length("to") <= chars)
    in_head = F.coalesce((F.col("token_no") <= entries) & short, F.lit(False))
    return lookup.filter(in_head).select("from", "to"), lookup.filter(~in_head).select("from", "to")


def replace_words(
    records: DataFrame,
    text_col: str,
    key: Sequence[str],
    text: Column,
    pieces: Callable[[str], list[str]],
    wanted: Callable[[Column], Column],
    lookup: DataFrame,
    head_entries: int,
    head_word_chars: int,
) -> DataFrame:
    """Replace each wanted word of a text that ``lookup`` knows, and join the words by spaces. ``pieces`` gives the words
    of ``text``, none of them empty.

    The head of the lookup is broadcast to the tasks that rewrite the texts, where they are: records are neither taken
    apart nor moved. Only if the lookup goes on beyond its head, the records are kept in compressed chunks, the distinct words
    of a chunk that the head leaves open travel to the rest of the lookup, and what it knows of them back to the chunk, which
    is then shuffled once.
    """
    # Whether a word is wanted depends on nothing but the word.
    head, rest = (part.filter(wanted(F.col("from"))) for part in split_head(lookup, head_entries, head_word_chars))
    # Of bounded size, see HEAD_ENTRIES.
    pairs = head.select("from", "to").toArrow()
    entries = dict(zip(pairs.column("from").to_pylist(), pairs.column("to").to_pylist()))
    known = records.sparkSession.sparkContext.broadcast(entries)
    if rest.isEmpty():
        return records.withColumn(text_col, replaced(text, pieces, known))
    # Read twice; what made the records, and the search for words, runs once.
    kept, unpacked = in_chunks(records.withColumn(text_col, text), text_col, key, pieces, known)
    asked = kept.mapInArrow(open_words, StructType([*kept.select(*key).schema, StructField("from", StringType())]))
    asked = asked.filter(wanted(F.col("from")))
    found = asked.join(rest, "from").groupBy(*key).agg(F.collect_list(F.struct("from", "to")).alias("_late"))
    joined = kept.drop("_open").repartition(*key).join(found, list(key), "left")
    return unpacked(joined.select("_rows", "_late")).toDF(*records.columns)


def in_chunks(
    records: DataFrame, text_col: str, key: Sequence[str], pieces: Callable[[str], list[str]], known: Broadcast
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Records in chunks that are kept, and what makes records of ``_rows, _late`` again, words replaced by a chunk's ``_late``.

    A chunk has the key of its first record, ``_rows``, its records in compressed Arrow with their words joined by spaces, and
    ``_open``, the distinct words that a table does not know. A key that repeats makes two chunks share what they get. A record
    whose key holds a null asks for nothing and gets nothing.
    """
    names = [c.lower() for c in records.columns]
    place, keys = names.index(text_col.lower()), [names.index(k.lower()) for k in key]
    keyed = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    most_words, most_bytes, packed, rewritten = CHUNK_WORDS, CHUNK_BYTES, arrow_bytes, late_replacer(known).func

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows, words, size, first = known.value, [], {}, 0, None

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            columns = [rows[0].column(k).slice(0, 1) for k in keys] if first is None else first
            blobs = (packed(whole), packed(pa.table({"from": pa.array(words, pa.string())})))
            columns = [*columns, *(pa.array([blob], pa.binary()) for blob in blobs)]
            return pa.RecordBatch.from_arrays(columns, [*key, "_rows", "_open"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                asks = part.column(part.num_columns - 1)
                lead = asks.index(True).as_py()
                if first is None and lead >= 0:
                    first = [part.column(k).slice(lead, 1) for k in keys]
                texts = opened(part.column(place), pieces, table, asks, words)
                columns = [texts if k == place else column for k, column in enumerate(part.columns)]
                # A copy: slices would hold the batch.
                rows.append(pa.RecordBatch.from_arrays(columns, part.schema.names))
                size += rows[-1].nbytes
                if len(words) >= most_words or size >= most_bytes:
                    yield made()
                    rows, words, size, first = [], {}, 0, None
        if rows:
            yield made()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                late = batch.column("_late").slice(k, 1)
                nothing = pa.nulls(1, late.type)
                for part in pa.ipc.open_stream(batch.column("_rows")[k].as_buffer()):
                    texts, asks = part.column(place), part.column(part.num_columns - 1)
                    new = rewritten(texts, late)
                    if pc.any(pc.invert(asks)).as_py():
                        new = pc.if_else(asks, new, rewritten(texts, nothing))
                    columns = [new if n == place else column for n, column in enumerate(part.columns[:-1])]
                    yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    kinds = [*records.select(*key).schema, StructField("_rows", BinaryType()), StructField("_open", BinaryType())]
    for kind in kinds:
        kind.nullable = True
    kept = materialize(records.withColumn("_asks", keyed).mapInArrow(pack, StructType(kinds)))
    return kept, lambda chunks: chunks.mapInArrow(unpack, records.schema)


def open_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each open word of a chunk, with the chunk's key."""
    for batch in batches:
        for k in range(batch.num_rows):
            for words in pa.ipc.open_stream(batch.column("_open")[k].as_buffer()):
                key = [batch.column(c).take(pa.repeat(k, words.num_rows)) for c in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*key, words.column(0)], [*batch.schema.names[:-2], "from"])


def late_replacer(known: Broadcast) -> Callable[[Column, Column], Column]:
    """Words between spaces to the words that stand for them in a table, or in a record's own ``from`` and ``to`` for words
    that the table has not. If there is one list of those only, it is that of all records."""

    def tables(late: pa.Array) -> list[dict[str, str]]:
        pairs = late.flatten()
        old, new = pairs.field("from").to_pylist(), pairs.field("to").to_pylist()
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(late), 0)).to_pylist()
        return [dict(zip(old[begin:end], new[begin:end])) for begin, end in zip([0, *ends], ends)]

    def run(texts: pa.Array, late: pa.Array) -> pa.Array:
        get = known.value.get

        def rewritten(text: str | None, own: dict[str, str]) -> str | None:
            if text is None:
                return None
            words = text.split()
            # A word that the table has is in no record's own table.
            return " ".join(map(get, words, map(own.get, words, words)))

        shared, done = tables(late) if len(late) == 1 else [], []
        for at in range(0, len(texts), ROWS):
            some = texts.slice(at, ROWS).to_pylist()
            done.append(pa.array(map(rewritten, some, shared * len(some) or tables(late.slice(at, ROWS))), pa.string()))
        return pa.chunked_array(done, pa.string()).combine_chunks()

    return F.arrow_udf(run, "string")


def normalize_messages(
    records: DataFrame,
    dictionary: Dictionary,
    text_col: str = "message",
    key: Sequence[str] = tuple(LINE_ORDER),
    head_entries: int = HEAD_ENTRIES,
    head_word_chars: int = HEAD_WORD_CHARS,
) -> DataFrame:
    """Texts in cleaned words, each replaced by its token where it has one. Null becomes empty.

    ``key`` must tell all records apart and hold no null. At most ``head_entries`` words of at most ``head_word_chars``
    characters are broadcast; the others are joined by a shuffle of the distinct words that need them.
    """
    lookup = dictionary.entries.select(F.col("word").alias("from"), F.col("token").alias("to"), "token_no")
    present = records.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    text = lowered(F.col(text_col))
    return replace_words(present, text_col, key, text, cleaned, needs_token, lookup, head_entries, head_word_chars)


def normalize(
    records: DataFrame,
    dictionary: Dictionary | None = None,
    text_col: str = "message",
    order_by: Sequence[str] = tuple(LINE_ORDER),
    head_entries: int = HEAD_ENTRIES,
    head_word_chars: int = HEAD_WORD_CHARS,
) -> tuple[DataFrame, Dictionary]:
    """Extend the dictionary by the records' words, then normalise the records with it."""
    extended = build_dictionary(records, text_col, order_by, dictionary)
    return normalize_messages(records, extended, text_col, order_by, head_entries, head_word_chars), extended


def expand_messages(
    records: DataFrame,
    dictionary: Dictionary,
    text_col: str = "message",
    key: Sequence[str] = tuple(LINE_ORDER),
    head_entries: int = HEAD_ENTRIES,
    head_word_chars: int = HEAD_WORD_CHARS,
) -> DataFrame:
    """Tokens back to words; other words stay. Where two words share a token, the later one is taken.

    Only words of the dictionary's token form are looked up; with an imported dictionary, whose tokens may be any
    words, all of them are.
    """
    # Its head and its rest are read on their own.
    lookup = materialize_packed(
        dictionary.entries.groupBy(F.col("token").alias("from"))
        .agg(F.max(F.struct("token_no", "word")).alias("last"))
        .select("from", F.col("last.word").alias("to"), "last.token_no")
    )
    # The bare column: what made it in Python, such as normalising, then runs in the same worker.
    text, form = F.col(text_col), dictionary.token_form
    wanted = lambda word: word.isNotNull() if form is None else F.rlike(word, F.lit(form))
    return replace_words(records, text_col, key, text, str.split, wanted, lookup, head_entries, head_word_chars)
