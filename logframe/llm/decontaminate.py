"""Benchmark decontamination: a broadcast hash set of test n-grams, and spans of training text that hold them.

Words are the maximal runs of letters, digits and bytes of other characters; capital A-Z count as small letters. The
windows of an item are its runs of ``size`` words; an item of fewer words is one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored, whole_row
from .text import BASE, U64, hash_spans, mix, pieces, ragged, string_bytes, word_spans

#: Bytes of windows and of their items in one broadcast set.
SET_BYTES = 32 << 20
#: Places of a table by which most windows of a text are left out before any search.
SIEVE_BITS = 22

_is_word = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _is_word[_low : _high + 1] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a batch of texts: where each begins and ends, its hash, and the words of each text."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.offsets = string_bytes(texts)
        self.starts, self.ends = word_spans(self.data, self.offsets, _is_word)
        self.hashes = hash_spans(self.data, self.starts, self.ends)
        self.places = np.searchsorted(self.starts, self.offsets)
        self.lengths = np.diff(self.places)

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window that begins at each word; the last ones go beyond their texts."""
        n = max(0, len(self.hashes) - size + 1)
        total = np.zeros(n, U64)
        with np.errstate(over="ignore"):
            for k in range(size):
                total *= U64(BASE)
                total += self.hashes[k : k + n]
            return mix(total + U64(size))

    def inside(self, size: int) -> np.ndarray:
        """For each word, whether a window that begins there ends in the same text."""
        last = np.repeat(self.places[1:], self.lengths) - size
        return np.arange(len(self.hashes)) <= last

    def normal(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some words in small letters, and the n + 1 places between them."""
        lengths = self.ends[words] - self.starts[words]
        return _lower[self.data[ragged(self.starts[words], lengths)]], np.concatenate([[0], np.cumsum(lengths)])


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``item_id, n, window``: the number of words of each window of each item, and the words with a space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", most_bytes=1 << 20):
                words = Words(part.column("text"))
                every, cuts = words.normal(np.arange(len(words.starts)))
                text, ids = every.tobytes(), part.column("item_id").to_pylist()
                for item, low, high in zip(ids, words.places[:-1], words.places[1:]):
                    n = min(size, int(high - low))
                    own = [text[a:b].decode() for a, b in zip(cuts[low:high], cuts[low + 1 : high + 1])]
                    found = [" ".join(own[k : k + n]) for k in range(len(own) - n + 1)] if n else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(found), pa.int64()), pa.array([n] * len(found), pa.int32()), pa.array(found, pa.string())],
                        ["item_id", "n", "window"],
                    )

    return items.mapInArrow(run, "item_id long, n int, window string").distinct()


class WindowSet:
    """A bounded set of windows: hashes to find them by, the words to verify them by, and the items that have them."""

    def __init__(self, rows: pa.Table) -> None:
        windows = rows.column("window").combine_chunks().dictionary_encode()
        owner = windows.indices.to_numpy(zero_copy_only=False)
        ids = rows.column("item_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        order = np.argsort(owner[known], kind="stable")
        self.items = ids.drop_null().to_numpy()[order]
        self.item_ends = np.searchsorted(owner[known][order], np.arange(len(windows.dictionary) + 1))
        words = Words(windows.dictionary)
        data, cuts = words.normal(np.arange(len(words.starts)))
        self.words, self.word_cuts, number = distinct_words(words.hashes, data, cuts)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(words.lengths):
            own = np.flatnonzero(words.lengths == size)
            hashes = words.windows(size)[words.places[own]]
            order = np.argsort(hashes, kind="stable")
            numbers = number[words.places[own][:, None] + np.arange(size)]
            self.sizes[int(size)] = (hashes[order], own[order], numbers[order])
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        for hashes, _, _ in self.sizes.values():
            self.sieve[hashes >> U64(64 - SIEVE_BITS)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and number of window of each occurrence in the texts."""
        found = [np.zeros((3, 0), np.int64)]
        for size, (hashes, own, numbers) in self.sizes.items():
            seen = words.windows(size)
            first = np.flatnonzero(self.sieve[seen >> U64(64 - SIEVE_BITS)] & words.inside(size)[: len(seen)])
            low, high = (np.searchsorted(hashes, seen[first], side) for side in ("left", "right"))
            # Windows whose hashes are equal by chance are each compared.
            at, place = np.repeat(first, high - low), ragged(low, high - low)
            same = np.ones(len(at), bool)
            for k in range(size):
                same[same] = self.equal(words, at[same] + k, numbers[place[same], k])
            at, place = at[same], place[same]
            found.append(np.stack([at, np.full(len(at), size), own[place]]))
        return tuple(np.concatenate(found, axis=1))

    def equal(self, words: Words, at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether words of the texts are these words of the set, byte by byte."""
        lengths = words.ends[at] - words.starts[at]
        same = lengths == self.word_cuts[numbers + 1] - self.word_cuts[numbers]
        lengths = np.where(same, lengths, 0)
        ours = _lower[words.data[ragged(words.starts[at], lengths)]]
        differ = np.concatenate([[0], np.cumsum(ours != self.words[ragged(self.word_cuts[numbers], lengths)])])
        ends = np.cumsum(lengths)
        return same & (differ[ends] == differ[ends - lengths])


def distinct_words(hashes: np.ndarray, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the distinct words, the places between them, and each word's number among them."""
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(hashes), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    encoded = text.dictionary_encode()
    words, places = string_bytes(encoded.dictionary)
    return words, places, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def window_sets(items: DataFrame, size: int, set_bytes: int) -> list[WindowSet]:
    """The windows of all items, dealt by hash to as many sets as it takes to keep each within ``set_bytes``.

    Pairs of window and item are dealt, so a window that very many items have is no larger than others.
    """
    windows = stored(item_windows(items, size), "windows")
    total = windows.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    # Half of the room is left for sets that get more than the mean.
    count = -(-2 * total // set_bytes)
    deal = F.pmod(F.xxhash64("window", "item_id"), F.lit(max(1, count)))
    return [WindowSet(windows.filter(deal == k).select("window", "item_id").toArrow()) for k in range(count)]


def scan(batch: pa.RecordBatch, windows: WindowSet) -> tuple[Words, list[np.ndarray], list[np.ndarray]]:
    """The words, and for each text its maximal runs of hit words (first, end) and the distinct items found."""
    words = Words(batch.column("text"))
    first, size, window = windows.find(words)
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + size, -1)
    hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    # A run ends with its text.
    begins, ends = hit[1:] & ~hit[:-1], hit[:-1] & ~hit[1:]
    cuts = words.places[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(words.hashes))])
    cuts = cuts[hit[cuts] & hit[cuts + 1]]
    begins[cuts] = ends[cuts] = True
    runs = np.stack([np.flatnonzero(begins), np.flatnonzero(ends)], axis=1)
    text = np.searchsorted(words.places, first, "right") - 1
    pairs = np.unique(np.stack([text, window]), axis=1)
    counts = windows.item_ends[pairs[1] + 1] - windows.item_ends[pairs[1]]
    found = np.stack([np.repeat(pairs[0], counts), windows.items[ragged(windows.item_ends[pairs[1]], counts)]])
    found = np.unique(found, axis=1) if found.size else found
    texts = np.arange(batch.num_rows + 1)
    items = np.split(found[1], np.searchsorted(found[0], texts[1:-1]))
    spans = np.split(runs, np.searchsorted(runs[:, 0], words.places[1:-1]))
    return words, spans, items


def matches(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """``row, text`` with ``n_words, spans, items``: spans are ``first, end`` in words and ``low, high`` in bytes."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(windows)
    span = pa.struct([(name, pa.int64()) for name in ("first", "end", "low", "high")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, spans, items = scan(part, shared.value)
                runs = np.concatenate([np.zeros((0, 2), np.int64), *spans])
                base, of = np.repeat(words.places[:-1], [len(s) for s in spans]), np.repeat(words.offsets[:-1], [len(s) for s in spans])
                columns = [runs[:, 0] - base, runs[:, 1] - base]
                columns += [words.starts[runs[:, 0]] - of, words.ends[runs[:, 1] - 1] - of]
                ends = lambda parts: pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(span))
                ids = pa.array(np.concatenate([np.zeros(0, np.int64), *items]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(words.lengths), pa.ListArray.from_arrays(ends(spans), structs), pa.ListArray.from_arrays(ends(items), ids)],
                    [*part.schema.names, "n_words", "spans", "items"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    spans = "array<struct<first: bigint, end: bigint, low: bigint, high: bigint>>"
    return docs.mapInArrow(run, f"{kinds}, n_words long, spans {spans}, items array<long>")


def merged(spans: Column) -> Column:
    """Runs of several sets as maximal runs; those that meet or touch become one."""
    runs = F.array_sort(spans)
    join = lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["end"]),
        F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(
                F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                    F.element_at(done, -1)["low"].alias("low"),
                    F.greatest(F.element_at(done, -1)["high"], s["high"]).alias("high"),
                )
            ),
        ),
    ).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(runs, F.filter(spans, lambda s: F.lit(False)), join)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    item_column: str = "item_id",
    item_text: str = "text",
    text_column: str = "text",
    size: int = 10,
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``row, n_words, spans, items`` for each document: its row, its words, the runs of words hit, and the items found.

    A word is hit if it stands in any occurrence of a window of any item. ``spans`` holds the maximal runs of hit words
    as ``first, end`` (numbers of words) and ``low, high`` (bytes of the text), ``items`` the distinct ids of items that
    have an occurring window. Every occurrence is verified word by word.

    The windows are broadcast as a set of at most about ``set_bytes``, whose size is known before; a larger benchmark is
    dealt to several sets, each of which passes over the stored documents by itself. Documents are neither shuffled nor
    gathered.

    A null or empty text has no words. Rows that repeat an item's id are one item; an item without id hits words, but is
    counted for nobody; items without words have no windows. Rows that repeat a document, or have no id, come out as they
    are. Other columns are ignored, whatever their names; an empty table gives no rows, and no item hits nothing.
    """
    items = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    docs = docs.select(whole_row(docs), F.col(text_column).alias("text"))
    sets = window_sets(items, size, set_bytes) or [WindowSet(pa.table({"window": pa.array([], pa.string()), "item_id": pa.array([], pa.int64())}))]
    if len(sets) == 1:
        return matches(docs, sets[0]).select("row", "n_words", "spans", "items")
    docs = stored(docs.withColumn("key", F.monotonically_increasing_id()), "documents")
    texts = docs.select("key", "text")
    sizes = stored(matches(texts, sets[0]).select("key", "n_words", "spans", "items"), "matches")
    found = sizes.select("key", "spans", "items")
    for windows in sets[1:]:
        more = matches(texts, windows).filter("size(spans) > 0").select("key", "spans", "items")
        found = found.unionByName(stored(more, "matches"))
    together = found.groupBy("key").agg(
        merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return docs.select("key", "row").join(sizes.select("key", "n_words"), "key").join(together, "key").drop("key")


def decontaminate(
    docs: DataFrame, items: DataFrame, whole_documents: bool = False, most_hit: float = 0.0, text_column: str = "text", **options: object
) -> DataFrame:
    """The documents without what they hold of the benchmark, with their own columns.

    Either the spans of hit words are cut out of the texts (bytes from the first word's start to the last one's end), or,
    with ``whole_documents``, documents go of whose words more than the share ``most_hit`` is hit. ``options`` are those
    of ``contamination``.
    """
    found = contamination(docs, items, text_column=text_column, **options)
    if whole_documents:
        hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
        return found.filter(hit <= most_hit * F.col("n_words")).select("row.*")
    text = F.col(f"row.`{text_column}`")
    data = text.cast("binary")
    # What stands before each span, from the end of the one before; then what is left after the last.
    state = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<binary>").alias("parts"))
    kept = F.aggregate(
        "spans",
        state,
        lambda s, span: F.struct(
            (span["high"] + 1).alias("at"),
            F.concat(s["parts"], F.array(F.substring(data, s["at"].cast("int"), (span["low"] + 1 - s["at"]).cast("int")))).alias("parts"),
        ),
        lambda s: F.concat(s["parts"], F.array(F.substring(data, s["at"].cast("int"), F.octet_length(data)))),
    )
    joined = F.aggregate(kept, F.lit(b""), lambda done, part: F.concat(done, part)).cast("string")
    new = F.when(F.size("spans") > 0, joined).otherwise(text)
    return found.select(*[(new if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
