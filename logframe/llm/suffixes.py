"""Repeated long strings over all documents, found by sorting suffixes bucket by bucket with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import anchor_runs
from .groups import sorted_groups
from .store import discard, scratch, stored
from .text import U64, string_bytes

#: A difference cover: every difference modulo ``PERIOD`` is one of two of these numbers (fixed values).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: A string's anchor is a quarter of its length. An anchor with more different contexts than ``MANY`` is split by
#: the distance from the anchor, ``SLOTS`` distances to a bucket.
MANY, SLOTS = 2000, 4
#: Buckets are sorted together up to so many bytes of text.
BLOCK_BYTES = 1 << 20

_in_cover = np.zeros(PERIOD, bool)
_in_cover[list(COVER)] = True


def names(*parts: np.ndarray) -> np.ndarray:
    """Ranks of rows of equal-length parts in their order; equal rows have equal ranks."""
    order = np.lexsort(parts[::-1])
    change = np.zeros(len(order), bool)
    for part in parts:
        sorted_ = part[order]
        change[1:] |= sorted_[1:] != sorted_[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(change)
    return ranks


class CoverRanks:
    """Compares strings of ``length`` bytes of a text by ranks computed beforehand.

    Ranks of the first ``PERIOD`` bytes are known for all places, ranks of a multiple of that for the places in
    the cover only: doubling from one of these places leads to another. The middle of a string is then told by the rank
    of a place in the cover; the same step leads to one from all places with the same remainder.
    """

    def __init__(self, text: np.ndarray, length: int) -> None:
        self.length, n = length, len(text)
        padded = np.concatenate([text, np.zeros(8 * PERIOD, np.uint8)])
        eight = np.zeros(n, U64)
        for k in range(8):
            eight = eight << U64(8) | padded[k : k + n].astype(U64)
        at = lambda ranks, by: np.concatenate([ranks[by:], np.full(min(by, n), -1)])
        first = names(eight)
        first = names(first, at(first, 8))
        self.first = names(first, at(first, PERIOD - 16))
        self.places = np.flatnonzero(_in_cover[np.arange(n) % PERIOD])
        self.row = np.full(n + 8 * PERIOD, -1)
        self.row[self.places] = np.arange(len(self.places))
        self.depth, self.ranks = PERIOD, self.first[self.places]
        while 2 * self.depth + PERIOD <= length:
            ahead = self.row[self.places + self.depth]
            self.ranks = names(self.ranks, np.where(ahead < 0, -1, self.ranks[ahead]))
            self.depth *= 2
        # Behind the first two ranks of single places, steps to places in the cover until one more rank reaches the end.
        steps = []
        for r in range(PERIOD):
            known, own = 2 * PERIOD, []
            while known < length - PERIOD:
                most = min(known, length - self.depth)
                own.append(next(k for k in range(most, -1, -1) if _in_cover[(r + k) % PERIOD]))
                known = own[-1] + self.depth
            steps.append(own)
        count = max(map(len, steps))
        self.steps = np.array([own + own[-1:] * (count - len(own)) for own in steps], np.int64).reshape(PERIOD, count)

    def keys(self, starts: np.ndarray) -> list[np.ndarray]:
        """Ranks that, one after the other, order the strings that begin at these places."""
        middle = starts[:, None] + self.steps[starts % PERIOD]
        return [
            self.first[starts],
            self.first[starts + PERIOD],
            *self.ranks[self.row[middle]].T,
            self.first[starts + self.length - PERIOD],
        ]


def repeated_starts(buckets: np.ndarray, contexts: list[bytes], places: np.ndarray, away: np.ndarray, length: int) -> list[np.ndarray]:
    """Which of each context's strings also begin in another context of the same bucket, at the same distance.

    ``away`` is the distance from a context's first place to its anchor. Contexts are laid out so that equal distances
    have equal remainders. Suffixes are sorted by bucket and distance, then by the ranks; equal neighbours repeat.
    """
    sizes = np.array([len(c) for c in contexts])
    begin = np.zeros(len(contexts), np.int64)
    at = 0
    for k, size in enumerate(sizes):
        begin[k] = at + (-int(away[k]) - at) % PERIOD
        at = int(begin[k] + size)
    text = np.zeros(at, np.uint8)
    for start, context in zip(begin, contexts):
        text[start : start + len(context)] = np.frombuffer(context, np.uint8)
    ranks = CoverRanks(text, length)
    owner = np.repeat(np.arange(len(contexts)), places)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
    keys = [buckets[owner], away[owner] - inside, *ranks.keys(begin[owner] + inside)]
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for key in keys:
        sorted_ = key[order]
        same &= sorted_[1:] == sorted_[:-1]
    found = np.zeros(len(order), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return np.split(found, np.cumsum(places)[:-1])


def stretches(mask: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    return np.stack([edges[::2], edges[1::2] - 1], axis=1)


def runs_of(texts: DataFrame, length: int) -> DataFrame:
    """The runs of places of all texts that share an anchor."""
    fields = ("anchor", "first", "places", "away", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for k in range(batch.num_rows):
                for found in anchor_runs(data[offsets[k] : offsets[k + 1]], length, length // 4):
                    columns = dict(zip(fields, found))
                    n = len(columns["first"])
                    head = [batch.column(c).take(pa.array(np.full(n, k))) for c in ("doc_id", "digest", "n_bytes")]
                    rows = [pa.array(columns[c].astype(np.int64) if c != "anchor" and c != "whole" else columns[c].view(np.int64)) for c in fields]
                    yield pa.RecordBatch.from_arrays([*head, *rows], ["doc_id", "digest", "n_bytes", *fields])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in run(batches):
            waiting.append(batch)
            rows += batch.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, rows = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    kinds = "doc_id long, digest long, n_bytes long, anchor long, first long, places long, away long, whole long"
    return texts.filter(F.col("n_bytes") >= length).mapInArrow(gathered, kinds)


def contexts_of(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the asked runs, with the bucket in which their suffixes are sorted.

    A bucket is an anchor; where that has many contexts, a range of distances from it, and all the bytes that strings at
    these distances have in common.
    """
    columns = F.struct("anchor", "whole", "first", "places", "away", "many", "often")
    wanted = asked.groupBy("doc_id", "digest", "n_bytes").agg(F.collect_list(columns).alias("runs"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc_id", "digest", "n_bytes")]
    joined = texts.alias("t").join(wanted.alias("w"), same).select("t.text", "w.runs")
    names_ = ["anchor", "whole", "slot", "common", "skip", "places", "away", "often", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            rows: list[tuple] = []
            for k, runs in enumerate(batch.column("runs").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                for r in runs:
                    near, far = r["away"] - r["places"] + 1, r["away"]
                    slots = range(near // SLOTS, far // SLOTS + 1) if r["many"] else [-1]
                    for slot in slots:
                        low, high = (max(near, slot * SLOTS), min(far, slot * SLOTS + SLOTS - 1)) if r["many"] else (near, far)
                        skip = far - high
                        begin, common = r["first"] + skip, 0
                        if r["many"]:
                            anchor = r["first"] + far
                            shared = text[anchor - slot * SLOTS : anchor - slot * SLOTS - SLOTS + 1 + length]
                            common = int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True)
                        context = text[begin : begin + high - low + length]
                        rows.append((r["anchor"], r["whole"], slot, common, skip, high - low + 1, high, r["often"], context))
                if len(rows) > 5000:
                    yield table_of(rows)
                    rows = []
            if rows:
                yield table_of(rows)

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds_ = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds_)], names_)

    kinds = "anchor long, whole long, slot long, common long, skip long, places long, away long, often boolean, context binary"
    return joined.mapInArrow(run, kinds)


def sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """``anchor, whole, low, high``: places of runs, counted from the run's first one, whose strings repeat.

    Equal contexts are one row before they are dealt to buckets, so that a bucket holds different ones only. All strings
    of a context that several runs have repeat; those runs are found by the context's hash.
    """
    contexts = stored(contexts.withColumn("hash", F.xxhash64("context")), "contexts")
    keys, same = ["anchor", "slot", "common"], ["anchor", "slot", "common", "places", "away", "hash"]
    # Where a context has one run, the smallest values are that run's own.
    own = [F.min("whole").alias("whole"), F.min("skip").alias("skip"), F.max("often").alias("often")]
    different = contexts.groupBy(*same, "context").agg(F.count("*").alias("n"), *own)
    different = stored(different, "contexts")
    shared = different.filter("n > 1").select(*same).distinct()
    places = contexts.filter("NOT often").join(shared, same)
    places = places.select("anchor", "whole", F.col("skip").alias("low"), (F.col("skip") + F.col("places") - 1).alias("high"))
    together = different.repartition(*keys).sortWithinPartitions(*keys)

    def solve(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(groups)
        bucket = np.repeat(np.arange(len(groups)), [g.num_rows for g in groups])
        n, often, anchor, whole, skip, count, away = (
            rows.column(c).to_numpy() for c in ("n", "often", "anchor", "whole", "skip", "places", "away")
        )
        masks = repeated_starts(bucket, rows.column("context").to_pylist(), count, away, length)
        out: list[tuple] = []
        # Runs that occur twice as they are need no answer, and those of shared contexts have theirs.
        for k in np.flatnonzero((n == 1) & ~often.astype(bool)):
            for low, high in stretches(masks[k]):
                out.append((anchor[k], whole[k], skip[k] + low, skip[k] + high))
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "whole", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for group in sorted_groups(batches, keys):
            if group.num_rows < 2:
                continue
            waiting.append(group)
            size += group.column("context").nbytes
            if size > BLOCK_BYTES:
                yield from solve(waiting)
                waiting, size = [], 0
        if waiting:
            yield from solve(waiting)

    return together.mapInArrow(run, "anchor long, whole long, low long, high long").unionByName(places)


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """``digest, n_bytes, spans``: bytes of each different text that lie in a string of ``length`` bytes that repeats.

    ``texts`` has ``doc_id, digest, n_bytes, text``. Spans are pairs of first byte and end, in no order, and may overlap.
    """
    runs = stored(runs_of(texts, length), "runs")
    anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    anchors = stored(anchors.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    twice = stored(runs.join(anchors, "anchor"), "repeats")
    discard(runs)

    mixed = twice.filter("mixed")
    first = F.min(F.struct("doc_id", "digest", "n_bytes", "first", "places", "away")).alias("at")
    different = mixed.groupBy("anchor", "whole").agg(F.count("*").alias("n"), first)
    different = stored(different.select("anchor", "whole", (F.col("n") > 1).alias("often"), "at.*"), "contexts")
    many = different.groupBy("anchor").agg((F.count("*") > MANY).alias("many"))
    asked = different.join(many, "anchor")
    found = stored(sorted_repeats(contexts_of(texts, asked, length), length), "repeats")

    full = twice.filter("NOT mixed").select("digest", "n_bytes", "first", (F.col("first") + F.col("places")).alias("last"))
    copied = different.filter("often").select("anchor", "whole", F.lit(0).cast("long").alias("low"), (F.col("places") - 1).alias("high"))
    parts = mixed.join(found.unionByName(copied), ["anchor", "whole"])
    parts = parts.select("digest", "n_bytes", (F.col("first") + F.col("low")).alias("first"), (F.col("first") + F.col("high") + 1).alias("last"))
    spans = full.unionByName(parts).distinct()
    span = F.struct("first", (F.col("last") - 1 + length).alias("end"))
    return spans.groupBy("digest", "n_bytes").agg(F.collect_list(span).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s["first"], s["end"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def cut_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = 200,
    kept_column: str = "kept",
    as_text: bool = False,
) -> DataFrame:
    """Documents without the bytes that lie in a string of ``length`` bytes that also begins anywhere else.

    Adds ``n_bytes``, ``removed`` (pairs of first byte and end, in order, apart) and ``kept_column``, the other bytes
    one after the other: as bytes, or ``as_text`` without what is left of characters that were cut in two. Texts count as UTF-8; matches stay inside a document; repeats in one document, overlapping
    ones too, count. A null text is empty and has nothing removed. Rows that repeat a text, or a whole row, are
    copies: of at least ``length`` bytes, all of them are removed. A null id is an id like others. Columns of
    the new names are replaced, all others stay; an empty table gives no rows. ``length`` must be 100 or more.

    Places of a text whose strings share an anchor, the part with the smallest hash, are a run. Only runs whose anchor
    occurs again can repeat. Runs that are the same all over repeat in whole; of the others, one of each kind is
    fetched, and its suffixes are sorted in the bucket of its anchor, a bounded part of the buckets at a time. Texts are
    told apart by 64 bits of hash and their length, runs by the same within an anchor.
    """
    names_ = [c for c in docs.columns if c.lower() not in ("n_bytes", "removed", kept_column.lower())]
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names_]).alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    texts = rows.select("doc_id", "digest", "n_bytes", "text")
    copies = rows.select("digest", "n_bytes").filter(F.col("n_bytes") >= length)
    copies = copies.groupBy("digest", "n_bytes").agg(F.count("*").alias("n")).filter("n > 1")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("end")))
    with scratch(docs.sparkSession) as keep:
        copies = stored(copies.select("digest", "n_bytes", whole.alias("spans")), "copies")
        parts = repeated_spans(texts, length).join(copies.drop("spans"), ["digest", "n_bytes"], "left_anti")
        spans = keep(parts.unionByName(copies), "spans")
    joined = rows.join(spans, ["digest", "n_bytes"], "left").select("row", "n_bytes", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            removed, kept = [], []
            for k, own in enumerate(batch.column("spans").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                cuts = merged(own)
                at, rest = 0, []
                for first, end in cuts:
                    rest.append(text[at:first])
                    at = end
                removed.append([{"first": a, "end": b} for a, b in cuts])
                kept.append(b"".join([*rest, text[at:]]))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            rest = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            columns = [batch.column("row"), batch.column("n_bytes"), pa.array(removed, kind), rest]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_bytes", "removed", "kept"])

    kind = rows.schema["row"].dataType.simpleString()
    kept_kind = "string" if as_text else "binary"
    out = joined.mapInArrow(run, f"row {kind}, n_bytes long, removed array<struct<first: long, end: long>>, kept {kept_kind}")
    return out.select("row.*", "n_bytes", "removed", F.col("kept").alias(kept_column))
