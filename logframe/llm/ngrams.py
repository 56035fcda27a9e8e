"""Language model scores from a sharded n-gram trie with Elias-Fano levels."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import shuffles_deleted
from .eliasfano import EliasFano
from .store import discard, small_batches, stored
from .text import BASE, U64, mix, pieces, ragged, word_hashes

#: Rows of packed arrays that a task gets at a time.
BATCH_ROWS = 128
#: Tokens of one chunk of texts, and pairs (and triples) of tokens in one shard of the model.
CHUNK_TOKENS, SHARD_TOKENS = 1_500_000, 2_500_000
#: Words with this share of all tokens are dealt to shards by their neighbours.
HEAVY = 0.01
#: So many asked pairs of a shard, of whatever chunks, are gathered before they are searched: a search decodes the whole level.
ASKED_PAIRS = 1_000_000
#: So many unseen pairs are gathered before their contexts' shards are asked.
BACK_PAIRS = 200_000
START, END = (mix(np.array([k], U64))[0] for k in (1 << 60, 1 << 61))
MESSAGE = "kind int, shard long, chunk long, blob binary"
DOCS, PART, ASK, BACK, CONTEXTS, PAIRS, TRIE, TRIPLES = range(8)


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as compressed bytes, each with equal bytes of its numbers together; rising whole numbers as their differences."""
    head, body = [len(arrays)], []
    for array in arrays:
        rises = len(array) > 1 and array.dtype.kind == "u" and bool((array[1:] >= array[:-1]).all())
        head += [ord(array.dtype.char), -array.dtype.itemsize if rises else array.dtype.itemsize, len(array)]
        array = np.concatenate([array[:1], array[1:] - array[:-1]]) if rises else array
        body.append(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes() if len(array) else b"")
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def unpacked(blob: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    count = int(data[:8].view(np.int64)[0])
    head = data[8 : 8 + 24 * count].copy().view(np.int64).reshape(-1, 3)
    at, out = 8 + 24 * count, []
    for char, size, n in head.tolist():
        rises, size = size < 0, abs(size)
        array = np.ascontiguousarray(data[at : at + size * n].reshape(size, n).T).reshape(-1).view(np.dtype(chr(char)))
        out.append(np.cumsum(array, dtype=array.dtype) if rises else array)
        at += size * n
    return out


def messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "shard", "chunk", "blob"])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two 32-bit numbers as one, in the order of both."""
    return a.astype(U64) << U64(32) | b.astype(U64)


def apart(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> U64(32)).astype(np.uint32), (pairs & U64(0xFFFFFFFF)).astype(np.uint32)


def firsts(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_)), bool), sorted_[1:] != sorted_[:-1]]))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for two words in their order."""
    with np.errstate(over="ignore"):
        return mix(first * U64(BASE) + second)


@dataclass
class Chunk:
    """Tokens of some documents, each with the two before it and its document's number, as numbers of ``words``."""

    number: int
    doc_ids: pa.Array
    lengths: np.ndarray
    words: np.ndarray
    first: np.ndarray
    before: np.ndarray
    token: np.ndarray
    owner: np.ndarray


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Documents ``doc_id, text`` in chunks of about ``CHUNK_TOKENS``."""
    waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    number = TaskContext.get().partitionId() << 32

    def made() -> Chunk:
        ids = pa.concat_arrays([w[0] for w in waiting])
        lengths = np.concatenate([w[2] for w in waiting])
        hashes = np.concatenate([w[1] for w in waiting])
        waiting.clear()
        ends = np.cumsum(lengths + 1)
        words, places = np.unique(np.concatenate([hashes, np.array([START, END], U64)]), return_inverse=True)
        places = places.astype(np.uint32)
        start, end = places[-2:]
        token = np.full(len(hashes) + len(lengths), end, np.uint32)
        inside = np.ones(len(token), bool)
        inside[ends - 1] = False
        token[inside] = places[:-2]
        before = np.empty(len(token), np.uint32)
        before[1:] = token[:-1]
        before[ends - lengths - 1] = start
        first = np.empty(len(token), np.uint32)
        first[1:] = before[:-1]
        first[ends - lengths - 1] = start
        owner = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths + 1)
        return Chunk(number, ids, lengths + 1, words, first, before, token, owner)

    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, places = word_hashes(part.column("text"))
            waiting.append((part.column("doc_id"), hashes, np.diff(places)))
            if sum(len(w[1]) + len(w[2]) for w in waiting) >= CHUNK_TOKENS:
                yield made()
                number += 1
    if waiting:
        yield made()


@dataclass
class Corpus:
    """What is told to all tasks: sizes of the training text, and its few very frequent words."""

    shards: int
    tokens: int = 0
    distinct: int = 0
    discount: float = 0.75
    #: Word to its number of tokens, and of different words after it.
    heavy: dict[int, tuple[int, int]] = field(default_factory=dict)
    order: int = 2
    #: As ``discount`` and ``heavy``, of triples, and of pairs before a word.
    triple_discount: float = 0.75
    heavy_pairs: dict[int, tuple[int, int]] = field(default_factory=dict)

    def pairs_known(self) -> tuple[np.ndarray, np.ndarray]:
        """Heavy pairs, and their numbers of tokens, and of different words after them."""
        pairs = sorted(self.heavy_pairs)
        return np.array(pairs, U64), np.array([self.heavy_pairs[p] for p in pairs], np.int64).reshape(-1, 2)

    def shard_of_pair(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where what comes after a pair is counted."""
        by = np.where(np.isin(pair, self.pairs_known()[0]), mix(word), pair)
        return (by % U64(self.shards)).astype(np.int64)

    def heavy_words(self) -> np.ndarray:
        return np.array(sorted(self.heavy), U64)

    def shard_of(self, word: np.ndarray, other: np.ndarray) -> np.ndarray:
        by = np.where(np.isin(word, self.heavy_words()), mix(other), word)
        return (by % U64(self.shards)).astype(np.int64)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of add-one probabilities, one word that was never seen included."""
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))

    def back_off(self, counts: np.ndarray, after: np.ndarray, order: int = 2) -> np.ndarray:
        """log10 of what a context leaves to words that were not seen after it; all, if it was not seen itself."""
        known, discount = counts > 0, self.discount if order == 2 else self.triple_discount
        return np.where(known, np.log10(np.where(known, discount * after, 1) / np.where(known, counts, 1)), 0.0)


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its rows, which keep their order."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(shards[own[0]]), own


def frequent(docs: DataFrame, order: int = 2) -> Corpus:
    """Heavy words and pairs, and the number of shards. A word with a share of all tokens has at least half of it in some chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            least = HEAVY / 2 * len(chunk.token)
            counts = np.bincount(chunk.token, minlength=len(chunk.words))
            often = np.flatnonzero(counts >= least)
            found, times = chunk.words[often], counts[often]
            if order > 2:
                # Words of a heavy pair are heavy themselves, or a text's start.
                can = (counts >= least) | (chunk.words == START)
                own = can[chunk.first] & can[chunk.before]
                pairs, n = np.unique(joined(chunk.first[own], chunk.before[own]), return_counts=True)
                first, second = apart(pairs[n >= least])
                found = np.concatenate([found, pair_hash(chunk.words[first], chunk.words[second])])
                times = np.concatenate([times, n[n >= least]])
            hashes = [None, *found.view(np.int64).tolist()]
            of_pairs = np.arange(len(hashes)) > len(often)
            columns = [pa.array(hashes, pa.int64()), pa.array([len(chunk.token), *times], pa.int64()), pa.array(of_pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "pair"])

    rows = docs.mapInArrow(run, "word long, n long, pair boolean").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    total = stored(rows, "frequent")
    tokens = next((r.n for r in total.filter("word IS NULL").collect()), 0)
    often = total.filter(F.col("word").isNotNull() & (F.col("n") >= HEAVY / 2 * tokens)).select("word", "pair").collect()
    heavy = {r.word % (1 << 64): (0, 0) for r in often if not r.pair} | {int(START): (0, 0)}
    pairs = {r.word % (1 << 64): (0, 0) for r in often if r.pair} | {int(pair_hash(*np.array([[START], [START]], U64))[0]): (0, 0)}
    return Corpus(max(1, -(-tokens * (order - 1) // SHARD_TOKENS)), tokens, heavy=heavy, order=order, heavy_pairs=pairs if order > 2 else {})


def count_pairs(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Contexts with their counts, and pairs of words with theirs, dealt to the second word's shard: messages, and sums."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            pairs, counts = np.unique(joined(chunk.before, chunk.token), return_counts=True)
            before, token = apart(pairs)
            shards = corpus.shard_of(chunk.words[before], chunk.words[token])
            rows = []
            for shard, own in by_shard(shards):
                left, ours = np.unique(before[own], return_counts=True)
                right, place = np.unique(token[own], return_inverse=True)
                arrays = [chunk.words[left], ours.astype(np.uint32), chunk.words[right], place.astype(np.uint32), counts[own].astype(np.uint32)]
                rows.append((PAIRS, shard, 0, packed(arrays)))
            yield messages(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in shard_rows(batches):
            parts = [unpacked(b) for _, _, b in blobs]
            left, l_place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            right, r_place = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            l_at, r_at, keys, counts = 0, 0, [], []
            for p in parts:
                a = np.repeat(l_place[l_at : l_at + len(p[0])], p[1])
                keys.append(joined(a, r_place[r_at : r_at + len(p[2])][p[3]]))
                counts.append(p[4])
                l_at, r_at = l_at + len(p[0]), r_at + len(p[2])
            del parts
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = firsts(keys)
            keys, counts = keys[first], np.add.reduceat(counts, first, dtype=np.int64)
            before, token = apart(keys)
            total = np.bincount(before, counts, len(left)).astype(np.int64)
            after = np.bincount(before, minlength=len(left))
            heavy = np.isin(left, corpus.heavy_words())
            sums = [(int((~heavy).sum()), int((counts == 1).sum()), int((counts == 2).sum()))]
            rows = [(CONTEXTS, shard_number(left[~heavy], corpus), 0, packed([left[~heavy], total[~heavy], after[~heavy]]))]
            for k in np.flatnonzero(heavy):
                rows.append((TRIE, int(left[k].view(np.int64)), int(total[k]), None))
                sums.append((int(after[k]), 0, 0))
            for shard, own in by_shard(corpus.shard_of(right[token], left[before])):
                l_own, a = np.unique(before[own], return_inverse=True)
                r_own, b = np.unique(token[own], return_inverse=True)
                arrays = [left[l_own], total[l_own], after[l_own], right[r_own], a.astype(np.uint32), b.astype(np.uint32), counts[own].astype(np.uint32)]
                rows.append((PAIRS, shard, 0, packed(arrays)))
                sums.append((0, 0, 0))
            batch = messages(rows)
            extra = [pa.array(c, pa.int64()) for c in zip(*sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "n", "ones", "twos"])

    dealt = docs.mapInArrow(split, MESSAGE).repartition("shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(merge, MESSAGE + ", n long, ones long, twos long"), "pairs", "kind")


def count_triples(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """As ``count_pairs``, of pairs with the words after them: those go to the shard of the last word with the one before it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            pairs, place = np.unique(joined(chunk.first, chunk.before), return_inverse=True)
            triples, counts = np.unique(joined(place, chunk.token), return_counts=True)
            first, before = apart(pairs)
            place, token = apart(triples)
            hashes = pair_hash(chunk.words[first], chunk.words[before])
            rows = []
            for shard, own in by_shard(corpus.shard_of_pair(hashes[place], chunk.words[token])):
                left, ours = np.unique(place[own], return_counts=True)
                arrays = [*numbered(chunk.words, first[left], before[left], token[own]), ours.astype(np.uint32), counts[own].astype(np.uint32)]
                rows.append((TRIPLES, shard, 0, packed(arrays)))
            yield messages(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, _ = corpus.pairs_known()
        for _, blobs in shard_rows(batches):
            parts = [unpacked(b) for _, _, b in blobs]
            words, (first, before, token) = together(parts)
            pairs, place = np.unique(joined(first, before), return_inverse=True)
            keys = joined(np.repeat(place, np.concatenate([p[4] for p in parts])), token)
            counts = np.concatenate([p[5] for p in parts])
            del parts, first, before, token, place
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            begin = firsts(keys)
            keys, counts = keys[begin], np.add.reduceat(counts, begin, dtype=np.int64)
            place, token = apart(keys)
            total = np.bincount(place, counts, len(pairs)).astype(np.int64)
            after = np.bincount(place, minlength=len(pairs))
            first, before = apart(pairs)
            hashes = pair_hash(words[first], words[before])
            is_heavy = np.isin(hashes, heavy)
            by_hash = np.argsort(hashes)
            by_hash = by_hash[~is_heavy[by_hash]]
            light = hashes[by_hash]
            rows = [(CONTEXTS, shard_number(light, corpus), 1, packed([light, total[by_hash], after[by_hash]]))]
            sums = [(0, int((counts == 1).sum()), int((counts == 2).sum()))]
            for k in np.flatnonzero(is_heavy):
                rows.append((TRIE, int(hashes[k : k + 1].view(np.int64)[0]), int(total[k]), None))
                sums.append((int(after[k]), 0, 0))
            for shard, own in by_shard(corpus.shard_of(words[token], words[before[place]])):
                left, at = np.unique(place[own], return_inverse=True)
                sizes = [a.astype(np.uint32) for a in (total[left], after[left], at, counts[own])]
                rows.append((TRIPLES, shard, 0, packed([*numbered(words, first[left], before[left], token[own]), *sizes])))
                sums.append((0, 0, 0))
            batch = messages(rows)
            extra = [pa.array(c, pa.int64()) for c in zip(*sums)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "n", "ones", "twos"])

    dealt = docs.mapInArrow(split, MESSAGE).repartition("shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(merge, MESSAGE + ", n long, ones long, twos long"), "triples", "kind")


def numbered(words: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """The words that some numbers mean, and the numbers within those."""
    used, place = np.unique(np.concatenate(numbers), return_inverse=True)
    return [words[used], *np.split(place.astype(np.uint32), np.cumsum([len(n) for n in numbers])[:-1])]


def together(parts: list[list[np.ndarray]], columns: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words and numbers of several ``numbered`` as of one."""
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    begins = np.cumsum([0, *(len(p[0]) for p in parts)])
    place = place.astype(np.uint32)
    return words, [np.concatenate([place[at:][p[1 + c]] for at, p in zip(begins, parts)]) for c in range(columns)]


def shard_number(words: np.ndarray, corpus: Corpus) -> int:
    """The shard of contexts that are not heavy and share one; -1 for none."""
    return int(words[0] % U64(corpus.shards)) if len(words) else -1


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each shard, which come one after the other: kind, chunk and blob."""
    last, rows = None, []
    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "kind", "chunk", "blob")]
        for k in range(batch.num_rows):
            shard, kind, chunk, blob = (c[k].as_py() for c in columns)
            if shard != last and rows:
                yield last, rows
                rows = []
            last = shard
            rows.append((kind, chunk, blob))
    if rows:
        yield last, rows


class Trie:
    """Words, and below each the words seen before it, with the probability of the first after the second.

    Levels are rising sequences: the words' hashes; pointers to where each word's successors in the next level begin;
    and those successors as numbers of a shared list of contexts, plus the word's number times the length of that list,
    by which the whole level rises. Probabilities are one byte each, which a table of 256 values explains.

    A third level, if there is one, has below each pair (a word and the one before it) the words seen before both. They are
    numbered by their place among all words that the shard has seen before the pair's first word, found between that word's
    pointers: such a number is small, whatever the number of words.
    """

    def __init__(self, data: bytes | mmap.mmap) -> None:
        sizes = np.frombuffer(data, np.int64, 1)[0]
        head = np.frombuffer(data, np.int64, int(sizes) * 3, 8).reshape(-1, 3)
        arrays = [np.frombuffer(data, np.dtype(chr(c)), int(n), int(at)) for c, at, n in head]
        self.words, self.contexts, self.pointers, self.level = (EliasFano(arrays[5 * k : 5 * k + 5]) for k in range(4))
        self.counts, self.codes, self.table = arrays[20:23]
        if len(arrays) > 23:
            self.firsts, self.befores, self.ranges, self.third = (EliasFano(arrays[5 * k + 23 : 5 * k + 28]) for k in range(4))
            self.most, self.third_codes, self.third_table = arrays[43:]

    @staticmethod
    def coded(logs: np.ndarray) -> list[np.ndarray]:
        """One byte for each number, and the 256 values they stand for."""
        edges = np.linspace(logs.min(), logs.max(), 257)[1:-1] if len(logs) else np.zeros(0)
        codes = np.searchsorted(edges, logs).astype(np.uint8)
        sums, n = np.bincount(codes, logs, 256), np.bincount(codes, minlength=256)
        return [codes, sums / np.maximum(n, 1)]

    @staticmethod
    def build(
        words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray, logs: np.ndarray,
        third: tuple[np.ndarray, ...] | None = None,
    ) -> bytes:
        """``word`` and ``context`` are numbers in the sorted lists; pairs are in the order of both. ``third`` has a sorted list
        of words, and of each triple its first word as a number in it, its pair's number and its probability."""
        pointers = np.searchsorted(word, np.arange(len(words) + 1))
        level = word.astype(U64) * U64(len(contexts)) + context.astype(U64)
        arrays = [a for v in (words, contexts, pointers.astype(U64), level) for a in EliasFano.encode(v)]
        arrays += [counts.astype(np.int64), *Trie.coded(logs)]
        if third:
            firsts_, first, pair, third_logs = third
            befores, place = np.unique(joined(context[pair], first), return_inverse=True)
            of, number = apart(befores)
            ranges = np.searchsorted(of, np.arange(len(contexts) + 1))
            rank = place - ranges[context[pair]]
            most = int(np.diff(ranges).max(initial=1))
            keys = pair.astype(U64) * U64(most) + rank.astype(U64)
            order = np.argsort(keys, kind="stable")
            levels = (firsts_, of.astype(U64) * U64(max(1, len(firsts_))) + number.astype(U64), ranges.astype(U64), keys[order])
            arrays += [a for v in levels for a in EliasFano.encode(v)]
            arrays += [np.array([most]), *Trie.coded(third_logs[order])]
        at, head, body = 8 + 24 * len(arrays), [], []
        for array in arrays:
            gap = -at % 8
            head.append((ord(array.dtype.char), at + gap, len(array)))
            body += [bytes(gap), array.tobytes()]
            at += gap + array.nbytes
        return np.array([len(arrays)], np.int64).tobytes() + np.array(head, np.int64).tobytes() + b"".join(body)

    def look_up(self, words: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts of ``words``, for each pair the log10 probability, or nan if it was not seen, and the numbers of pairs and contexts."""
        number = self.words.find(words)
        counts = np.where(number >= 0, self.counts[np.maximum(number, 0)] if len(self.counts) else 0, 0)
        place = self.contexts.find(contexts)
        known = np.flatnonzero((number[word] >= 0) & (place[context] >= 0))
        found = np.full(len(word), -1, np.int64)
        found[known] = self.level.find(number[word[known]].astype(U64) * U64(self.contexts.n) + place[context[known]].astype(U64))
        logs = np.full(len(word), np.nan)
        logs[found >= 0] = self.table[self.codes[found[found >= 0]]]
        return counts, logs, found, place

    def look_up_third(self, words: np.ndarray, first: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
        """For each triple, whose first word is a number in ``words``, the log10 probability, or nan if it was not seen.

        ``pair`` and ``context`` are numbers that ``look_up`` gave, of the triple's last two words and the middle one.
        """
        logs = np.full(len(first), np.nan)
        number = self.firsts.find(words)[first]
        known = np.flatnonzero((pair >= 0) & (number >= 0))
        place = self.befores.find(context[known].astype(U64) * U64(max(1, self.firsts.n)) + number[known].astype(U64))
        known, place = known[place >= 0], place[place >= 0]
        rank = place - self.ranges.at(context[known]).astype(np.int64)
        found = self.third.find(pair[known].astype(U64) * U64(int(self.most[0])) + rank.astype(U64))
        logs[known[found >= 0]] = self.third_table[self.third_codes[found[found >= 0]]]
        return logs


def build_third(
    parts: list[list[np.ndarray]], words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, p: np.ndarray, corpus: Corpus
) -> tuple[np.ndarray, ...]:
    """What ``Trie.build`` takes for a third level. ``pairs`` are the shard's, rising, and ``p`` their probabilities."""
    own, (first, before, token) = together(parts)
    begins = np.cumsum([0, *(len(q[4]) for q in parts)])
    at = np.concatenate([begin + q[6].astype(np.int64) for begin, q in zip(begins, parts)])
    totals = np.stack([np.concatenate([q[k] for q in parts]) for k in (4, 5)], axis=1).astype(np.int64)
    n = np.concatenate([q[7] for q in parts])
    heavy, fixed = corpus.pairs_known()
    hashes = pair_hash(own[first], own[before])
    place = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
    totals = np.where((heavy[place] == hashes)[:, None], fixed[place], totals)
    # The triple's last two words are a pair of the same shard.
    of_word, of_context = np.searchsorted(words, own), np.searchsorted(contexts, own)
    pair = np.searchsorted(pairs, joined(of_word[token], of_context[before[at]]))
    left = 10 ** corpus.back_off(totals[:, 0], totals[:, 1], 3)
    logs = np.log10((n - corpus.triple_discount) / totals[at, 0] + left[at] * p[pair])
    listed, number = np.unique(own[first], return_inverse=True)
    return listed, number[at], pair, logs


def build_tries(pairs: DataFrame, corpus: Corpus, triples: DataFrame | None = None) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = corpus.heavy_words()
        fixed = np.array([corpus.heavy[int(w)] for w in heavy], np.int64).reshape(-1, 2)
        for shard, rows in shard_rows(batches):
            parts = [unpacked(b) for kind, _, b in rows if kind == PAIRS]
            contexts, c_place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            words, w_place = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            totals = np.zeros((len(contexts), 2), np.int64)
            totals[c_place] = np.concatenate([np.stack([p[1], p[2]], axis=1) for p in parts])
            at = np.searchsorted(contexts, heavy)
            hit = np.flatnonzero((at < len(contexts)) & (contexts[np.minimum(at, len(contexts) - 1)] == heavy))
            totals[at[hit]] = fixed[hit]
            word, context, c_at, w_at = [], [], 0, 0
            for p in parts:
                context.append(c_place[c_at : c_at + len(p[0])][p[4]])
                word.append(w_place[w_at : w_at + len(p[3])][p[5]])
                c_at, w_at = c_at + len(p[0]), w_at + len(p[3])
            n = np.concatenate([p[6] for p in parts])
            keys = joined(np.concatenate(word), np.concatenate(context))
            del parts, word, context
            order = np.argsort(keys, kind="stable")
            n, keys = n[order], keys[order]
            word, context = apart(keys)
            del order
            counts = np.bincount(word, n, len(words)).astype(np.int64)
            at = np.searchsorted(words, heavy)
            hit = np.flatnonzero((at < len(words)) & (words[np.minimum(at, len(words) - 1)] == heavy))
            counts[at[hit]] = fixed[hit, 0]
            left = 10 ** corpus.back_off(totals[:, 0], totals[:, 1])
            p = (n - corpus.discount) / totals[context, 0] + left[context] * 10 ** corpus.unigram(counts)[word]
            parts = [unpacked(b) for kind, _, b in rows if kind == TRIPLES]
            third = build_third(parts, words, contexts, keys, p, corpus) if parts else None
            del parts, keys
            yield messages([(TRIE, shard, 0, Trie.build(words, counts, contexts, word, context, np.log10(p), third))])

    dealt = pairs if triples is None else pairs.unionByName(triples)
    dealt = dealt.filter(F.col("kind").isin(PAIRS, TRIPLES)).select("kind", "shard", "chunk", "blob")
    return stored(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, MESSAGE), "trie")


def ask(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """What each chunk asks of each shard, and which documents it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches):
            ids = chunk.doc_ids.fill_null(0).to_numpy()
            missing = np.array(chunk.doc_ids.is_null().to_pylist(), np.uint8)
            rows = [(DOCS, -1, chunk.number, packed([ids, missing, chunk.lengths]))]
            pairs, keys = joined(chunk.token, chunk.before), None
            if corpus.order > 2:
                pairs, place = np.unique(pairs, return_inverse=True)
                keys = joined(place, chunk.first)
                del place
            # Tokens are in the order of their documents, and stay so within a pair or triple.
            order = np.argsort(pairs if keys is None else keys, kind="stable")
            owner = chunk.owner[order]
            if keys is None:
                pairs = pairs[order]
                begin = firsts(pairs)
                pairs = pairs[begin]
                per_pair, first = np.ones(len(pairs), np.int64), None
            else:
                keys = keys[order]
                begin = firsts(keys)
                of_pair, first = apart(keys[begin])
                per_pair = np.bincount(of_pair, minlength=len(pairs))
            del order, keys
            token, before = apart(pairs)
            times = np.diff(np.append(begin, len(owner)))
            begins = np.cumsum(per_pair) - per_pair
            for shard, own in by_shard(corpus.shard_of(chunk.words[token], chunk.words[before])):
                words, per_word = np.unique(token[own], return_counts=True)
                contexts, place = np.unique(before[own], return_inverse=True)
                asked = ragged(begins[own], per_pair[own])
                arrays = [chunk.words[words], per_word.astype(np.uint32), chunk.words[contexts], place.astype(np.uint32)]
                if first is not None:
                    arrays += [per_pair[own].astype(np.uint32), *numbered(chunk.words, first[asked])]
                arrays += [times[asked].astype(np.uint32), owner[ragged(begin[asked], times[asked])]]
                rows.append((ASK, shard, chunk.number, packed(arrays)))
            yield messages(rows)

    return docs.mapInArrow(run, MESSAGE)


def reply(trie: Trie | None, asked: list[tuple[int, list[np.ndarray]]], corpus: Corpus) -> Iterator[tuple[tuple, tuple]]:
    """Sums and unseen pairs of each chunk, after one search for what all of them ask."""
    words, w_place = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
    contexts, c_place = np.unique(np.concatenate([a[2] for _, a in asked]), return_inverse=True)
    word, place, w_at, c_at = [], [], 0, 0
    for _, (own, per_word, theirs, number, *_) in asked:
        word.append(np.repeat(w_place[w_at : w_at + len(own)], per_word))
        place.append(c_place[c_at : c_at + len(theirs)][number])
        w_at, c_at = w_at + len(own), c_at + len(theirs)
    word, place = np.concatenate(word), np.concatenate(place)
    if trie:
        counts, logs, found, numbers = trie.look_up(words, contexts, word, place)
    else:
        counts, logs = np.zeros(len(words), np.int64), np.full(len(word), np.nan)
    heavy = corpus.heavy_words()
    # A heavy word need not be in all its shards.
    at = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
    totals = np.array([corpus.heavy[int(w)][0] for w in heavy], np.int64)
    counts = np.where(heavy[at] == words, totals[at], counts)
    base = corpus.unigram(counts)
    fixed = np.array([corpus.back_off(*map(np.array, corpus.heavy[int(w)])) for w in heavy], np.float64)
    at = np.minimum(np.searchsorted(heavy, contexts), len(heavy) - 1)
    is_heavy = heavy[at] == contexts
    unseen = np.isnan(logs)
    score = np.where(unseen, base[word] + np.where(is_heavy, fixed[at], 0.0)[place], logs)
    open_ = unseen & ~is_heavy[place]
    # What is asked back: contexts, and which pairs or triples ask.
    late = [(contexts[place], open_)]
    if corpus.order > 2:
        pair = np.repeat(np.arange(len(word)), np.concatenate([a[4] for _, a in asked]))
        listed, (first,) = together([a[5:] for _, a in asked], 1)
        word, place = word[pair], place[pair]
        logs = trie.look_up_third(listed, first, found[pair], numbers[place]) if trie else np.full(len(pair), np.nan)
        hashes = pair_hash(listed[first], contexts[place])
        heavy_pairs, totals = corpus.pairs_known()
        at = np.minimum(np.searchsorted(heavy_pairs, hashes), len(heavy_pairs) - 1)
        is_heavy, unseen = heavy_pairs[at] == hashes, np.isnan(logs)
        fixed = corpus.back_off(totals[:, 0], totals[:, 1], 3)
        score = np.where(unseen, score[pair] + np.where(is_heavy, fixed[at], 0.0), logs)
        late = [(contexts[place], open_[pair]), (hashes, unseen & ~is_heavy)]
    values = ((counts > 0).astype(np.float64)[word], base[word], score)
    begin = 0
    for chunk, (*_, times, owner) in asked:
        own = slice(begin, begin := begin + len(times))
        owners, at = np.unique(owner, return_inverse=True)
        sums = [np.bincount(at, np.repeat(v[own], times), len(owners)) for v in values]
        asking = [np.repeat(open_[own], times) for _, open_ in late]
        backs = np.concatenate([np.repeat(context[own], times)[o] for (context, _), o in zip(late, asking)])
        left = (backs, np.full(len(backs), chunk), np.concatenate([owner[o] for o in asking]))
        yield (PART, -1, chunk, packed([owners, *sums])), left


def ask_back(left: list[tuple], corpus: Corpus) -> list[tuple]:
    """Contexts of pairs that were never seen, with their chunks and documents, for the contexts' shards."""
    contexts, chunks, owners = (np.concatenate(x) for x in zip(*left))
    rows = []
    for shard, own in by_shard((contexts % U64(corpus.shards)).astype(np.int64)):
        known, place = np.unique(contexts[own], return_inverse=True)
        numbers, number = np.unique(chunks[own], return_inverse=True)
        rows.append((BACK, shard, 0, packed([known, place.astype(np.uint32), numbers, number.astype(np.uint32), owners[own]])))
    return rows


def search(batches: Iterator[pa.RecordBatch], corpus: Corpus) -> Iterator[pa.RecordBatch]:
    """Answers of each shard, whose trie comes before what is asked of it."""
    last, trie, asked, left, waiting = None, None, [], [], 0

    def replies() -> Iterator[pa.RecordBatch]:
        for part, open_ in reply(trie, asked, corpus) if asked else ():
            left.append(open_)
            yield messages([part])
        asked.clear()
        if sum(len(open_[0]) for open_ in left) > BACK_PAIRS:
            yield messages(ask_back(left, corpus))
            left.clear()

    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "kind", "chunk", "blob")]
        for k in range(batch.num_rows):
            shard, kind, chunk, blob = (c[k].as_py() for c in columns)
            if kind == DOCS:
                yield messages([(kind, -1, chunk, blob)])
                continue
            if shard != last:
                yield from replies()
                last, trie, waiting = shard, None, 0
            if kind == TRIE:
                with tempfile.TemporaryFile() as file:
                    file.write(blob)
                    file.flush()
                    trie = Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
            else:
                asked.append((chunk, unpacked(blob)))
                waiting += len(asked[-1][1][-2])
                if waiting >= ASKED_PAIRS:
                    yield from replies()
                    waiting = 0
    yield from replies()
    if any(len(open_[0]) for open_ in left):
        yield messages(ask_back(left, corpus))


def answer(asked: DataFrame, tries: DataFrame, corpus: Corpus) -> DataFrame:
    """Sums of each chunk's documents, and pairs never seen, for which their contexts' shards are asked."""

    # Tries come before what is asked of them; documents need no shard.
    to = F.when(F.col("kind") == DOCS, -1 - F.pmod("chunk", F.lit(corpus.shards))).otherwise(F.col("shard"))
    rows = asked.unionByName(tries).withColumn("shard", to).withColumn("late", F.col("kind") != TRIE)
    rows = rows.repartition("shard").sortWithinPartitions("shard", "late").drop("late")
    return stored(rows.mapInArrow(lambda batches: search(batches, corpus), MESSAGE), "answers")


def backed_off(answers: DataFrame, contexts: DataFrame, corpus: Corpus) -> DataFrame:
    """What contexts leave to words that were not seen after them, summed for each chunk's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in shard_rows(batches):
            # Single words, and pairs.
            known = [(2 + chunk, *unpacked(blob)) for kind, chunk, blob in rows if kind == CONTEXTS]
            total: dict[int, list[np.ndarray]] = {}
            for kind, _, blob in rows:
                if kind == CONTEXTS:
                    continue
                contexts, place, numbers, number, owner = unpacked(blob)
                left = np.zeros(len(contexts))
                for order, words, n, after in known:
                    at = np.minimum(np.searchsorted(words, contexts), max(0, len(words) - 1))
                    hit = words[at] == contexts if len(words) else np.zeros(len(contexts), bool)
                    left[hit] = corpus.back_off(n[at[hit]], after[at[hit]], order)
                keys, at = np.unique(joined(number, owner), return_inverse=True)
                sums = np.bincount(at, left[place], len(keys))
                number, owner = apart(keys)
                for k, own in by_shard(number.astype(np.int64)):
                    total.setdefault(int(numbers[k]), []).append(np.stack([owner[own].astype(np.float64), sums[own]]))
            for chunk, parts in total.items():
                owner, sums = np.concatenate(parts, axis=1)
                nothing = np.zeros(len(owner))
                yield messages([(PART, -1, chunk, packed([owner.astype(np.uint32), nothing, nothing, sums]))])

    rows = answers.filter(F.col("kind") == BACK).unionByName(contexts).withColumn("late", F.col("kind") == BACK)
    return rows.repartition("shard").sortWithinPartitions("shard", "late").drop("late").mapInArrow(run, MESSAGE)


def sums_of(counted: DataFrame, heavy: dict[int, tuple[int, int]]) -> tuple[int, float | None]:
    """The number of contexts that are not heavy, and the discount; what was counted of heavy ones goes to ``heavy``."""
    contexts = F.sum(F.when(F.col("kind") == CONTEXTS, F.col("n"))).alias("contexts")
    sums = counted.agg(contexts, F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    rows = counted.filter(F.col("kind") == TRIE).groupBy("shard").agg(F.sum("chunk").alias("total"), F.sum("n").alias("after"))
    for r in rows.collect():
        heavy[r.shard % (1 << 64)] = (r.total, r.after)
    return sums.contexts or 0, sums.ones / (sums.ones + 2 * sums.twos) if sums.ones and sums.twos else None


def score_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", train_column: str = "train", order: int = 2
) -> DataFrame:
    """log10 probabilities of whole texts under a model of pairs or triples of words, learnt from the rows marked for training.

    Gives ``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row. Tokens are the words (capital A-Z
    as small letters) and an end. ``n_known`` of them occur in training, which has ``train_tokens``; the base score is
    that of the words one by one, with one added to each count and one word for all unknown ones. The score's model
    discounts each pair's count by one number, estimated from how many pairs occur once and twice, and gives what
    that leaves of a context to the words one by one. With ``order=3`` the context is two words (before a text are two starts),
    triples have a discount of their own, and what that leaves is given to the model of pairs. Logarithms of pairs' and triples'
    probabilities are rounded to 256 values, evenly spaced, for each shard.

    The model is as large as the corpus asks for: pairs and triples lie in shards of about ``SHARD_TOKENS`` of them by the last
    word, and very frequent words in all shards by the word before. Texts are not sent to shards, nor the model to texts:
    each chunk of texts asks each shard, in packed arrays, and gets sums for each of its documents. In a shard the trie
    is mapped from a file of the running task, and the questions of all chunks are gathered before they are searched. Words are told apart by 64 bits of hash.

    A null text is empty: an end alone. A null mark is no training. A null id stays null; rows that repeat an id are
    separate texts. Other columns are ignored; an empty table gives no rows; without training rows every score is 0.
    """
    if order not in (2, 3):
        raise ValueError("the order of the model is 2 or 3")
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(train_column).alias("train")
    )
    training, texts = docs.filter("train").select("doc_id", "text"), docs.select("doc_id", "text")
    spark = docs.sparkSession
    with shuffles_deleted(spark):
        corpus = frequent(training, order)
        with small_batches(spark, BATCH_ROWS):
            counted = [count_pairs(training, corpus)] + ([count_triples(training, corpus)] if order > 2 else [])
        n_contexts, discount = sums_of(counted[0], corpus.heavy)
        corpus.discount = discount or corpus.discount
        if order > 2:
            corpus.triple_discount = sums_of(counted[1], corpus.heavy_pairs)[1] or corpus.triple_discount
        if corpus.tokens:
            if int(END) in corpus.heavy:
                # Nothing comes after an end; each text has one.
                corpus.heavy[int(END)] = (corpus.heavy[int(START)][0], 0)
            words = sum(1 for w, (n, _) in corpus.heavy.items() if n and w not in (int(START), int(END)))
            corpus.distinct = n_contexts + words + 1
        with small_batches(spark, BATCH_ROWS):
            rows = [table.filter(F.col("kind") == CONTEXTS).select("kind", "shard", "chunk", "blob") for table in counted]
            contexts = reduce(DataFrame.unionByName, rows)
            tries = build_tries(counted[0], corpus, *counted[1:])
            for table in counted:
                discard(table, f"kind={CONTEXTS}")
            answers = answer(ask(texts, corpus), tries, corpus)
            discard(tries)
            back = stored(backed_off(answers, contexts, corpus), "back")
            for table in counted:
                discard(table.filter(F.col("kind") == CONTEXTS))
    parts = answers.filter(F.col("kind").isin(DOCS, PART)).unionByName(back)
    train_tokens = corpus.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in shard_rows(batches):
            ids, missing, lengths = next(unpacked(b) for kind, _, b in rows if kind == DOCS)
            total = np.zeros((3, len(ids)))
            for kind, _, blob in rows:
                if kind == PART:
                    owners, *sums = unpacked(blob)
                    for k in range(3):
                        total[k] += np.bincount(owners, sums[k], len(ids))
            columns = [
                pa.array(ids, pa.int64(), mask=missing.astype(bool)),
                pa.array(lengths, pa.int64()),
                pa.array(np.rint(total[0]).astype(np.int64)),
                pa.array(np.full(len(ids), train_tokens)),
                pa.array(total[1]),
                pa.array(total[2]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    together = parts.withColumn("shard", F.col("chunk")).repartition("shard").sortWithinPartitions("shard", "kind", "blob")
    kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return together.mapInArrow(run, kinds)
