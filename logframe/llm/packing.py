"""Token sequences of fixed length from documents, by vector bin packing."""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches, stored
from .text import SEPARATORS, pieces, ragged, string_bytes, word_spans

#: The words of a cache; there are two of them.
CACHE_WORDS = 100_000
#: Rows of texts that a task gets at a time.
BATCH_ROWS = 2000
#: A word that is one token.
MARK = "~"
#: A block of pieces that one task packs at a time: tokens, and pieces.
BLOCK_TOKENS, BLOCK_PIECES = 1 << 20, 2048

#: A known pattern by which tokenizers split text: letters by themselves, digits, and what is neither.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_bytes = np.arange(256)
_is_word = ~np.isin(_bytes, SEPARATORS)
#: Kinds of bytes: signs of ASCII are 0, what is beyond ASCII is no kind.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_kind = np.zeros(256, np.uint8)
_kind[((_bytes | 32) >= ord("a")) & ((_bytes | 32) <= ord("z"))] = _LETTER
_kind[(_bytes >= ord("0")) & (_bytes <= ord("9"))] = _DIGIT
_kind[128:] = _OTHER


def _any(data: np.ndarray, values: np.ndarray) -> bool:
    return any((data == v).any() for v in values)


class WordCodes(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class WordEncoder:
    """Token ids of texts whose tokenizer never joins text over white space: each distinct word is encoded once.

    Words are encoded many at a time, with a mark between them that is one token; those with the mark inside are
    encoded each by itself. A full cache becomes the old one, from which words still move to the new one.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # Tasks already use all cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(MARK)
        told = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        first = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.letters_apart = kinds == ["NFC", "Replace", "Lowercase"] and (
            first.get("pattern") == {"Regex": LETTERS_APART} and first["behavior"] == "Removed" and first["invert"]
        )
        # Small letters of ASCII go through all steps before the model as they are.
        then = [{k: n.get(k) for k in ("type", "add_prefix_space", "use_regex")} for n in told["pre_tokenizer"]["pretokenizers"][1:]] if first else []
        bytes_only = then == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
        bare = told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.letters = Tokenizer.from_str(json.dumps(bare)) if self.letters_apart and bytes_only else None
        self.added = np.array(sorted({t["content"].encode()[0] for t in told["added_tokens"] if t["content"]}), np.uint8)
        self.codes, self.ids, self.ends = WordCodes(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self._turn()

    def _turn(self) -> None:
        self.old_codes, self.old_ids, self.old_ends = self.codes, self.ids, self.ends
        self.codes, self.ids, self.ends = WordCodes(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words, the places between words, and the number of words before each text.

        Where the tokenizer reads letters apart from signs, each digit by itself, and small letters for capitals, so does
        this between two characters of ASCII: runs of letters, digits and runs of signs are words of their own, but for
        letters after an apostrophe, which may be one token with it. Such letters are small ones, unless a mark may
        follow that makes another letter of them. Words that may hold a token added to the tokenizer stay as they are.
        """
        starts, ends = word_spans(data, offsets)
        inside = _is_word[data]
        lengths, data = ends - starts, data[inside]
        begins = np.zeros(len(data) + 1, bool)
        begins[0] = begins[-1] = True
        begins[np.cumsum(lengths)] = True
        before = np.concatenate([[0], np.cumsum(inside)])[offsets]
        if self.letters_apart and len(data):
            free = np.ones(len(data), bool)
            if _any(data, self.added):
                odd = np.add.reduceat(np.isin(data, self.added), np.flatnonzero(begins[:-1])) > 0
                free = ~np.repeat(odd, lengths)
            kind, last = _kind[data], data[:-1] == ord("'")
            apart = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            known = (kind[1:] != _OTHER) & (kind[:-1] != _OTHER)
            begins[1:-1] |= apart & known & free[1:] & ~(last & (kind[1:] == _LETTER))
            capital = (data >= ord("A")) & (data <= ord("Z")) & free
            capital[:-1] &= data[1:] < 0x80
            data = data + np.uint8(32) * capital
        places = np.flatnonzero(begins) if len(data) else np.zeros(1, np.int64)
        return data, places, np.searchsorted(places, before)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Words are cut out and told apart as bytes; only distinct ones become Python strings."""
        if len(self.codes) > CACHE_WORDS:
            self._turn()
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        data, places, bounds = self._words(*string_bytes(texts))
        buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, buffers).dictionary_encode()
        known = len(self.codes)
        codes = np.array(list(map(self.codes.__getitem__, words.dictionary.cast(pa.large_string()).to_pylist())), np.int64)
        if len(self.codes) > known:
            self._learn(list(itertools.islice(self.codes, known, None)))
        codes = codes[words.indices.to_numpy(zero_copy_only=False)]
        found = pa.LargeListArray.from_arrays(self.ends, self.ids).take(pa.array(codes))
        ids, ends = found.flatten().to_numpy(), np.frombuffer(found.buffers()[1], np.int64)[: len(codes) + 1]
        cuts = ends[bounds] - ends[0]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> None:
        old = np.array([self.old_codes.get(word, -1) for word in words], np.int64)
        moved, new = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        ids, new_lengths = self._encode_words([words[k] for k in new])
        lengths = np.empty(len(words), np.int64)
        lengths[new] = new_lengths
        lengths[moved] = self.old_ends[old[moved] + 1] - self.old_ends[old[moved]]
        ends = np.cumsum(lengths)
        out = np.empty(ends[-1], np.int32)
        out[ragged(ends[new] - lengths[new], lengths[new])] = ids
        out[ragged(ends[moved] - lengths[moved], lengths[moved])] = self.old_ids[ragged(self.old_ends[old[moved]], lengths[moved])]
        self.ids = np.concatenate([self.ids, out])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        if self.letters:
            plain = np.array([word.isascii() and word.isalpha() and word.islower() for word in words], bool)
            if plain.all():
                return self._encode_letters(words)
            if plain.any():
                parts = [self._encode_letters([words[k] for k in np.flatnonzero(plain)])]
                parts.append(self._encode_words([words[k] for k in np.flatnonzero(~plain)]))
                lengths = np.empty(len(words), np.int64)
                lengths[plain], lengths[~plain] = parts[0][1], parts[1][1]
                ends = np.cumsum(lengths)
                ids = np.empty(ends[-1], np.int32)
                for own, (found, n) in zip((plain, ~plain), parts):
                    ids[ragged((ends - lengths)[own], n)] = found
                return ids, lengths
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        alone = [k for k, word in enumerate(words) if MARK in word or len(self.mark) != 1]
        for a, b in zip([-1, *alone], [*alone, len(words)]):
            for at in range(a + 1, b, 500):
                found = self._ids(f" {MARK} ".join(words[at : min(b, at + 500)]))
                marks = np.flatnonzero(found == self.mark[0])
                lengths.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
                ids.append(np.delete(found, marks))
            if b < len(words):
                ids.append(self._ids(words[b]))
                lengths.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(lengths)


    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode_words``, of words of small letters of ASCII alone, by the tokenizer's model."""
        texts = [f" {MARK} ".join(words[at : at + 500]) for at in range(0, len(words), 500)]
        ids = [np.zeros(0, np.int32)]
        for done in self.letters.encode_batch_fast(texts, add_special_tokens=False):
            ids += [np.array(done.ids, np.int32), self.mark]
        ids = np.concatenate(ids)
        marks = np.flatnonzero(ids == self.mark[0])
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks])) - 1


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker, as the file takes long to read."""
    return WordEncoder(path)


def token_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple]:
    """``doc_id, ids, number of prompt ids`` of each row of ``doc_id, prompt, text``."""
    encoder = word_encoder(path)
    for batch in batches:
        for part in pieces(batch, "text", most_bytes=2 << 20):
            prompts = encoder.encode(part.column("prompt"))
            texts = encoder.encode(part.column("text"))
            for doc_id, prompt, text in zip(part.column("doc_id").to_pylist(), prompts, texts):
                yield doc_id, np.concatenate([prompt, text, [end_id]]).astype("<u4"), len(prompt)


def token_pieces(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """``doc_id, start, length, loss, ids_crc32, doc_tokens``: documents cut at multiples of ``length`` tokens.

    ``docs`` has ``doc_id, prompt, text``; the loss-bearing tokens are those after the prompt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        names = ["doc_id", "start", "length", "loss", "ids_crc32", "doc_tokens"]
        for doc_id, ids, prompt in token_rows(batches, path, end_id):
            for start in range(0, len(ids), length):
                cut = ids[start : start + length]
                loss = len(cut) - min(len(cut), max(0, prompt - start))
                rows.append((doc_id, start, len(cut), loss, zlib.crc32(cut.tobytes()), len(ids)))
            if len(rows) >= 5000:
                yield flush()
        yield flush()

    schema = "doc_id long, start long, length long, loss long, ids_crc32 long, doc_tokens long"
    return docs.mapInArrow(run, schema)


def fill(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its place among the bin's items.

    One bin at a time takes the item that fits and whose demands have the largest dot product with what is left of
    the limits, both as shares of the limits; ties go to the earlier item.
    """
    shares = demands / limits
    bins, places = np.full(len(demands), -1), np.zeros(len(demands), np.int64)
    waiting, count = np.arange(len(demands)), 0
    while len(waiting):
        left, place = limits.astype(np.int64), 0
        open_items = waiting
        while True:
            open_items = open_items[(demands[open_items] <= left).all(axis=1)]
            if not len(open_items):
                break
            best = int(np.argmax(shares[open_items] @ (left / limits)))
            item = open_items[best]
            bins[item], places[item] = count, place
            left, place = left - demands[item], place + 1
            open_items = np.delete(open_items, best)
        waiting = waiting[bins[waiting] < 0]
        count += 1
    return bins, places


def pack(parts: DataFrame, length: int = 4096, segments: int = 1024, loss: int | None = None) -> DataFrame:
    """Place pieces in sequences: adds ``sequence_id`` and ``offset``.

    A sequence holds at most ``length`` tokens, ``segments`` pieces and ``loss`` loss-bearing tokens (as many as
    ``length``, if not given). No piece may have more than ``length`` tokens or ``loss`` loss-bearing ones. Pieces
    are dealt out by hash to blocks of about ``BLOCK_TOKENS`` tokens; each block is packed by itself, so that at
    most one nearly empty sequence is left in a block. ``parts`` must be a stored table.
    """
    limits = np.array([length, segments, loss or length], np.int64)
    total = parts.agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(total.tokens or 0) // BLOCK_TOKENS), -(-total.n // BLOCK_PIECES))
    # The row number tells repeated rows apart, which would else all meet in one block.
    block = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(blocks)).alias("block")

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        demands = np.stack([items.length, np.ones(len(items), np.int64), items.loss], axis=1)
        items["bin"], items["place"] = fill(demands, limits)
        items = items.sort_values(["bin", "place"], ignore_index=True)
        items["offset"] = items.groupby("bin").length.cumsum() - items.length
        items["sequence_id"] = items.block * (1 << 32) + items.bin
        return items[names]

    names = [*parts.columns, "sequence_id", "offset"]
    kinds = ", ".join(f"{name} long" for name in names)
    return parts.withColumn("block", block).groupBy("block").applyInPandas(run, kinds)


def pack_documents(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    prompt_column: str | None = None,
    length: int = 4096,
    segments: int = 1024,
    loss: int | None = None,
    end_id: int = 2,
) -> DataFrame:
    """Documents, or prompts and answers, as pieces of token sequences.

    ``path`` is a tokenizer file of the ``tokenizers`` library that every executor has, of a tokenizer that drops white
    space. A document is its prompt's ids, its text's ids and ``end_id``; it is cut at multiples of ``length`` (of
    ``loss``, if that is smaller), so each id lies in one piece. Gives ``doc_id, start, length, loss, ids_crc32,
    doc_tokens, sequence_id, offset`` for each piece; ``piece_ids`` adds the ids.

    A null or empty text is ``end_id`` alone. Repeated rows are packed each by itself; a null id stays null. Other
    columns are ignored; an empty table gives no rows.
    """
    prompt = F.col(prompt_column) if prompt_column else F.lit(None)
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), prompt.cast("string").alias("prompt"), F.col(text_column).alias("text")
    )
    cut = min(length, loss or length)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        parts = stored(token_pieces(docs, path, cut, end_id), "pieces")
    return pack(parts, length, segments, loss)


def piece_ids(
    placed: DataFrame,
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    prompt_column: str | None = None,
    end_id: int = 2,
) -> DataFrame:
    """``sequence_id, offset, ids`` of placed pieces, from the documents they were made of, whose ids must be unique."""
    prompt = F.col(prompt_column) if prompt_column else F.lit(None)
    cuts = placed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("cuts"))
    docs = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), prompt.cast("string").alias("prompt"), F.col(text_column).alias("text")
    ).join(cuts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cut in zip(token_rows([batch], path, end_id), batch.column("cuts").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["sequence_id"] for c in cut], pa.int64()),
                        pa.array([c["offset"] for c in cut], pa.int64()),
                        pa.array([row[1][c["start"] : c["start"] + c["length"]] for c in cut], pa.list_(pa.int32())),
                    ],
                    ["sequence_id", "offset", "ids"],
                )

    return docs.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
