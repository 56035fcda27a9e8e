"""Words and hashes of UTF-8 texts, as numpy arrays over whole Arrow batches.

Words are the maximal runs of bytes other than the space and 0x09-0x0D; capital A-Z count as small letters. No byte
of a longer UTF-8 character is a separator, so bytes may be looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes, whatever their length.
PIECE_BYTES = 1 << 20
SEPARATORS = (0x20, *range(0x09, 0x0E))

U64 = np.uint64
BASE = 0x9E3779B97F4A7C55 | 1

_is_word = np.ones(256, bool)
_is_word[list(SEPARATORS)] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits given."""
    with np.errstate(over="ignore"):
        x = values.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
        return x


#: One random number for each byte, small letters for capitals.
_byte_values = mix(np.arange(1, 257, dtype=U64))
_lower_values = _byte_values[_lower]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i up to n, modulo 2**64."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n, PIECE_BYTES) + 1
        table = np.empty((2, size), U64)
        table[:, 0] = 1
        table[0, 1:], table[1, 1:] = U64(BASE), U64(pow(BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = list(np.multiply.accumulate(table, axis=1))
    return _powers[0], _powers[1]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and the n + 1 places between them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _is_word) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word goes beyond its text. ``is_word`` tells the bytes that words consist of."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    change = inside[1:] != inside[:-1]
    starts = change & inside[1:]
    ends = change & inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    starts[cuts] = ends[cuts] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + PIECE_BYTES, "right")))
            high = ends[to - 1]
            power, inverse = powers(int(high - low))
            sums = np.zeros(high - low + 1, U64)
            np.cumsum(_lower_values[data[low:high]] * power[: high - low], out=sums[1:])
            first, last = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(U64)
            at = to
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the n + 1 places where one text's words end and the next one's begin."""
    data, offsets = string_bytes(column)
    starts, ends = word_spans(data, offsets)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of one text's runs of ``size`` words; of all its words, if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total *= U64(BASE)
            total += words[k : k + n]
    # Runs of fewer words than asked for are told from full ones by their own length.
    return np.unique(mix(total + U64(size)))


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of each row, one row after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about so many bytes together; a longer text is a part of its own."""
    texts = batch.column(column)
    data, offsets = string_bytes(texts)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
