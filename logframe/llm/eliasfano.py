"""Rising sequences of whole numbers in little memory, as parts of one file that is mapped, not read."""

from __future__ import annotations

import numpy as np

#: The sequence is decoded in blocks of so many numbers.
BLOCK = 1 << 16
U64 = np.uint64


class EliasFano:
    """The low bits of each number as they are, the high bits in unary; searched block by block.

    ``arrays`` are a header, the low bits, the high bits, where each block's high bits begin, and each block's first
    number.
    """

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.header, self.low, self.high, self.begins, self.firsts = arrays
        self.n, self.width = int(self.header[0]), int(self.header[1])

    @staticmethod
    def encode(values: np.ndarray) -> list[np.ndarray]:
        """``values`` must rise (or stay) and be unsigned 64-bit numbers."""
        values = values.astype(U64, copy=False)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // max(1, n)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if width:
            shifts = np.arange(width - 1, -1, -1, dtype=U64)
            parts = []
            for at in range(0, n, BLOCK):
                bits = (values[at : at + BLOCK, None] >> shifts) & U64(1)
                parts.append(np.packbits(bits.astype(np.uint8).ravel()))
            low = np.concatenate(parts) if parts else low
        high = np.zeros(((most >> width) + n) // 8 + 1, np.uint8)
        places = (values >> U64(width)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, places >> 3, (128 >> (places & 7)).astype(np.uint8))
        return [np.array([n, width]), low, high, places[::BLOCK].copy(), values[::BLOCK].copy()]

    def block(self, k: int) -> np.ndarray:
        """The numbers of one block."""
        at, to = k * BLOCK, min(self.n, (k + 1) * BLOCK)
        begin = int(self.begins[k])
        end = int(self.begins[k + 1]) if k + 1 < len(self.begins) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : (end >> 3) + 1])
        places = np.flatnonzero(bits[begin & 7 :])[: to - at] + begin
        values = (places - np.arange(at, to)).astype(U64) << U64(self.width)
        if self.width:
            # A full block's low bits fill whole bytes.
            first = at * self.width >> 3
            bits = np.unpackbits(self.low[first : first + ((to - at) * self.width + 7) // 8])[: (to - at) * self.width]
            low = np.zeros(to - at, U64)
            for column in bits.reshape(to - at, self.width).T:
                low = low + low + column
            values |= low
        return values

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, by the first number that is not smaller; -1 where that is another number."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        # Keys equal to a block's first number belong to that block.
        edges = np.searchsorted(sorted_, self.firsts)
        for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)])):
            if a < b:
                values = self.block(k)
                place = np.searchsorted(values, sorted_[a:b])
                hit = place < len(values)
                hit[hit] = values[place[hit]] == sorted_[a:b][hit]
                out[order[a:b][hit]] = k * BLOCK + place[hit]
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        out, of = np.zeros(len(places), U64), places // BLOCK
        for k in np.unique(of):
            own = of == k
            out[own] = self.block(int(k))[places[own] - k * BLOCK]
        return out
