"""Places in a text that equal strings choose alike, whatever stands around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .text import U64, _byte_values, mix, powers

#: Long texts are looked at in parts of so many places.
PART = 1 << 20
_PLACE_BITS = U64(21)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The places of a text in runs whose strings of ``length`` bytes share an anchor.

    A string's anchor is the ``gram`` bytes in it with the smallest hash, the leftmost of equal ones, so equal strings
    have equal anchors at equal distances. Gives arrays: the anchor's hash, the first place of the run, the number of
    places, the anchor's distance from the first place, and a hash of all bytes of the run's strings.
    """
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), PART):
        part = data[at : at + PART + length - 1]
        with np.errstate(over="ignore"):
            power, inverse = powers(len(part))
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_byte_values[part] * power[: len(part)], out=sums[1:])
            grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
            ranked = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=U64)
            anchor = (sliding_least(ranked, width) & U64((1 << 21) - 1)).astype(np.int64)
            first = np.flatnonzero(np.diff(anchor, prepend=-1))
            last = np.append(first[1:], len(anchor)) - 1
            place = anchor[first]
            bytes_ = (sums[last + length] - sums[first]) * inverse[first]
            away = place - first
            whole = mix(bytes_ + mix((last - first).astype(U64) << U64(32) | away.astype(U64)))
        yield grams[place], at + first, last - first + 1, away, whole
