"""The rules of ``text.py`` for words, for batches of texts in Python."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from string import ascii_lowercase, digits

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, functions as F

from .text import STOP_WORDS

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts of a batch that are in Python's own form at a time.
ROWS = 256
# Words of a batch that are known to be sent; beyond them words may be sent again.
SEEN = 200_000

_STOP = frozenset(STOP_WORDS)
# The ASCII characters that no word keeps, apart from white space.
_DROPPED = {code: None for code in range(128) if chr(code) not in ascii_lowercase + digits + "_-./:" and not chr(code).isspace()}


def lowered(text: Column) -> Column:
    """What ``cleaned`` takes: valid text in lower case, no text for null."""
    return F.lower(F.coalesce(text, F.lit("")))


def cleaned(text: str) -> list[str]:
    """The words of ``clean_words``."""
    if not text.isascii():
        # Other white space parts words too.
        text = " ".join(text.split()).encode("ascii", "ignore").decode("ascii")
    return text.translate(_DROPPED).split()


def is_token_word(word: str) -> bool:
    """``needs_token`` of a cleaned word."""
    return "." not in word and word not in _STOP and not word.isdigit()


def strings(texts: pa.Array) -> list[str | None]:
    """Texts that may hold bytes which are no UTF-8."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]


def sliced(texts: pa.Array, kind: pa.DataType, run: Callable[[list], Iterable]) -> pa.Array:
    """What ``run`` makes of the texts, a slice at a time."""
    parts = [pa.array(run(strings(texts.slice(at, ROWS))), kind) for at in range(0, len(texts), ROWS)]
    return pa.chunked_array(parts, kind).combine_chunks()


def token_words(text: Column) -> Column:
    """The distinct words of a text that need a token, in the order of their first occurrence."""

    def run(texts: pa.Array) -> pa.Array:
        return sliced(texts, pa.list_(pa.string()), lambda some: [list(filter(is_token_word, dict.fromkeys(cleaned(t)))) for t in some])

    return F.arrow_udf(run, "array<string>")(lowered(text))


def first_token_words(text: Column, order: Column) -> Column:
    """As ``token_words``, without most of the words that a record of the same batch with a smaller number has too."""

    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        kind, seen, parts = pa.list_(pa.string()), set(), []
        # A record without a number, which no minimum counts, is put last.
        by_number = pc.array_sort_indices(numbers)

        def fresh(text: str) -> list[str]:
            words = [word for word in dict.fromkeys(cleaned(text)) if word not in seen]
            seen.update(words)
            return list(filter(is_token_word, words))

        for at in range(0, len(texts), ROWS):
            if len(seen) > SEEN:
                seen.clear()
            parts.append(pa.array(map(fresh, texts.take(by_number.slice(at, ROWS)).to_pylist()), kind))
        found = pa.chunked_array(parts, kind).combine_chunks()
        return found.take(pc.array_sort_indices(by_number))

    return F.arrow_udf(run, "array<string>")(lowered(text), order)


def replaced(text: Column, pieces: Callable[[str], list[str]], known: Broadcast) -> Column:
    """The words of a text, replaced where a table knows them, joined by spaces."""

    def run(texts: pa.Array) -> pa.Array:
        get = known.value.get

        def one(text: str | None) -> str | None:
            return None if text is None else " ".join(map(get, words := pieces(text), words))

        return sliced(texts, pa.string(), lambda some: map(one, some))

    return F.arrow_udf(run, "string")(text)


def opened(texts: pa.Array, pieces: Callable[[str], list[str]], table: dict[str, str], asks: pa.Array, found: dict[str, None]) -> pa.Array:
    """The words of each text joined by spaces. What the table does not know of a text that ``asks`` goes to ``found``."""
    joined = []
    for text, ask in zip(strings(texts), asks.to_pylist()):
        words = None if text is None else pieces(text)
        if words and ask:
            found.update((word, None) for word in words if word not in table)
        joined.append(None if words is None else " ".join(words))
    return pa.array(joined, pa.string())
