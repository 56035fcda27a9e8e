"""Text expressions that follow Python's rules for white space, line breaks and decoding."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# The characters Python's str.isspace() accepts.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The characters that end a line for Python's str.splitlines().
LINE_BREAK_CHARS = "\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# 15 words that are never replaced by a token.
STOP_WORDS = ("for", "from", "the", "and", "to", "of", "on", "in", "a", "an", "is", "was", "at", "by", "with")

# Java's (?U)\s, and the four separators that only Python counts as white space.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

REPLACEMENT = "\ufffd"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def stripped_lines(text: Column) -> Column:
    """The pieces of a text between line breaks, each stripped. Few texts hold a break; the others are not split."""
    has_break = reduce(or_, [F.contains(text, F.lit(char)) for char in LINE_BREAK_CHARS])
    pieces = F.transform(F.split(text, f"[{LINE_BREAK_CHARS}]"), strip)
    return F.when(has_break, pieces).otherwise(F.array(strip(text)))


def clean_utf8(text: Column) -> Column:
    """Drop the bytes that are not UTF-8. Replacement characters that were in the text stay: while the bad bytes
    are turned into such characters and removed, an escape sequence stands for the others."""

    def swapped(column: Column, *pairs: tuple[str, str]) -> Column:
        for old, new in pairs:
            column = F.replace(column, F.lit(old), F.lit(new))
        return column

    escaped = F.make_valid_utf8(swapped(text, ("\x01", "\x01\x02"), (REPLACEMENT, "\x01\x03")))
    cleaned = swapped(escaped, (REPLACEMENT, ""), ("\x01\x03", REPLACEMENT), ("\x01\x02", "\x01"))
    return F.when(F.is_valid_utf8(text), text).otherwise(cleaned)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_pieces(text: Column) -> Column:
    """``clean_words`` that may begin or end with an empty word."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^a-z0-9_\-./:\s\x1c-\x1f]+", "")
    return split_pieces(kept)


def split_pieces(text: Column) -> Column:
    return F.split(text, f"(?U){SPACE}+")


def clean_words(text: Column) -> Column:
    """The lower-case words of a text, each stripped to letters, digits and ``_ - . / :``. Null gives no word."""
    return F.array_remove(clean_pieces(text), "")


def needs_token(word: Column) -> Column:
    """False for stop words, numbers and words with a dot, which stay as they are, and for no word at all."""
    # Digits sort before the colon and the letters, so most words are spared the second test.
    all_digits = (word < ":") & (F.btrim(word, F.lit("0123456789")) == "")
    return (word != "") & ~(F.contains(word, F.lit(".")) | all_digits | word.isin(*STOP_WORDS))
