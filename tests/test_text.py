"""Text rules against Python's own string methods."""

import random
import re

import logframe as lf
from logframe.functions.text import LINE_BREAK_CHARS, SPACE_CHARS, clean_utf8, clean_words, needs_token
from pyspark.sql import functions as F

ALPHABET = list("abcXYZ09_-./:,!(") + list(SPACE_CHARS) + ["é", "İ", "K", "�", "中", "\x00", "\x01", "\U0001f600"]


def texts(n, seed=1):
    chooser = random.Random(seed)
    return ["".join(chooser.choices(ALPHABET, k=chooser.randrange(40))) for _ in range(n)]


def test_character_sets():
    every = [chr(c) for c in range(0x110000)]
    assert set(SPACE_CHARS) == {c for c in every if c.isspace()}
    assert set(LINE_BREAK_CHARS) == {c for c in every if len(f"a{c}b".splitlines()) == 2}


def test_framing(spark):
    cases = texts(400)
    frame = spark.createDataFrame(list(enumerate(cases)), "seq int, line string")
    got = {}
    for row in lf.frame_lines(frame).orderBy("seq", "part").collect():
        got.setdefault(row.seq, []).append(row.line)
    for seq, text in enumerate(cases):
        assert got.get(seq, []) == [piece.strip() for piece in text.splitlines() if piece.strip()], repr(text)


def test_clean_words(spark):
    cases = texts(400, 2) + [None, "", "!!!", ":", "1,000", "café au lait", "Don't"]
    frame = spark.createDataFrame(list(enumerate(cases)), "seq int, text string")
    rows = frame.select("seq", clean_words(F.col("text")).alias("words")).collect()
    for row in rows:
        wanted = [re.sub(r"[^a-zA-Z0-9_\-./:]", "", w) for w in (cases[row.seq] or "").lower().split()]
        assert row.words == [w for w in wanted if w], repr(cases[row.seq])


def test_which_words_need_tokens(spark):
    kept = ["for", "with", "a", "12", "0", "1.2", "a.b", ".", ""]
    tokens = ["-", ":", "/", "1a", "1-2", "forx", "_", "root"]
    frame = spark.createDataFrame([(w,) for w in kept + tokens], "word string")
    found = {r.word for r in frame.filter(needs_token(F.col("word"))).collect()}
    assert found == set(tokens)


def test_clean_utf8(spark):
    chooser = random.Random(3)
    pool = [b"a", b"\n", b"\x01", b"\x02", b"\x03", b"\xc3", b"\xa9", b"\xe2", b"\x80", b"\xa8", b"\xf0", b"\x9f", b"\xff",
            b"\xed", b"\xa0", b"\xc0", "�".encode(), "é".encode(), "\U0001f600".encode()]
    cases = [b"".join(chooser.choices(pool, k=chooser.randrange(14))) for _ in range(1500)]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "seq int, raw binary")
    for row in frame.select("seq", clean_utf8(F.col("raw").cast("string")).alias("text")).collect():
        assert row.text == cases[row.seq].decode("utf-8", "ignore"), cases[row.seq]
