"""Words of batches in Python: the rules of the expressions, and what a batch sends."""

import random

import pytest
from pyspark.sql import functions as F

import logframe as lf
from logframe.functions import words
from logframe.functions.text import SPACE_CHARS, clean_words, needs_token

ALPHABET = list("abcXYZ09_-./:,!(") + list(SPACE_CHARS) + ["é", "İ", "K", "Σ", "�", "中", "\x00", "\x7f", "\U0001f600"]


def test_words_are_those_of_the_expressions(spark):
    chooser = random.Random(3)
    cases = ["".join(chooser.choices(ALPHABET, k=chooser.randrange(60))) for _ in range(1000)] + [None, "", "The 12 a.b 1:2 -"]
    frame = spark.createDataFrame(list(enumerate(cases)), "seq int, text string")
    # Bytes that are no UTF-8 too.
    broken = spark.range(1).selectExpr("-1 AS seq", "CAST(X'61FF62202063C3' AS string) AS text")
    frame = frame.union(broken)
    wanted = F.filter(F.array_distinct(clean_words(F.col("text"))), needs_token)
    for row in frame.select("text", wanted.alias("want"), words.token_words(F.col("text")).alias("got")).collect():
        assert row.got == row.want, repr(row.text)
    for row in frame.select(clean_words(F.col("text")).alias("want"), words.lowered(F.col("text")).alias("low")).collect():
        assert words.cleaned(row.low) == row.want


@pytest.mark.parametrize("seen", [words.SEEN, 0])
def test_a_batch_sends_a_word_once(spark, monkeypatch, seen):
    monkeypatch.setattr(words, "SEEN", seen)
    rows = [(600 - n, f"common w{n % 300} common") for n in range(600)] + [(None, "common last")]
    frame = spark.createDataFrame(rows, "seq bigint, text string").coalesce(1)
    listed = frame.select("seq", words.first_token_words(F.col("text"), F.col("seq")).alias("w")).collect()
    sent = {row.seq: row.w for row in listed}
    assert sent[1] == ["common", "w299"] and sent[2] == ["w298"] and sent[None][-1] == "last"
    # Without the limit each word is sent once; with it, each slice of a batch sends it at most once.
    assert sum(map(len, sent.values())) == 302 if seen else 302 < sum(map(len, sent.values())) <= 606
    built = lf.build_dictionary(frame.filter("seq > 0"), "text", ["seq"])
    first = [r.word for r in built.entries.orderBy("token_no").limit(7).collect()][4:]
    assert first == ["common", "w299", "w298"]


@pytest.mark.parametrize("head", [{}, {"head_entries": 1}])
def test_bytes_that_are_no_text(spark, head):
    dictionary = lf.build_dictionary(spark.createDataFrame([(1, "aa bb")], "seq bigint, message string"), order_by=["seq"])
    broken = spark.range(1).selectExpr("id AS seq", "CAST(X'544B30303035FF20544B3030303520' AS string) AS message")
    assert lf.expand_messages(broken, dictionary, key=["seq"], **head).first().message == "TK0005� aa"
