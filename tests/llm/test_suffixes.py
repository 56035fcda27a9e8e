import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import suffixes
from logframe.llm.suffixes import CoverRanks, cut_repeats, names

from .conftest import frame


def brute_force(texts, length):
    """Size, removed spans and what is kept of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(d), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(docs, length):
    rows = docs.collect()
    wanted = sorted(zip([str(r.doc_id) for r in rows], brute_force([r.text for r in rows], length)), key=str)
    got = cut_repeats(docs, length=length).collect()
    assert sorted(((str(r.doc_id), (r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept))) for r in got), key=str) == wanted


def test_documents(documents):
    check(documents, 200)


@pytest.mark.parametrize("many", [2000, 0])
def test_passages(spark, monkeypatch, many):
    """Passages inside each other, at the edges of texts, twice in a text, with periods; also with split buckets."""
    monkeypatch.setattr(suffixes, "MANY", many)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage, other = text(450), text(260)
    rows = [(i, text(rng.randrange(400)) + passage[i : 450 - i] + text(rng.randrange(300))) for i in range(40)]
    rows += [(100, other + text(50) + other), (101, other[:200]), (102, other[1:200]), (103, "ab" * 400), (104, "a" * 500)]
    rows += [(105, "é" * 210), (106, text(199)), (107, passage), (108, text(90) + other[30:235]), (109, "b" + "ab" * 120)]
    check(frame(spark, rows), 200)


def test_edges(edges, nothing):
    docs = edges.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)")
    check(docs, 100)
    got = cut_repeats(edges).filter("doc_id IN (8, 9)").select("n_bytes", F.size("removed").alias("n"), "row").collect()
    assert {(r.n_bytes > 299_999, r.row) for r in got} == {(True, "own row")}
    assert cut_repeats(nothing).count() == 0


def test_text_without_halves_of_characters(spark):
    shared = "x" + "é" * 150
    docs = frame(spark, [(1, "è" + shared[1:] + "end"), (2, "start " + shared)])
    # The removed bytes begin with the second half of the first one's first character.
    kept = {r.doc_id: r.kept for r in cut_repeats(docs, as_text=True).collect()}
    assert kept[1].endswith("end") and "�" not in kept[1] and kept[2].startswith("start")


def test_cover_ranks_order_strings():
    rng = np.random.default_rng(0)
    for length in (100, 155, 200, 333):
        text = rng.integers(97, 99, 2500).astype(np.uint8)
        for a, b, n in ((10, 1000, 400), (40, 1700, 700)):
            text[b : b + n] = text[a : a + n]
        ranks = CoverRanks(text, length)
        for r in range(0, 31, 6):
            starts = np.arange(r, len(text) - length + 1, 31)
            strings = [bytes(text[i : i + length]) for i in starts]
            order = sorted(set(strings))
            assert names(*ranks.keys(starts)).tolist() == [order.index(s) for s in strings]


def test_cover_is_one():
    differences = {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("many", [2000, 0])
def test_equal_contexts_are_one_row(spark, monkeypatch, many):
    """A passage in many texts that differ around it: no bucket gets a context twice."""
    monkeypatch.setattr(suffixes, "MANY", many)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = text(400)
    docs = frame(spark, [(k, text(60) + passage + text(60)) for k in range(150)])
    whole = suffixes.sorted_groups

    def once(batches, keys):
        for group in whole(batches, keys):
            contexts = list(zip(*(group.column(c).to_pylist() for c in ("context", "places", "away"))))
            assert len(contexts) == len(set(contexts))
            yield group

    monkeypatch.setattr(suffixes, "sorted_groups", once)
    check(docs, 200)
