import random
import re
from collections import defaultdict

import numpy as np

from logframe.llm import minhash
from logframe.llm.graph import components
from logframe.llm.minhash import near_duplicates

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_force(rows):
    """Size of the set, and the smallest id reachable, for each row in turn."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    smallest = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for (a, _), s in zip(rows, sets):
            for (b, _), t in zip(rows, sets):
                if a is not None and b is not None and s and 100 * len(s & t) >= 75 * len(s | t):
                    low = min(smallest[a], smallest[b])
                    changed |= (smallest[a], smallest[b]) != (low, low)
                    smallest[a] = smallest[b] = low
    return sorted(((i, len(s), smallest.get(i)) for (i, _), s in zip(rows, sets)), key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str)


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert found(edges) == brute_force(rows)
    kept = {(r.doc_id, r.kept) for r in near_duplicates(edges).collect()}
    assert (2, False) in kept and (1, True) in kept and (None, True) in kept
    assert near_duplicates(nothing).count() == 0


def test_documents(documents):
    assert found(documents) == brute_force([(r.doc_id, r.text) for r in documents.collect()])


def test_chains_and_large_groups(spark):
    """Copies with more and more changes: not all are like the smallest one, so links lead on from others."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows, words = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(120)] = f"new{i}"
    rows += [(100 + i, " ".join([*base[:60], *(f"own{i}x{k}" for k in range(40))])) for i in range(40)]
    rng.shuffle(rows)
    assert found(frame(spark, rows)) == brute_force(rows)


def test_members_outside_the_main_component(spark, monkeypatch):
    """With one-bin bands nearly everything shares buckets, and links come from the second pass."""
    groups = [(g * 10 + k, " ".join(["common"] * 3 + [f"c{i}" for i in range(20)] + [f"g{g}w{i}" for i in range(60)] + [f"k{k}"])) for g in range(8) for k in range(4)]
    docs = frame(spark, groups)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, bands=60, rows=1).collect())
    assert got == sorted(brute_force(groups))


def test_densified_bins_agree_as_sets_do():
    rng = np.random.default_rng(0)
    for size in (4, 40, 1000):
        whole = rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(whole[: size * 3 // 4]), np.unique(whole)
        _, bins = minhash.sketch([a, b], 400, 5)
        assert abs((bins[0] == bins[1]).mean() - 0.75) < 0.22
    empty = minhash.sketch([np.zeros(0, np.uint64)], 4, 2)[0]
    assert empty.shape == (1, 4)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 90)] + [(500, k) for k in range(501, 700)] + [(900, 900), (7, 3), (3, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    wanted = defaultdict(set)
    for a, b in edges:
        if a != b:
            merged = wanted[a] | wanted[b] | {a, b}
            for node in merged:
                wanted[node] = merged
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: min(s) for n, s in wanted.items() if s}


def test_copies_of_a_text_that_is_no_centre(spark, monkeypatch):
    """Copies are linked with a text of the largest id, not with each other: questions grow as copies, not as their pairs."""
    rng, base = random.Random(3), [f"w{k}" for k in range(400)]
    copies = [list(base) for _ in range(150)]
    for i, words in enumerate(copies):
        for k in rng.sample(range(0, 400, 5), 8):
            words[k] = f"own{i}x{k}"
    rows = [*((i, " ".join(words)) for i, words in enumerate(copies)), (1000, " ".join(base))]
    asked, before = [], minhash.rest

    def rest(*args):
        out = before(*args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(minhash, "rest", rest)
    assert found(frame(spark, rows)) == brute_force(rows)
    assert sum(asked) < 10 * len(rows)


def test_texts_of_stars_are_taken_once(documents, monkeypatch):
    """What compares texts gets a table of those alone that some bucket holds with others."""
    given = []
    for name in ("confirm", "meet_components"):
        own = getattr(minhash, name)
        at = 1 if name == "confirm" else 2

        def call(*args, own=own, at=at):
            given.append(args[at])
            stars = args[0]
            assert not stars.select("doc_id").join(args[at], "doc_id", "left_anti").head()
            assert args[at].count() < documents.count()
            return own(*args)

        monkeypatch.setattr(minhash, name, call)
    assert near_duplicates(documents).count() == documents.count()
    assert given and all(texts.inputFiles() == given[0].inputFiles() for texts in given)
