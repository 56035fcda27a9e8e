import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from logframe.llm import decontaminate as module
from logframe.llm.decontaminate import contamination, decontaminate
from logframe.llm.queries import op11_decontamination

from .conftest import SF_DIR, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def item_windows(items, size):
    found = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found[tuple(w[k : k + n])].add(item)
    return found


def brute(text, windows):
    """Words, numbers of hit words, and items found."""
    w, hit, items = words(text), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                items |= windows[tuple(w[k : k + n])]
    return len(w), sorted(hit), sorted(i for i in items if i is not None)


def found(rows):
    for r in rows:
        hit = [k for s in r.spans for k in range(s.first, s.end)]
        assert len(hit) == len(set(hit)) and all(a.end < b.first for a, b in zip(r.spans, r.spans[1:]))
        yield r.row.doc_id, r.row.text, (r.n_words, hit, sorted(r["items"]))


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [
    (7, "beta GAMMA delta epsilon zeta eta theta iota kappa alpha beta gamma"),
    (7, "one two"),
    (10, "'two'"),
    (2, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"),
    (None, "word100 word101"),
    (3, None),
    (4, " .,;"),
    (5, "äöü, 中文"),
    (6, "x" * 300_000),
]


def test_given_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    windows = item_windows([tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()], 10)
    rows = op11_decontamination(spark, SF_DIR).collect()
    for r in rows:
        n, hit, items = brute(docs[r.doc_id], windows)
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(items), digest, bool(hit))
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)


def test_edges(spark, edges, nothing):
    items, windows = bench(spark, ITEMS), item_windows(ITEMS, 10)
    for set_bytes in (1 << 25, 1 << 19):
        got = list(found(contamination(edges, items, set_bytes=set_bytes).collect()))
        assert len(got) == edges.count()
        for _, text, answer in got:
            assert answer == brute(text, windows)
    assert contamination(nothing, items).count() == 0
    assert all(not r.spans for r in contamination(edges, bench(spark, [])).collect())
    assert decontaminate(edges, items).columns == edges.columns


def test_many_sets_agree_with_one(spark, documents):
    """A window that very many items have, and sets of a few windows each."""
    items = [(k, "the same passage of ten words that all items hold " + f"own{k % 50}") for k in range(400)]
    docs = frame(spark, [(k, f"Before. The same passage of ten words that all items hold; own{k} after") for k in range(30)])
    once = contamination(docs, bench(spark, items)).collect()
    dealt = contamination(docs, bench(spark, items), set_bytes=16_000).collect()
    assert sorted(found(once)) == sorted(found(dealt))
    assert all(len(answer[2]) == 400 for _, _, answer in found(once))


def test_spans_or_documents_go(spark):
    items = bench(spark, [(1, "One two three"), (2, "é ü")])
    texts = ["Keep this. ONE, two: three! And this", "é-Ü", "nothing", None, "one two three one two three"]
    docs = frame(spark, list(enumerate(texts)))
    cut = {r.doc_id: r.text for r in decontaminate(docs, items).collect()}
    assert cut == {0: "Keep this. ! And this", 1: "é-Ü", 2: "nothing", 3: None, 4: ""}
    left = decontaminate(docs, items, whole_documents=True)
    assert {r.doc_id for r in left.collect()} == {1, 2, 3} and left.columns == docs.columns
    most = decontaminate(docs, items, whole_documents=True, most_hit=0.5)
    assert {r.doc_id for r in most.collect()} == {0, 1, 2, 3}


def test_equal_hashes_are_verified(spark, monkeypatch):
    """Windows that hash alike are told apart by their words."""
    monkeypatch.setattr(module.Words, "windows", _flat)

    rows = pa.table({"window": ["a b", "c d", "e f"], "item_id": pa.array([1, 2, 3], pa.int64())})
    batch = pa.RecordBatch.from_pydict({"text": ["x a b c d", "b a d c", "e", None]})
    _, spans, items = module.scan(batch, module.WindowSet(rows))
    assert [s.tolist() for s in spans] == [[[1, 5]], [], [], []] and [i.tolist() for i in items] == [[1, 2], [], [], []]


def _flat(words, size):
    return np.zeros(max(0, len(words.hashes) - size + 1), np.uint64)
