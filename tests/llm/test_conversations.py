import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logframe.llm.conversations import QUEUE_ROWS, prefix_trie, subtree_totals
from logframe.llm.queries import op13_prefix_trie

from .conftest import SF_DIR

KINDS = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            turns[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
        for k in range(len(whole) + 1):
            members[whole[:k]].append((c, len(whole)))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for k in range(len(path) + 1):
            leaves[path[:k]] += not children[path]
            saved[path[:k]] += (len(own) - 1) * len(path[-1][1]) if path else 0
    for path, own in members.items():
        ends = ",".join(map(str, sorted(c for c, n in own if n == len(path))))
        parent = min(members[path[:-1]])[0] if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        yield str((min(own)[0], len(path), parent, len(own), children[path], leaves[path], saved[path], digest))


def check(turns):
    got = prefix_trie(turns).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(brute(turns.collect()))
    return got


def test_given_conversations(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    got = op13_prefix_trie(spark, SF_DIR).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(brute(turns.collect()))


def test_shared_turns(spark):
    """A first turn that all share, copies in many groups, and conversations that end inside others."""
    rows = []
    for c in range(0, 3000, 7):
        for t in range(c % 9):
            rows.append((c, t, "user" if t % 2 else None, "hello" if t == 0 else f"turn {t} of {c % 3 if c % 2 else c}"))
    got = check(spark.createDataFrame(rows, KINDS))
    assert any(r.n_convs > 100 and r.depth == 1 for r in got)


def test_edges(spark):
    rows = [
        (-5, 0, "user", "a"), (-105, 1, "user", "a"), (-100, 1, "user", "äöü 中"), (0, 0, "user", "a\nb"),
        (7, None, "user", None), (7, 1, None, "x" * 300_000), (7, 1, None, "x" * 300_000), (7, 1, "b", ""),
        (8, 3, None, None), (None, 1, "user", "of nobody"), (107, 2, "a", "bc"), (108, 2, "ab", "c"),
        (2**62, 0, "user", "far"), (200, 0, "u", "only"), (203, 0, "u", "a"), (203, 0, "u", "b"),
    ]
    turns = spark.createDataFrame(rows, KINDS)
    check(turns.select("*", *[F.lit("own").alias(c) for c in ("depth", "rank", "high", "head", "shard")]))
    assert prefix_trie(turns.filter("false")).count() == 0


@pytest.mark.parametrize("most", [4, 100, QUEUE_ROWS])
@pytest.mark.parametrize("rows_a_batch", [3, 1000])
def test_queue_spills(most, rows_a_batch):
    """A random forest whose names clash in their upper halves, with nodes of several rows."""
    rng = np.random.default_rng(3)
    levels = [[(0, 0)]]
    for depth in range(1, 7):
        levels.append(sorted({(int(rng.integers(-5, 5)), int(rng.integers(0, 40))) for _ in range(30 * depth)}))
    rows, wanted, up = [], {}, {}
    for depth in range(6, -1, -1):
        for name in levels[depth]:
            parent = levels[depth - 1][rng.integers(len(levels[depth - 1]))] if depth else (0, 0)
            up[depth, name] = parent
            for _ in range(rng.integers(1, 4)):
                rows.append((depth, *name, *parent, int(rng.integers(3)), int(rng.integers(100))))
    for depth, high, low, _, _, leaves, saved in rows:
        name = (high, low)
        for d in range(depth, -1, -1):
            wanted[d, name] = wanted.get((d, name), np.zeros(2, int)) + (leaves, saved)
            name = up[d, name]
    rows.sort(key=lambda r: (-r[0], r[1], r[2]))
    columns = ["depth", "high", "low", "up_high", "up_low", "leaves", "saved"]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + rows_a_batch])], columns)
        for k in range(0, len(rows), rows_a_batch)
    ]
    got = {}
    for batch in subtree_totals(iter(batches), most):
        for depth, high, low, leaves, saved in zip(*[c.to_pylist() for c in batch.columns]):
            key = (depth, (high, low))
            got[key] = got.get(key, np.zeros(2, int)) + (leaves, saved)
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(v) for k, v in wanted.items()}
