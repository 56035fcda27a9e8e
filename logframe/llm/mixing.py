"""Mixing overlapping sources to target weights, by min-cost flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.numbering import number_rows
from .store import scratch, stored, whole_row
from .text import pieces, string_bytes, word_spans

#: A step of the selection splits a pattern's documents into so many parts by hash.
PARTS = 1024
#: Documents of a part that are few enough to be put in order by one task.
FEW = 5000


def with_sizes(docs: DataFrame) -> DataFrame:
    """``key, doc_id, sources, size, name`` of whole texts; the name is a hash of all that tells rows apart but the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = string_bytes(part.column("text"))
                starts, _ = word_spans(data, offsets)
                sizes = np.diff(np.searchsorted(starts, offsets))
                columns = [part.column(c) for c in ("key", "doc_id", "sources", "name")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], ["key", "doc_id", "sources", "name", "size"])

    name = F.xxhash64("doc_id", F.col("doc_id").isNull(), "sources", "text").alias("name")
    return docs.select("*", name).mapInArrow(run, "key long, doc_id long, sources array<string>, name long, size long")


def with_order(sized: DataFrame, seed: int) -> DataFrame:
    """Adds ``order``, a place in the seeded order for each row: equal rows are numbered, so each has its own place."""
    repeated = stored(sized.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "repeated")
    alike = sized.select("key", "name").join(repeated, "name")
    numbered = stored(number_rows(alike, "number", ["name"]), "numbered")
    first = numbered.groupBy("name").agg(F.min("number").alias("first"))
    ranks = numbered.join(first, "name").select("key", (F.col("number") - F.col("first")).alias("rank"))
    rank = F.coalesce("rank", F.lit(0).cast("long"))
    return sized.join(ranks, "key", "left").withColumn("order", F.xxhash64(F.lit(seed), "name", rank)).drop("rank", "name")


def fair_targets(sizes: Sequence[int], weights: Sequence[float], repeats: int, total: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeats`` times its size; what is above goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_ and left > 0:
        share = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if share * weights[k] >= repeats * sizes[k]]
        for k in full or open_:
            targets[k] = float(repeats * sizes[k]) if full else share * weights[k]
        if not full:
            break
        open_ -= set(full)
        left -= sum(targets[k] for k in full)
    return targets


class FlowNetwork:
    """Min-cost flow by shortest augmenting paths."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def arc(self, a: int, b: int, room: int, cost: float = 0) -> int:
        for start, end, space, price in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.to))
            self.to.append(end)
            self.room.append(space)
            self.cost.append(price)
        return len(self.to) - 2

    def send(self, start: int, end: int) -> None:
        """As much as possible from start to end, as cheaply as possible."""
        while True:
            price, arrived = {start: 0.0}, {}
            queue, queued = deque([start]), {start}
            while queue:
                node = queue.popleft()
                queued.discard(node)
                for k in self.out[node]:
                    new = price[node] + self.cost[k]
                    if self.room[k] and new < price.get(self.to[k], float("inf")):
                        price[self.to[k]], arrived[self.to[k]] = new, k
                        if self.to[k] not in queued:
                            queue.append(self.to[k])
                            queued.add(self.to[k])
            if end not in price:
                return
            path, node = [], end
            while node != start:
                path.append(arrived[node])
                node = self.to[arrived[node] ^ 1]
            amount = min(self.room[k] for k in path)
            for k in path:
                self.room[k] -= amount
                self.room[k ^ 1] += amount


@dataclass
class Plan:
    """What to take of each pattern of sources, and of it for each source."""

    taken: list[int]
    routed: dict[tuple[int, int], int]


def route(patterns: Sequence[Sequence[int]], sizes: Sequence[int], quotas: Sequence[int], repeats: int) -> Plan:
    """Tokens of each pattern for the quotas of its sources; the k-th use of a token costs k - 1.

    With costs that grow, everything is used once before anything is used twice, wherever the quotas allow it.
    """
    first_source = 1 + len(patterns)
    end = first_source + len(quotas)
    net = FlowNetwork(end + 1)
    uses = [[net.arc(0, 1 + p, size, k) for k in range(repeats)] for p, size in enumerate(sizes)]
    ways = {
        (p, s): net.arc(1 + p, first_source + s, repeats * sizes[p]) for p, own in enumerate(patterns) for s in own
    }
    for s, quota in enumerate(quotas):
        net.arc(first_source + s, end, quota)
    net.send(0, end)
    return Plan([sum(net.room[k ^ 1] for k in arcs) for arcs in uses], {k: net.room[v ^ 1] for k, v in ways.items()})


def source_set(docs: DataFrame, sources: Column | str) -> Column:
    """The different sources of a row in order, null among them or alone."""
    column = F.col(sources) if isinstance(sources, str) else sources
    if not docs.select(column.alias("s")).dtypes[0][1].startswith("array"):
        column = F.array(column.cast("string"))
    column = F.array_sort(F.array_distinct(F.coalesce(column.cast("array<string>"), F.array().cast("array<string>"))))
    return F.when(F.size(column) == 0, F.array(F.lit(None).cast("string"))).otherwise(column)


def mix(
    docs: DataFrame,
    sources: Column | str = "source",
    id_column: str = "doc_id",
    text_column: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    repeats: int = 3,
    seed: int = 5,
    most_patterns: int = 100_000,
    key_column: str | None = None,
) -> DataFrame:
    """How often each document is taken, so that each source's words come near its target.

    ``sources`` is a string or an array of strings, for documents of several sources; null (or no element) is a
    source too. Sources in the order of code points, null last, have the ``weights`` in turn; together they get as
    many words as there are, but none more than ``repeats`` times its own. Documents are added up by pattern, the set
    of their sources, and a min-cost flow routes each pattern's words to its sources' quotas. What comes to the driver
    is one row for each pattern; more than ``most_patterns`` are an error. Of each pattern all documents are taken as often
    as the whole part of its flow says; for the rest, those first in a seeded order are taken once more, and then those
    whose size is nearest to what is still missing.

    Gives ``doc_id, size, sources, source_size, target, copies, taken``; size, size of the sources and target are in
    words, target adds up those of a document's sources, and ``taken = copies * size``. A null or empty text has size
    0. The same rows give the same result, however they are split. Rows that repeat an id, have none, or are equal in all
    columns are separate documents, each with a place of its own in the order. Other columns are ignored; an empty table
    gives no rows. With ``key_column``, a long that is different in each row, the result has it as ``key``.
    """
    rows = docs.select(
        (F.col(key_column) if key_column else F.monotonically_increasing_id()).alias("key"),
        F.col(id_column).cast("long").alias("doc_id"),
        source_set(docs, sources).alias("sources"),
        F.col(text_column).alias("text"),
    )
    with scratch(docs.sparkSession) as keep:
        sized = stored(with_sizes(rows), "sizes")
        plans = planned(sized, weights, repeats, most_patterns)
        placed = stored(with_order(sized, seed).join(plans, "sources"), "placed")
        more = chosen(placed.filter("rest > 0").select("pattern", "key", "size", "order", "rest"))
        picked = placed.join(more, "key", "left")
        copies = F.col("whole") + F.coalesce("more", F.lit(0))
        own = ["key"] if key_column else []
        taken = (copies * F.col("size")).alias("taken")
        return keep(
            picked.select(*own, "doc_id", "size", "sources", "source_size", "target", copies.alias("copies"), taken), "mixture"
        )


def planned(sized: DataFrame, weights: Sequence[float], repeats: int, most_patterns: int) -> DataFrame:
    """``pattern, sources, source_size, target, whole, rest``: how often a pattern is taken, and the words beyond that."""
    sums = stored(sized.groupBy("sources").agg(F.sum("size").alias("size")), "patterns")
    if sums.count() > most_patterns:
        raise ValueError(f"documents have more than {most_patterns} different sets of sources")
    found = sums.collect()
    names = sorted({s for r in found for s in r.sources}, key=lambda s: (s is None, s or ""))
    number = {s: k for k, s in enumerate(names)}
    patterns = [[number[s] for s in r.sources] for r in found]
    sizes, own = [r["size"] for r in found], [0] * len(names)
    for p, n in zip(patterns, sizes):
        for s in p:
            own[s] += n
    targets = fair_targets(own, [weights[k % len(weights)] for k in range(len(names))], repeats, sum(sizes))
    plan = route(patterns, sizes, [round(t) for t in targets], repeats)
    table = [
        (k, r.sources, sum(own[s] for s in p), sum(targets[s] for s in p), plan.taken[k] // max(1, n), plan.taken[k] % max(1, n))
        for k, (r, p, n) in enumerate(zip(found, patterns, sizes))
    ]
    schema = "pattern int, sources array<string>, source_size long, target double, whole long, rest long"
    return sized.sparkSession.createDataFrame(table, schema)


def chosen(docs: DataFrame, rounds: int = 4) -> DataFrame:
    """The documents to take once more: ``key, more``.

    ``docs`` has ``pattern, key, size, order, rest``, and hardly any two rows have the same order. The running sum over a pattern's order is found by narrowing down: sums
    of ``PARTS`` parts show the part in which the rest is used up, which is split again until few documents are left.
    """
    one = docs
    # The interval of the order still open, and the words still to take, for each pattern.
    low, high = -(2.0**63), 2.0**63
    state = one.groupBy("pattern").agg(F.first("rest").alias("left")).select("pattern", F.lit(low).alias("low"), F.lit(high).alias("high"), "left")
    while True:
        state = stored(state, "mix-state")
        inside = one.join(F.broadcast(state), "pattern").filter("CAST(`order` AS DOUBLE) >= low AND CAST(`order` AS DOUBLE) < high")
        part = F.least(F.floor((F.col("order").cast("double") - F.col("low")) / (F.col("high") - F.col("low")) * PARTS), F.lit(PARTS - 1))
        sums = inside.groupBy("pattern", "low", "high", "left", part.alias("part")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        running = Window.partitionBy("pattern").orderBy("part")
        sums = stored(sums.withColumn("before", F.sum("sum").over(running) - F.col("sum")), "mix-sums")
        cut = sums.filter("before <= left AND before + sum > left")
        width = (F.col("high") - F.col("low")) / PARTS
        start = F.col("low") + F.col("part") * width
        narrowed = cut.select("pattern", start.alias("low"), (start + width).alias("high"), (F.col("left") - F.col("before")).alias("left"), "n")
        narrowed = stored(narrowed, "mix-state")
        # Below this width doubles tell no more parts apart.
        state = narrowed.drop("n")
        if narrowed.filter(F.col("n") > FEW).isEmpty() or narrowed.filter(F.col("high") - F.col("low") > 2.0**20).isEmpty():
            break
    ends = F.broadcast(state)
    joined = one.join(ends, "pattern", "left").withColumn("at", F.col("order").cast("double"))
    window = Window.partitionBy("pattern").orderBy("order", "size", "key")
    last = joined.filter("at >= low AND at < high").withColumn("until", F.sum("size").over(window)).filter("until <= left")
    before = joined.filter("at < low OR low IS NULL")
    columns = ["pattern", "key", "size"]
    taken = stored(before.select(*columns).unionByName(last.select(*columns)), "mix-taken")
    for _ in range(rounds):
        used = taken.groupBy("pattern").agg(F.sum("size").alias("used"))
        gaps = one.groupBy("pattern").agg(F.first("rest").alias("rest")).join(used, "pattern", "left")
        gaps = stored(gaps.select("pattern", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("gap")).filter("gap > 0"), "mix-gaps")
        spare = one.join(F.broadcast(gaps), "pattern").filter("size > 0 AND size < 2 * gap").join(taken.select("key"), "key", "left_anti")
        off = F.abs(F.col("size") - F.col("gap")).alias("off")
        best = spare.groupBy("pattern").agg(F.min(F.struct(off, "order", "size", "key")).alias("best"))
        best = stored(best.select("pattern", "best.key", "best.size"), "mix-best")
        if best.isEmpty():
            break
        taken = stored(taken.unionByName(best), "mix-taken")
    return taken.select("key", F.lit(1).alias("more"))


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of a mixture of them, each as often as it is taken; ``options`` are those of ``mix``."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("key"), whole_row(docs)), "mixed-rows")
    columns = ["id_column", "text_column"]
    names = {c: options.pop(c, d) for c, d in zip(columns, ("doc_id", "text"))}
    sources = options.pop("sources", "source")
    narrow = rows.select(
        "key",
        F.col(f"row.`{names['id_column']}`").alias("doc_id"),
        F.col(f"row.`{names['text_column']}`").alias("text"),
        source_set(rows, F.col(f"row.`{sources}`")).alias("sources"),
    )
    mixture = mix(narrow, "sources", key_column="key", **options).filter("copies > 0").select("key", F.col("copies").cast("int"))
    # Rows and what is taken of them grow alike, so neither side is broadcast.
    joined = rows.join(mixture.hint("merge"), "key")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
