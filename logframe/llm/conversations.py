"""Conversation prefix trie: nodes shared by conversations, and totals of subtrees by time-forward processing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

#: What names a node: its depth, and 128 bits of the turns on the way to it.
NODE = ["depth", "high", "low"]
#: Messages that a queue holds in memory.
QUEUE_ROWS = 1 << 18
#: Ids that make one piece of a list that is hashed.
PIECE_IDS = 20_000

_KEY = [("level", np.int64), ("high", np.int64), ("low", np.int64)]
_MESSAGE = np.dtype([*_KEY, ("leaves", np.int64), ("saved", np.int64)])
_ORDER = ["level", "high", "low"]


def summed(messages: np.ndarray) -> np.ndarray:
    """Messages in order, those to one node added up."""
    if len(messages) < 2:
        return messages
    messages = messages[np.lexsort([messages[c] for c in reversed(_ORDER)])]
    keys = messages[_ORDER]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out = messages[first]
    for c in ("leaves", "saved"):
        out[c] = np.add.reduceat(messages[c], first)
    return out


def through(run: np.ndarray, bound: tuple[int, int]) -> int:
    """How many of the sorted messages go to nodes up to a level and upper half of a name."""
    a, b = np.searchsorted(run["level"], bound[0], "left"), np.searchsorted(run["level"], bound[0], "right")
    return int(a + np.searchsorted(run["high"][a:b], bound[1], "right"))


class SpillingQueue:
    """A priority queue of messages to nodes that come later; what passes the memory goes to sorted runs in files."""

    def __init__(self, folder: str, most: int = QUEUE_ROWS) -> None:
        self.folder, self.most = Path(folder), most
        self.waiting: list[np.ndarray] = []
        self.count = self.files = 0
        self.runs: list[np.ndarray] = []

    def push(self, messages: np.ndarray) -> None:
        self.waiting.append(messages)
        self.count += len(messages)
        if self.count > self.most:
            self._spill(summed(np.concatenate(self.waiting)))
            self.waiting, self.count = [], 0

    def _spill(self, run: np.ndarray) -> None:
        path = self.folder / f"run-{self.files}.npy"
        self.files += 1
        np.save(path, run)
        self.runs.append(np.load(path, mmap_mode="r"))
        # The file goes with its last reader.
        path.unlink()

    def pop_through(self, bound: tuple[int, int]) -> np.ndarray:
        """All messages to nodes up to ``bound``, in order and added up."""
        memory = summed(np.concatenate(self.waiting)) if self.waiting else np.zeros(0, _MESSAGE)
        cut = through(memory, bound)
        found, self.waiting = [memory[:cut]], [memory[cut:]]
        self.count = len(memory) - cut
        rest = []
        for run in self.runs:
            cut = through(run, bound)
            found.append(np.array(run[:cut]))
            if cut < len(run):
                rest.append(run[cut:])
        self.runs = rest
        return summed(np.concatenate(found))


def subtree_totals(batches: Iterator[pa.RecordBatch], most: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """``depth, high, low, leaves, saved``: what the rows of one shard add up to in each node's subtree.

    Rows are ``depth, high, low, up_high, up_low, leaves, saved`` in reverse level order: deepest first, then by name. A
    node may have several rows, one after the other. Each node takes the messages that its children sent it before, and
    sends its totals on to its parent, which comes later.
    """
    names = [*NODE, "leaves", "saved"]
    with tempfile.TemporaryDirectory() as folder:
        queue = SpillingQueue(folder, most)
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            cuts = np.flatnonzero(np.diff(rows["depth"])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                own = np.zeros(b - a, _MESSAGE)
                own["level"] = -rows["depth"][a:b]
                for c in ("high", "low", "leaves", "saved"):
                    own[c] = rows[c][a:b]
                # One row for each node; its parent is the same in all of them.
                nodes = summed(own)
                where = np.flatnonzero(np.concatenate([[True], own[_ORDER][1:] != own[_ORDER][:-1]]))
                parents = {c: rows[c][a:b][where] for c in ("up_high", "up_low")}
                got = queue.pop_through((int(nodes["level"][-1]), int(nodes["high"][-1])))
                place, same = places(nodes, got)
                for c in ("leaves", "saved"):
                    nodes[c][place[same]] += got[c][same]
                if not same.all():
                    # Nodes with the same upper half that are in the next batch.
                    queue.push(got[~same])
                depth = -nodes["level"]
                inner = depth > 0
                up = nodes[inner].copy()
                up["level"], up["high"], up["low"] = up["level"] + 1, parents["up_high"][inner], parents["up_low"][inner]
                if len(up):
                    queue.push(up)
                yield pa.RecordBatch.from_arrays([pa.array(depth), *[pa.array(nodes[c]) for c in names[1:]]], names)


def places(nodes: np.ndarray, messages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each message's node among the sorted nodes, and whether it is there at all."""
    both = np.concatenate([nodes, messages])
    order = np.lexsort([np.arange(len(both)) >= len(nodes), *[both[c] for c in reversed(_ORDER)]])
    place = np.maximum.accumulate(np.where(order < len(nodes), order, -1))
    found = np.empty(len(both), np.int64)
    found[order] = place
    found = found[len(nodes) :]
    same = (found >= 0) & (nodes[_ORDER][found] == messages[_ORDER]) if len(messages) else np.zeros(0, bool)
    return found, same


def shards(rows: DataFrame) -> DataFrame:
    """``depth, high, low, leaves, saved`` of each node in each shard that it occurs in. ``rows`` has ``shard`` and what
    ``subtree_totals`` takes; shards are of bounded size, and a task may hold several of them."""
    placed = rows.repartition("shard").sortWithinPartitions(F.desc("depth"), "high", "low").drop("shard")
    return placed.mapInArrow(subtree_totals, "depth long, high long, low long, leaves long, saved long")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``depth, high, low, ends_sha256``: the hash of the ids of each node's rows, ascending, with commas between.

    Ids are sorted and joined to pieces by tasks that each get a range of nodes and ids, so that a node with very many
    of them is spread; only the pieces of a node meet, in order, in the task that hashes them one after the other.
    """
    keys = [*NODE, "conv_id"]
    sorted_ids = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in keys]
            change = np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)
            cuts = np.flatnonzero(change) + 1
            texts = list(map(str, columns[3].tolist()))
            bounds = [p for a, b in zip([0, *cuts], [*cuts, len(texts)]) for p in range(a, b, PIECE_IDS)] + [len(texts)]
            pieces = [",".join(texts[a:b]) for a, b in zip(bounds, bounds[1:])]
            first = np.array(bounds[:-1], np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in columns], pa.array(pieces, pa.string())], [*keys, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, done = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [*zip(*done)] or [[]] * 4
            done.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, [*NODE, "ends_sha256"])

        for batch in batches:
            for *key, _, ids in zip(*(batch.column(c).to_pylist() for c in [*keys, "ids"])):
                if key != at:
                    if at:
                        done.append((*at, state.hexdigest()))
                    state, at = sha256(ids.encode()), key
                else:
                    state.update(b"," + ids.encode())
            yield flush()
        if at:
            done.append((*at, state.hexdigest()))
        yield flush()

    pieces = sorted_ids.mapInArrow(joined, "depth long, high long, low long, conv_id long, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*keys)
    return pieces.mapInArrow(hashed, "depth long, high long, low long, ends_sha256 string")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """``conv_id, depth, role, text`` of rebuilt conversations, in turns from depth 1, and a row of depth 0 for each.

    A conversation c begins with the first h turns of conversation c - c % ``group``, h being crc32 of its id modulo
    ``most``, and goes on with its own turns after its first h.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    ranked = stored(turns.withColumn("rank", F.row_number().over(order).cast("long")).drop("turn"), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    all_ids = ranked.filter("rank = 1").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("first_id"), taken.alias("h")
    )
    # A conversation lends at most so many turns, to at most 2 * group others.
    heads = ranked.filter(F.col("rank") < most).groupBy("conv_id").agg(F.collect_list(F.struct("rank", "role", "text")).alias("head"))
    lent = all_ids.join(heads.withColumnRenamed("conv_id", "first_id"), "first_id", "left")
    lent = lent.withColumn("head", F.filter("head", lambda t: t["rank"] <= F.col("h")))
    lent = lent.select("conv_id", "h", F.coalesce("head", F.array().cast("array<struct<rank: bigint, role: string, text: string>>")).alias("head"))
    first = lent.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.rank").alias("depth"), "t.role", "t.text")
    shift = lent.select("conv_id", "h", F.size("head").alias("n"))
    own = ranked.join(shift, "conv_id").filter("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("n")).alias("depth"), "role", "text")
    empty = F.lit("")
    roots = all_ids.select("conv_id", F.lit(0).cast("long").alias("depth"), empty.alias("role"), empty.alias("text"))
    return roots.unionByName(first).unionByName(own)


def names(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, high, low, up_high, up_low, size, ends`` of each turn: the names of its node and of the node's parent.

    A turn's hash depends on its depth; a node's name is the exclusive or of the hashes of all turns to it, 128 bits of
    SHA-256, so equal names are equal sequences of turns.
    """
    role = F.col("role")
    whole = F.sha2(F.concat_ws(":", "depth", F.octet_length(role), role, "text"), 256)
    half = lambda k: F.conv(F.substring(whole, k, 16), 16, -10).cast("long")
    hashed = turns.select("conv_id", "depth", F.length("text").cast("long").alias("size"), half(1).alias("a"), half(17).alias("b"))
    order = Window.partitionBy("conv_id").orderBy("depth")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = hashed.select(
        "conv_id", "depth", "size", "a", "b",
        F.bit_xor("a").over(so_far).alias("high"),
        F.bit_xor("b").over(so_far).alias("low"),
        F.lead("depth").over(order).isNull().alias("ends"),
    )
    above = [F.col(c).bitwiseXOR(F.col(t)).alias(f"up_{c}") for c, t in (("high", "a"), ("low", "b"))]
    return named.select("conv_id", *NODE, *above, "size", "ends")


def prefix_trie(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The trie of rebuilt conversations: a row for each distinct sequence of first turns, from the empty one.

    ``turns`` has ``conv_id, turn, role, text``. Gives ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``; see ``rebuilt_turns`` for what is rebuilt. Turns are ordered by
    ``turn``, nulls first, those that tie by role and text; a null role or text is an empty one, and a repeated row is a
    further turn. Rows without an id belong to no conversation and are left out. Other columns are ignored; an empty table
    gives no rows, not even a root.

    Each node's own share of its subtree's totals is held by its smallest member. Shards hold the paths of the
    conversations that begin with the same conversation, at most ``2 * group`` of them; within a shard totals go up
    in reverse level order, through queues. Nodes that several shards share, the root first, are the shards' roots: what
    the shards found for them is added up.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    paths = stored(names(rebuilt_turns(turns, group, most)), "paths")
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("up_high").alias("up_high"),
        F.max("up_low").alias("up_low"),
        F.max("size").alias("size"),
        F.count_if("ends").alias("n_ends"),
    )
    nodes = stored(nodes, "nodes")
    shard = (F.col("conv_id") - F.col("conv_id") % group).alias("shard")
    zero = F.lit(0).cast("long")
    way = [shard, *NODE, "up_high", "up_low"]
    leaves = (F.col("n_convs") == F.col("n_ends")).cast("long")
    own = nodes.select(*way, leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    totals = shards(paths.select(*way, zero.alias("leaves"), zero.alias("saved")).unionByName(own))
    totals = totals.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    parent: list[Column] = [(F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low")]
    children = nodes.filter("depth > 0").select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    ends = ends_hashes(paths.filter("ends"))
    known = nodes.join(totals, NODE).join(children, NODE, "left").join(ends, NODE, "left")
    above = nodes.select("depth", F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent_conv_id"))
    known = known.withColumn("up", F.col("depth") - 1).join(above.withColumnRenamed("depth", "up"), ["up", "up_high", "up_low"], "left")
    return known.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
