"""Merkle manifest of a data set: leaves, trees of three branches, and witnesses that grow as leaves are appended.

``H`` is the SHA-256 of its inputs one after the other, as small hexadecimal digits; digests enter it as such digits.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import number_rows
from .store import discard, stored

#: Children of a node.
FAN = 3
#: Levels of a block, whose ``FAN ** LEVELS`` leaves one task appends.
LEVELS = 7


def field(value: Column) -> Column:
    """A column as it enters a leaf: its bytes after their number, or a sign for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def node(children: list[bytes]) -> bytes:
    """``H`` of raw digests, raw."""
    return sha256(hexlify(b"".join(children))).digest()


class Appender:
    """A tree that takes leaves one by one, and each leaf's witness so far.

    At each level the open run waits for its siblings. When a run is complete, or the tree is closed, the witnesses of all
    leaves below each child get the child's siblings and its place among them: the leaves of a subtree lie together, so
    that is one assignment for each child. ``sizes`` is 0 at levels that a witness has not reached.
    """

    def __init__(self, levels: int) -> None:
        most = FAN**levels
        self.levels = levels
        self.siblings = np.zeros((most, levels, FAN - 1, 32), np.uint8)
        self.places = np.zeros((most, levels), np.uint8)
        self.sizes = np.zeros((most, levels), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self.open: list[list[tuple[bytes, int]]] = [[] for _ in range(self.levels + 1)]

    def append(self, digest: bytes) -> None:
        self.count += 1
        self.sizes[self.count - 1] = 0
        self._put(0, digest, self.count - 1, self.count)

    def _put(self, level: int, digest: bytes, first: int, end: int) -> None:
        self.open[level].append((digest, first))
        if level < self.levels and len(self.open[level]) == FAN:
            self._join(level, end)

    def _join(self, level: int, end: int) -> None:
        """Make a run a node of the next level."""
        run = self.open[level]
        self.open[level] = []
        bounds = [first for _, first in run] + [end]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            others = b"".join(d for j, (d, _) in enumerate(run) if j != k)
            self.siblings[a:b, level, : len(run) - 1] = np.frombuffer(others, np.uint8).reshape(-1, 32)
            self.places[a:b, level] = k
            self.sizes[a:b, level] = len(run)
        self._put(level + 1, node([d for d, _ in run]), bounds[0], end)

    def close(self) -> bytes:
        """The root: open runs are joined level by level, as long as a level has more than one node."""
        level, nodes = 0, self.count
        while nodes > 1:
            if self.open[level]:
                self._join(level, self.count)
            level, nodes = level + 1, -(-nodes // FAN)
        return self.open[level][0][0]

    def witnesses(self) -> Iterator[tuple[bytes, bytes]]:
        """For each leaf its siblings, level by level and left to right, and ``FAN * place + size - 1`` of each level."""
        used = self.sizes[: self.count] > 0
        there = np.arange(1, FAN) < self.sizes[: self.count, :, None]
        codes = (FAN * self.places[: self.count] + self.sizes[: self.count] - 1).astype(np.uint8)
        for k in range(self.count):
            yield self.siblings[k][there[k]].tobytes(), codes[k][used[k]].tobytes()


def fold(digest: bytes, siblings: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and its witness."""
    at = 0
    for code in path:
        place, others = divmod(code, FAN)
        middle, end = at + 32 * place, at + 32 * others
        digest, at = node([siblings[at:middle], digest, siblings[middle:end]]), end
    return digest


def blocks(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Append each block's nodes: their witnesses within the block, and the roots of the blocks as further nodes.

    ``nodes`` has ``tree, idx, digest``. The first frame has ``tree, idx, block, siblings, path``, the second one the
    columns of ``nodes`` and ``path``, as long as the block has levels, and both are stored.
    """
    size = FAN**levels
    dealt = nodes.select("tree", "idx", "digest").withColumn("block", F.expr(f"idx div {size}"))
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Appender(levels)
        at: tuple | None = None

        def finish() -> Iterator[pa.RecordBatch]:
            if tree.count:
                root = tree.close()
                siblings, paths = zip(*tree.witnesses())
                n = tree.count
                alone = bytes(max(map(len, paths)))
                rows = ([at[0]] * (n + 1), [at[1] * size + k for k in range(n)] + [None], [at[1]] * (n + 1))
                columns = [pa.array(c, pa.int64()) for c in rows]
                columns += [pa.array([*siblings, root], pa.binary()), pa.array([*paths, alone], pa.binary())]
                tree.clear()
                yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "block", "siblings", "path"])

        for batch in batches:
            trees, numbers, digests = (batch.column(c).to_pylist() for c in ("tree", "block", "digest"))
            for key, digest in zip(zip(trees, numbers), digests):
                if key != at:
                    yield from finish()
                    at = key
                tree.append(digest)
        yield from finish()

    out = stored(dealt.mapInArrow(run, "tree long, idx long, block long, siblings binary, path binary"), "witnesses")
    roots = out.filter("idx IS NULL").select("tree", F.col("block").alias("idx"), F.col("siblings").alias("digest"), "path")
    return out.filter("idx IS NOT NULL"), roots


def lifted(roots: DataFrame, levels: int) -> DataFrame:
    """Block roots at the height of full blocks: the last block's root goes on alone, as a run of one, to that height."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for digest, path in zip(batch.column("digest").to_pylist(), batch.column("path").to_pylist()):
                for _ in range(levels - len(path)):
                    digest = node([digest])
                digests.append(digest)
            steps = pa.array([bytes(levels - len(p)) for p in batch.column("path").to_pylist()], pa.binary())
            columns = [batch.column("tree"), batch.column("idx"), pa.array(digests, pa.binary()), steps]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "digest", "alone"])

    return roots.mapInArrow(run, "tree long, idx long, digest binary, alone binary")


def grow(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The trees over ``tree, idx, digest``: ``tree, idx, siblings, path`` of each node, and ``tree, digest`` of each root.

    Blocks of ``FAN ** levels`` nodes are appended each in one task. Where a tree has several blocks, their roots are
    appended to a tree of their own, and what they get as witnesses extends those of all nodes below them.
    """
    own, roots = blocks(nodes, levels)
    last = roots.groupBy("tree").agg(F.max("idx").alias("last"))
    large = stored(last.filter("last > 0").select("tree"), "large-trees")
    if large.isEmpty():
        return own.drop("block"), roots.select("tree", "digest")
    upper = stored(lifted(roots.join(large, "tree"), levels), "block-roots")
    above, tops = grow(upper, levels)
    above = above.join(upper.select("tree", "idx", "alone"), ["tree", "idx"]).select(
        "tree", F.col("idx").alias("block"), F.col("siblings").alias("more"), F.concat("alone", "path").alias("further")
    )
    joined = own.join(above, ["tree", "block"], "left").select(
        "tree",
        "idx",
        F.concat("siblings", F.coalesce("more", F.lit(b""))).alias("siblings"),
        F.concat("path", F.coalesce("further", F.lit(b""))).alias("path"),
    )
    small = roots.join(large, "tree", "left_anti").select("tree", "digest")
    return joined, small.unionByName(tops)


def manifest(rows: DataFrame, group_column: str = "source", order_column: str = "doc_id", leaf_column: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """The rows with ``subroot, root, siblings, path`` of a tree of trees.

    Rows are the leaves of their group's tree, ascending by ``order_column`` (nulls first, then by leaf, so that the order
    of repeated rows makes no difference); the groups' roots, ordered by group (null first, then by bytes), are the leaves
    of one more tree. While a level has more than one node, every three consecutive ones become their ``H``, the last run
    also with fewer. ``siblings`` holds the raw digests that a leaf meets from its group's tree to the root, ``path`` its
    place and the size of the run at each level; ``fold`` gives the root back.

    Leaves are numbered by a range sort and appended in blocks of ``FAN ** levels`` by tasks that hold one block, whatever the sizes of
    the groups; a task gets no more of a large group than of others. ``rows`` must be a stored table with a leaf of 64
    hexadecimal digits in each row, without columns named like those that are added. No rows give no rows.
    """
    group, order = F.col(group_column), F.col(order_column)
    keyed = rows.select("*", group.isNotNull().alias("_named"), F.coalesce(group, F.lit("")).alias("_group"))
    numbered = number_rows(keyed, "_number", ["_named", "_group", order_column, leaf_column], start=0)
    numbered = stored(numbered, "numbered")
    first = numbered.groupBy("_named", "_group").agg(F.min("_number").alias("_first"))
    # Groups are numbered in their order; there are no more than rows.
    groups = stored(number_rows(first, "tree", ["_named", "_group"], start=0), "groups")
    placed = numbered.join(groups, ["_named", "_group"]).withColumn("idx", F.col("_number") - F.col("_first"))
    placed = stored(placed.drop("_named", "_group", "_first", "_number"), "placed")
    discard(numbered)

    witnesses, subroots = grow(placed.select("tree", "idx", F.unhex(leaf_column).alias("digest")), levels)
    subroots = stored(subroots, "subroots")
    above, root = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"), levels)
    above = above.select(F.col("idx").alias("tree"), F.col("siblings").alias("more"), F.col("path").alias("further"))
    above = subroots.join(above, "tree").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    joined = placed.join(witnesses, ["tree", "idx"]).join(above, "tree")
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.lower(F.hex("digest")).alias("subroot"),
        F.lower(F.hex("root")).alias("root"),
        F.concat("siblings", "more").alias("siblings"),
        F.concat("path", "further").alias("path"),
    )


def verified(proofs: DataFrame, leaf_column: str) -> DataFrame:
    """Adds ``folded_root``, which follows from a leaf and its ``siblings`` and ``path``, and ``proof_sha256`` of the siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, siblings, paths = (batch.column(c).to_pylist() for c in (leaf_column, "siblings", "path"))
            roots = [fold(bytes.fromhex(a), s, p).hex() for a, s, p in zip(leaves, siblings, paths)]
            hashes = [sha256(hexlify(s)).hexdigest() for s in siblings]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(roots, pa.string()), pa.array(hashes, pa.string())],
                [*batch.schema.names, "folded_root", "proof_sha256"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return proofs.mapInArrow(run, f"{kinds}, folded_root string, proof_sha256 string")


def tampered_copy(docs: DataFrame) -> DataFrame:
    """``doc_id, source, leaf, changed``: each row's leaf, and the leaf of its copy, which may have been tampered with.

    Tampering takes the line feeds out of the texts of rows whose id's crc32, of its decimal digits, is even; rows without
    an id are left alone, as are null texts.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return docs.select("doc_id", "source", leaf(*rest, F.col("text")).alias("leaf"), leaf(*rest, text).alias("changed"))


def audit(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A manifest of documents, and each row of a tampered copy held against it.

    ``docs`` has ``doc_id, source, lang, n_chars, text``; each may be null. Gives ``doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified`` for every row: the root that follows from the copy's leaf and the original
    siblings, and whether it is the manifest's. Repeated rows are leaves of their own; rows without an id come first in
    their source, rows without a source are a source of their own, before all others. Other columns are ignored; an empty
    table gives no rows.
    """
    leaves = stored(tampered_copy(docs), "leaves")
    found = verified(manifest(leaves, levels=levels), "changed")
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
