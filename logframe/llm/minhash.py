"""Near-duplicate documents by one-permutation MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .groups import meet_in_blocks, sorted_groups
from .store import scratch, stored
from .text import BASE, U64, mix, pieces, shingle_hashes, word_hashes

#: So many candidates of one star are compared in one group.
STAR_PART = 64
#: Members of a bucket that are compared by their sketches in one group.
REST_BLOCK = 1024
#: So often the main component of each bucket is asked before all others are.
MAIN_ROUNDS = 2
#: Documents of a component whose texts are compared in one group.
TEXT_BLOCK = 256


@lru_cache
def detours(bins: int) -> np.ndarray:
    """Column i: the order in which bin i, if empty, asks the other bins for their value."""
    rng = np.random.default_rng(20170801)
    return rng.permuted(np.tile(np.arange(bins), (bins, 1)), axis=1).T


def densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Give every empty bin the value of the first filled bin on its own way through the bins, for each row."""
    ways = detours(values.shape[1])
    rows, columns = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for step in ways:
        if not len(rows):
            break
        asked = step[columns]
        found = filled[rows, asked]
        values[rows[found], columns[found]] = values[rows[found], asked[found]]
        rows, columns = rows[~found], columns[~found]


def sketch(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of band keys, and one byte of each bin, for each sorted set of 64-bit hashes.

    One pass of one hash: its upper half says the bin, the smallest hash in a bin is the bin's value.
    """
    bins = bands * rows
    values = np.zeros((len(sets), bins), U64)
    filled = np.zeros((len(sets), bins), bool)
    for n, hashes in enumerate(sets):
        if len(hashes):
            place = ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            values[n, place[first]] = hashes[first]
            filled[n, place[first]] = True
    densify(values, filled)
    keys = np.zeros((len(sets), bands), U64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            keys = keys * U64(BASE) + values[:, k::rows]
        keys += mix(np.arange(1, bands + 1, dtype=U64))
    return mix(keys), (mix(values) & U64(0xFF)).astype(np.uint8)


def text_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    words, places = word_hashes(batch.column("text"))
    return [shingle_hashes(words[a:b], size) for a, b in zip(places[:-1], places[1:])]


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, sum, xor, bands, bins`` of ``doc_id, text``; sum and xor stand for the whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = text_sets(part, size)
                with np.errstate(over="ignore"):
                    total = np.array([mix(s).sum(dtype=U64) for s in sets], U64)
                xor = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], U64)
                keys, bins = sketch(sets, bands, rows)
                keys = pa.array(keys.view(np.int64).ravel())
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                columns = [
                    part.column("doc_id"),
                    pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(total.view(np.int64)),
                    pa.array(xor.view(np.int64)),
                    pa.ListArray.from_arrays(ends, keys),
                    pa.array([b.tobytes() for b in bins], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sum", "xor", "bands", "bins"])

    return docs.mapInArrow(run, "doc_id long, n long, sum long, xor long, bands array<long>, bins binary")


def confirm(stars: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the candidate pairs ``centre, doc_id`` whose full sets are similar enough.

    The centre's text travels once for each ``STAR_PART`` of its candidates, and each candidate's text once for each
    of its centres. A task holds one centre's set at a time.
    """
    parts = stars.groupBy("centre").agg(F.ceil(F.count("*") / STAR_PART).alias("parts"))
    parts = stored(parts, "star-parts")
    spread = stars.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    members = spread.select("centre", "part", F.lit(1).alias("kind"), "doc_id").join(docs, "doc_id")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    centres = parts.select("centre", every, F.lit(0).alias("kind"), F.col("centre").alias("doc_id")).join(docs, "doc_id")
    columns = ["centre", "part", "kind", "doc_id", "text"]
    together = members.select(*columns).unionByName(centres.select(*columns))
    together = together.repartition("centre", "part").sortWithinPartitions("centre", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, own = None, []
        for batch in batches:
            for rows in pieces(batch, "text"):
                found = []
                heads = zip(*(rows.column(c).to_pylist() for c in columns[:4]))
                for (centre, part, kind, doc_id), shingles in zip(heads, text_sets(rows, size)):
                    if (centre, part) != star:
                        star, own = (centre, part), []
                    if kind == 0:
                        if not any(np.array_equal(shingles, s) for s in own):
                            own.append(shingles)
                    elif any(similar(shingles, s, percent) for s in own):
                        found.append((centre, doc_id))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["centre", "doc_id"]
                )

    return together.mapInArrow(run, "centre long, doc_id long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 5,
    percent: int = 75,
    bands: int = 48,
    rows: int = 5,
) -> DataFrame:
    """Groups of documents linked by similar sets of word shingles.

    Gives ``doc_id, n_shingles, component_id, kept`` for every row: the size of the set of distinct ``size``-word
    shingles (of all words as one, if they are fewer), the smallest id reachable over links, and whether that is the
    row's own id. Two documents are linked if their sets have ``percent`` hundredths of their union in common.

    Equal sets are one class, whose smallest id stands for it, so thousands of copies cost no pairs. Each class has
    ``bands * rows`` bins of one permutation hash, densified; classes with an equal band form a bucket. In a bucket
    everyone is compared with the smallest id only: a star. What is still in two components of a bucket after that
    is no matter for stars with one centre: each member outside the component that has most of the bucket is compared
    with that one, and those still outside are compared with the members of all. Pairs are confirmed on the full sets. A link at the threshold shares
    no band, and is missed, with probability ``(1 - s**rows)**bands``: 2e-6 at the default 0.75.

    A null or empty text, or one without words, has 0 shingles and no links. A row without an id has no links, a
    null component, and is kept. Rows that repeat an id are one node; each comes out, with its own ``n_shingles``.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    with scratch(docs.sparkSession) as keep:
        marked = stored(sketches(docs, size, bands, rows), "sketches")
        sets = marked.filter("n > 0 AND doc_id IS NOT NULL")
        alike = ["n", "sum", "xor"]
        groups = sets.groupBy(*alike).agg(F.min("doc_id").alias("class"), F.max("doc_id").alias("last"))
        groups = stored(groups.filter("class < last").drop("last"), "copies")
        copies = sets.select("doc_id", *alike).join(groups, alike).filter("doc_id > class")
        copies = stored(copies.select("doc_id", "sum", "xor", "class"), "copies")

        # Copies and members of stars grow with the documents: joins with them are alike at every size, none is broadcast.
        classes = sets.join(copies.hint("merge"), ["doc_id", "sum", "xor"], "left_anti")
        keys = classes.select("doc_id", "n", F.explode("bands").alias("key"))
        buckets = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
        buckets = buckets.filter("centre < last").drop("last")
        members = stored(keys.join(buckets, "key"), "buckets")

        stars = stored(members.filter("doc_id <> centre").select("centre", "doc_id").distinct(), "stars")
        # Whoever is in a bucket with others is in a star; all other texts are read no more.
        nodes = stars.select("doc_id").unionByName(stars.select(F.col("centre").alias("doc_id"))).distinct()
        texts = stored(docs.join(nodes.hint("merge"), "doc_id", "left_semi"), "texts")
        links = stored(confirm(stars, texts, size, percent), "links")
        found = stored(components(links), "components")

        # Whoever finds a link to the main component asks the others no more, so those who do are few.
        settled = False
        for every in [*[False] * MAIN_ROUNDS, True]:
            if settled and not every:
                continue
            asked = stored(rest(members, found, marked, percent, every, settled), "asked")
            settled = asked.isEmpty()
            if not settled:
                others = stored(meet_components(asked, found, texts, size, percent, bands, rows), "links")
                settled = others.isEmpty()
                if not settled:
                    links = links.unionByName(others)
                    found = stored(components(links), "components")

        of_copies = copies.groupBy("doc_id").agg(F.min("class").alias("class"))
        out = marked.select("doc_id", F.col("n").alias("n_shingles")).join(of_copies, "doc_id", "left")
        out = out.withColumn("node", F.coalesce("class", "doc_id")).join(found, "node", "left")
        component = F.coalesce("component", "node").alias("component_id")
        out = out.select("doc_id", "n_shingles", component)
        return keep(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near-duplicates")


def may_be_similar(size: int, bins: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the other sets can have that share in common, by their sizes and the bytes of their bins."""
    small, large = np.minimum(size, sizes), np.maximum(size, sizes)
    share = percent / 100
    # Five deviations below the share; a set of few shingles fills few bins by itself.
    least = share - 5 * np.sqrt(share * (1 - share) / np.minimum(bins.shape[0], np.maximum(small, 1)))
    possible = 100 * small >= percent * large
    at = np.flatnonzero(possible)
    possible[at] = (others[at] == bins).mean(axis=1) >= least[at]
    return possible


def rest(
    members: DataFrame, found: DataFrame, marked: DataFrame, percent: int, every: bool, settled: bool
) -> DataFrame:
    """``component, doc_id``: members outside their bucket's main component, and the other components they may belong to.

    The main component has the most members of the bucket. It alone is asked, or ``every`` one; the main one is left out
    where all questions to it are ``settled``. Members of one bucket are looked at in blocks, by their numbers of
    shingles and their bins.
    """
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = stored(placed.withColumn("own", F.coalesce("component", "doc_id")).drop("component"), "buckets")
    parts = placed.groupBy("key", "own").agg(F.count("*").alias("size"))
    parts = parts.groupBy("key").agg(F.min(F.struct(-F.col("size"), "own")).own.alias("main"), F.count("*").alias("parts"))
    placed = placed.join(parts.filter("parts > 1").select("key", "main"), "key")
    placed = placed.join(marked.select("doc_id", "n", "bins"), ["doc_id", "n"])
    placed = stored(placed.select("key", "doc_id", "n", "own", "main", "bins"), "buckets")
    apart = placed.filter("own <> main")
    if not every:
        placed = placed.filter("own = main")
    elif settled:
        placed = apart
    together = meet_in_blocks(apart, placed, "key", F.col("doc_id"), F.col("doc_id"), REST_BLOCK, REST_BLOCK)

    def compare(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        kinds, ids, sizes, own, main = (rows.column(c).to_numpy() for c in ("kind", "doc_id", "n", "own", "main"))
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        split = int((kinds == 0).sum())
        theirs = slice(split, None)
        pairs = set()
        for k in range(split):
            # Of two members outside the main component, the smaller asks.
            other = (own[theirs] != own[k]) & ((own[theirs] == main[theirs]) | (ids[k] < ids[theirs]))
            there = split + np.flatnonzero(other)
            there = there[may_be_similar(sizes[k], bins[k], sizes[there], bins[there], percent)]
            pairs.update((component, ids[k]) for component in np.unique(own[there]))
        return tuple(np.array(sorted(pairs), np.int64).reshape(-1, 2).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["key", "q", "v"]):
            a, b = compare(rows)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["component", "doc_id"])

    return together.mapInArrow(run, "component long, doc_id long").distinct()


def meet_components(
    asked: DataFrame, found: DataFrame, docs: DataFrame, size: int, percent: int, bands: int, rows: int
) -> DataFrame:
    """``centre, doc_id``: a confirmed link of each asking document with each block of a component that has one."""
    single = asked.select("component", F.col("component").alias("doc_id")).distinct()
    others = found.join(single.select("component"), "component").select("component", F.col("node").alias("doc_id"))
    others = others.unionByName(single).distinct()
    together = meet_in_blocks(
        asked.join(docs, "doc_id").select("component", "doc_id", "text"),
        others.join(docs, "doc_id").select("component", "doc_id", "text"),
        "component", F.col("doc_id"), F.col("doc_id"), TEXT_BLOCK, TEXT_BLOCK,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["component", "q", "v"]):
            split = int((group.column("kind").to_numpy() == 0).sum())
            ids, sets = group.column("doc_id").to_numpy(), text_sets(group, size)
            sizes = np.array([len(s) for s in sets])
            bins = sketch(sets, bands, rows)[1]
            links = []
            for k in range(split):
                there = may_be_similar(sizes[k], bins[k], sizes[split:], bins[split:], percent)
                for j in split + np.flatnonzero(there):
                    if similar(sets[k], sets[j], percent):
                        links.append((ids[k], ids[j]))
                        break
            if links:
                a, b = (pa.array(x, pa.int64()) for x in zip(*links))
                yield pa.RecordBatch.from_arrays([a, b], ["centre", "doc_id"])

    return together.mapInArrow(run, "centre long, doc_id long")
