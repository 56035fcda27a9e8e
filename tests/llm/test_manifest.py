import hashlib
import zlib

import pytest

from logframe.llm.manifest import FAN, Appender, audit, fold, leaf, manifest, node
from logframe.llm.queries import op12_merkle_manifest
from logframe.llm.store import stored

from .conftest import SF_DIR, frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return H(*[field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)])


def tree(digests):
    """The root, and for each leaf its place and siblings at each level."""
    proofs, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(k, min(k + 3, len(digests))) for k in range(0, len(digests), 3)]
        for run in runs:
            for j in run:
                for i in below[j]:
                    proofs[i].append((j - run[0], [digests[m] for m in run if m != j]))
        below = [sum((below[j] for j in run), []) for run in runs]
        digests = [H(*[digests[j] for j in run]) for run in runs]
    return digests[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = [tree([leaf_of(r, r.text) for r in groups[n]]) for n in names]
    root, top = tree([t[0] for t in trees])
    for name, (subroot, proofs), above in zip(names, trees, top):
        for r, proof in zip(groups[name], proofs):
            proof, text = proof + above, r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of(r, text)
            for j, siblings in proof:
                folded = H(*siblings[:j], folded, *siblings[j:])
            digest = H(*[s for _, siblings in proof for s in siblings])
            yield str((r.doc_id, leaf_of(r, r.text), subroot, root, digest, folded, folded == root))


def test_given_documents(spark, documents):
    got = op12_merkle_manifest(spark, SF_DIR).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(brute(documents.collect()))
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_blocks(spark, documents, levels):
    """Blocks of 3 or 9 leaves, so that roots of blocks are appended over several rounds."""
    docs = documents.limit(90).unionByName(frame(spark))
    docs = stored(docs, "docs")
    assert sorted(str(tuple(r)) for r in audit(docs, levels).collect()) == sorted(brute(docs.collect()))


def test_edges(spark, edges, nothing):
    assert sorted(str(tuple(r)) for r in audit(edges).collect()) == sorted(brute(edges.collect()))
    assert audit(nothing).count() == 0
    one = frame(spark, [(5, "a\nb")])
    assert sorted(str(tuple(r)) for r in audit(one).collect()) == sorted(brute(one.collect()))


def test_witnesses_give_the_root_back(spark):
    rows = frame(spark, [(k % 50, f"text {k}") for k in range(200)])
    leaves = stored(rows.select("doc_id", "source", leaf(rows.doc_id, rows.text).alias("leaf"), "text"), "leaves")
    for r in manifest(leaves, levels=3).collect():
        assert fold(bytes.fromhex(r.leaf), bytes(r.siblings), bytes(r.path)).hex() == r.root
        assert fold(bytes.fromhex(H("other")), bytes(r.siblings), bytes(r.path)).hex() != r.root


@pytest.mark.parametrize("n", range(1, FAN**3 + 1))
def test_appending(n):
    """One leaf more or less, in the same appender after a longer tree."""
    appender = Appender(3)
    for size in (FAN**3, n):
        appender.clear()
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(size)]
        for digest in leaves:
            appender.append(digest)
        root = appender.close()
    wanted, proofs = tree([d.hex() for d in leaves])
    assert root.hex() == wanted and node([root]) != root
    for digest, proof, (siblings, path) in zip(leaves, proofs, appender.witnesses(), strict=True):
        assert siblings.hex() == "".join(s for _, run in proof for s in run)
        assert path == bytes([FAN * place + len(run) for place, run in proof])
        assert fold(digest, siblings, path) == root
