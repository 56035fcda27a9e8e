import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import ngrams
from logframe.llm.eliasfano import EliasFano
from logframe.llm.ngrams import packed, score_texts, unpacked
from logframe.llm.queries import op2_ngram_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_force(rows):
    """Tokens, known tokens, base score and exact score of each row ``text, train``."""
    texts = [[*WORD.findall((t or "").translate(LOWER)), None] for t, _ in rows]
    counts, pairs, context, after = Counter(), Counter(), Counter(), Counter()
    for words, (_, train) in zip(texts, rows):
        if train:
            counts.update(words)
            pairs.update(zip([0, *words], words))
    for (a, _), n in pairs.items():
        context[a] += n
        after[a] += 1
    total, distinct = sum(counts.values()), len(counts)
    times = Counter(pairs.values())
    discount = times[1] / (times[1] + 2 * times[2]) if times[1] and times[2] else 0.75
    out = []
    for words in texts:
        base = [(counts[w] + 1) / (total + distinct + 1) for w in words]
        score = 0.0
        for a, w, p in zip([0, *words], words, base):
            n = context[a]
            score += math.log10((max(pairs[a, w] - discount, 0) + discount * after[a] * p) / n if n else p)
        out.append((len(words), sum(counts[w] > 0 for w in words), total, sum(map(math.log10, base)), score))
    return out


def check(docs):
    rows = docs.collect()
    got = sorted(score_texts(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    wanted = sorted(zip(rows, brute_force([(r.text, r.train) for r in rows])), key=lambda w: (str(w[0].doc_id), w[1][0]))
    assert len(got) == len(wanted)
    for r, (row, w) in zip(got, wanted):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (row.doc_id, *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        # Logarithms are rounded to 256 values, over 7 powers of ten or so.
        assert abs(r.score - w[4]) <= 0.03 * r.n_tokens + 1e-9


@pytest.mark.parametrize("shard_tokens", [4_000_000, 3_000])
def test_documents(documents, monkeypatch, shard_tokens):
    """Also with many shards, so that pairs are asked of one shard and contexts of another."""
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 20_000)
    check(documents.withColumn("train", F.col("doc_id") % 7 != 2))


def test_chunks_of_a_shard_are_searched_together(documents, monkeypatch):
    """However many chunks ask a shard, its level is searched once for so many pairs; with the same sums."""
    docs = documents.withColumn("train", F.col("doc_id") % 7 != 2).select("doc_id", "text", "train")
    corpus = ngrams.frequent(docs.filter("train"))
    corpus.shards = 1
    tries = ngrams.build_tries(ngrams.count_pairs(docs.filter("train"), corpus), corpus)
    asked = ngrams.ask(docs.repartition(6), corpus).filter(F.col("kind") == ngrams.ASK)
    batches = [*tries.toArrow().to_batches(), *asked.toArrow().to_batches()]
    searches = []
    own = ngrams.Trie.look_up
    monkeypatch.setattr(ngrams.Trie, "look_up", lambda self, *args: searches.append(len(args[2])) or own(self, *args))

    def found():
        searches.clear()
        rows = [row for batch in ngrams.search(iter(batches), corpus) for row in batch.to_pylist()]
        return {r["chunk"]: unpacked(r["blob"]) for r in rows if r["kind"] == ngrams.PART}, len(searches)

    together, once = found()
    monkeypatch.setattr(ngrams, "ASKED_PAIRS", 1)
    one_by_one, often = found()
    assert (once, often) == (1, 6) and together.keys() == one_by_one.keys() and len(together) == 6
    for chunk, arrays in together.items():
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(arrays, one_by_one[chunk]))


def test_edges(edges, nothing):
    check(edges.withColumn("train", F.col("doc_id") % 2 == 0))
    check(edges.withColumn("train", F.lit(False)))
    assert score_texts(nothing.withColumn("train", F.lit(True))).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    cases = [[], [0], [2**64 - 1], [5, 5, 5, 2**63], range(200_000), np.sort(rng.integers(0, 2**62, 150_000))]
    for values in cases:
        values = np.array(list(values), np.uint64)
        sequence = EliasFano(EliasFano.encode(values))
        blocks = [sequence.block(k) for k in range(len(sequence.begins))]
        assert np.array_equal(np.concatenate([*blocks, np.zeros(0, np.uint64)]), values)
        if len(values):
            asked = np.concatenate([values[::3], values[:5] + np.uint64(1)])
            places = sequence.find(asked)
            there = np.isin(asked, values)
            assert (there == (places >= 0)).all() and (values[places[there]] == asked[there]).all()
    assert sum(a.nbytes for a in EliasFano.encode(np.arange(0, 10**7, 100, dtype=np.uint64))) < 130_000


def test_packed():
    arrays = [np.arange(7, dtype=np.uint32), np.zeros(0), np.array([1.5, -2.0]), np.array([3], np.uint64)]
    for a, b in zip(arrays, unpacked(packed(arrays))):
        assert a.dtype == b.dtype and np.array_equal(a, b)


def brute_force_of_triples(rows):
    """Exact scores of each row ``text, train`` by the words before, two of them."""
    texts = [[*WORD.findall((t or "").translate(LOWER)), None] for t, _ in rows]
    counted = [Counter() for _ in range(3)]
    grams = [[(a, b, c) for a, b, c in zip([0, 0, *words], [0, *words], words)] for words in texts]
    for own, (_, train) in zip(grams, rows):
        if train:
            for n in range(3):
                counted[n].update(gram[2 - n :] for gram in own)
    total, distinct = counted[0].total(), len(counted[0])
    discounts, contexts = [], []
    for grams_n in counted:
        times = Counter(grams_n.values())
        discounts.append(times[1] / (times[1] + 2 * times[2]) if times[1] and times[2] else 0.75)
        sums, after = Counter(), Counter()
        for gram, n in grams_n.items():
            sums[gram[:-1]] += n
            after[gram[:-1]] += 1
        contexts.append((sums, after))

    def probability(gram):
        p = (counted[0][gram[2:]] + 1) / (total + distinct + 1)
        for n in (1, 2):
            own, (sums, after) = gram[2 - n :], contexts[n]
            if sums[own[:-1]]:
                p = (max(counted[n][own] - discounts[n], 0) + discounts[n] * after[own[:-1]] * p) / sums[own[:-1]]
        return p

    return [sum(math.log10(probability(gram)) for gram in own) for own in grams]


def check_triples(docs):
    rows = docs.collect()
    got = sorted(score_texts(docs, order=3).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    marked = [(r.text, r.train) for r in rows]
    wanted = zip((str(r.doc_id) for r in rows), brute_force(marked), brute_force_of_triples(marked))
    wanted = sorted(((i, *w[:4], score) for i, w, score in wanted), key=lambda w: (w[0], w[1], w[5]))
    assert len(got) == len(wanted)
    for r, w in zip(got, wanted):
        assert (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert abs(r.score - w[5]) <= 0.03 * r.n_tokens + 1e-9
    return got


@pytest.mark.parametrize("shard_tokens", [4_000_000, 3_000])
def test_triples(documents, monkeypatch, shard_tokens):
    """The context of a word is two words; pairs, contexts of pairs and triples may all lie in other shards."""
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(ngrams, "CHUNK_TOKENS", 20_000)
    check_triples(documents.withColumn("train", F.col("doc_id") % 7 != 2))


def test_edges_of_triples(edges, nothing, monkeypatch):
    check_triples(edges.withColumn("train", F.col("doc_id") % 2 == 0))
    check_triples(edges.withColumn("train", F.lit(False)))
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 50_000)
    check_triples(edges.withColumn("train", F.lit(True)))
    assert score_texts(nothing.withColumn("train", F.lit(True)), order=3).count() == 0
    with pytest.raises(ValueError):
        score_texts(nothing, order=4)


def test_op2_is_of_triples(spark, tmp_path):
    """Two words before tell what one does not."""
    texts = ["a b c" if k % 2 else "x b d" for k in range(400)] + ["a b d", "a b c"] * 50
    docs = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held_out = op2_ngram_trie(spark, str(tmp_path)).filter("held_out AND doc_id >= 400").collect()
    often, seldom = ({round(r.score, 6) for r in held_out if r.doc_id % 2 == k} for k in (1, 0))
    assert len(often) == len(seldom) == 1 and often.pop() - seldom.pop() > 0.5
