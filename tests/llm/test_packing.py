import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logframe.llm.packing import WordEncoder, fill, pack_documents, piece_ids
from logframe.llm.queries import tokenizer


def token_ids(texts):
    read = Tokenizer.from_file(tokenizer())
    return [np.array([*e.ids, 2], "<u4") for e in read.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(docs, length=4096, segments=1024):
    rows = docs.select("doc_id", "text").collect()
    wanted = {}
    for r, ids in zip(rows, token_ids([r.text for r in rows])):
        wanted.setdefault(r.doc_id, []).append(ids)
    got = pack_documents(docs, tokenizer(), length=length, segments=segments).collect()
    sequences, covered = {}, {}
    for p in got:
        fits = [ids for ids in wanted[p.doc_id] if zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and len(ids) == p.doc_tokens]
        assert fits and 0 < p.length <= length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    assert covered == {i: sum(map(len, ids)) for i, ids in wanted.items()}
    for parts in sequences.values():
        assert len(parts) <= segments
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return got, sequences


def test_documents(spark):
    got, sequences = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(p.length for p in got) / (4096 * len(sequences)) > 0.98


def test_edges(edges, nothing):
    check(edges)
    check(edges, length=64, segments=2)
    assert pack_documents(nothing, tokenizer()).count() == 0


def test_limits_are_held_at_once():
    rng = np.random.default_rng(0)
    demands = np.stack([rng.integers(1, 50, 400), np.ones(400, int), rng.integers(0, 30, 400)], axis=1)
    demands[:, 2] = np.minimum(demands[:, 2], demands[:, 0])
    limits = np.array([100, 6, 60])
    bins, places = fill(demands, limits)
    for k in range(bins.max() + 1):
        own = bins == k
        assert own.any() and (demands[own].sum(axis=0) <= limits).all()
        assert sorted(places[own]) == list(range(own.sum()))
    least = (-(-demands.sum(axis=0) // limits)).max()
    assert bins.max() + 1 <= 1.1 * least + 2


def test_prompts_and_ids(spark):
    rows = [(k, " ".join(["ask"] * (k % 40)), " ".join(["answer"] * (k % 90 + 1))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    placed = pack_documents(docs, tokenizer(), prompt_column="prompt", length=256, loss=100)
    by = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss").alias("loss")).collect()
    assert all(r.n <= 256 and r.loss <= 100 for r in by)
    assert placed.agg(F.sum("loss")).first()[0] == sum(len(t.split()) + 1 for _, _, t in rows)
    ids = {(r.sequence_id, r.offset): r.ids for r in piece_ids(placed, docs, tokenizer(), prompt_column="prompt").collect()}
    for p in placed.collect():
        assert zlib.crc32(np.array(ids[p.sequence_id, p.offset], "<u4").tobytes()) == p.ids_crc32


def test_word_by_word_is_the_same(monkeypatch):
    texts = [None, "", "a~b ~ ~~ x~", "The  THE\tthe\n", "<|endoftext|>x <|startoftext|>", "\x1cq\x1dz", "Å Å 　中文 é́", "don't we'll 12345"]
    texts += ["The. THE, don't. I'S's. a.b.c A.B!? x,,y (Ab). Ab", "J\u030c W\u030a. I\u0307 H\u0331a Å. S\u0323A.é", "<|ENDOFTEXT|>. x<|endoftext|>.A A.<|x", "Z", "ZÀ", "Σ. ΑΣ, aΣ."]
    monkeypatch.setattr("logframe.llm.packing.CACHE_WORDS", 3)
    encoder = WordEncoder(tokenizer())
    for _ in range(3):
        for text in texts:
            assert [*encoder.encode([text])[0], 2] == token_ids([text])[0].tolist()
    assert encoder.letters_apart
    assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in token_ids(texts)]


def test_kinds_of_characters_are_words_of_their_own():
    """Fewer distinct words; each is encoded once. Capital letters before others than ASCII keep to the whole tokenizer."""
    encoder = WordEncoder(tokenizer())
    data, places, _ = encoder._words(np.frombuffer("Ab12,(cd's.'tw)".encode(), np.uint8), np.array([0, 15]))
    raw = data.tobytes().decode()
    assert [raw[a:b] for a, b in zip(places, places[1:])] == ["ab", "1", "2", ",(", "cd", "'s", ".'tw", ")"]
    rng = np.random.default_rng(5)
    signs = [*"aBsStrRvelLmMd''0159~.,;:!?-_=<>|()&\x1c \n", "é", "é", "İ", "ß", "̸", "Ⅷ", "٣", "中", " ", "K", "ſ", "Y íbo", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(5000)]
    for text, wanted, got in zip(texts, token_ids(texts), encoder.encode(texts)):
        assert list(wanted[:-1]) == got.tolist(), text
