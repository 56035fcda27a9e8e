import corpus_pipeline
from logframe.llm import queries
from pyspark.sql import functions as F

from .conftest import SF_DIR, frame


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF_DIR)
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert sums <= 4096 and packed.select("doc_id").distinct().count() < docs.count()


def test_each_stage_against_its_operator(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("score", F.lit("own")).withColumn("removed", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in out.collect()}
        if name == "near_dedup":
            kept = queries.op1_minhash(spark, SF_DIR).filter("kept").collect()
            assert ids == {r.doc_id for r in kept}
        elif name == "suffix_dedup":
            sizes = {r.doc_id: r.n_bytes - r.n_removed for r in queries.op6_suffix_array(spark, SF_DIR).collect()}
            assert all(len(r.text.encode()) <= sizes[r.doc_id] and len(r.text) == r.n_chars for r in out.collect())
        elif name == "quality":
            assert 0.7 * docs.count() < len(ids) < docs.count()


def test_edges(spark, edges, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edges, nothing):
            out = stage(spark, docs, SF_DIR)
            assert out.count() >= 0
            if name != "packing":
                assert out.columns == docs.columns
    assert len(corpus_pipeline.near_dedup(spark, frame(spark), SF_DIR).filter("doc_id IS NULL").collect()) == 2


def test_one_text_of_repeated_rows_stays(spark):
    """Equal rows with one id, or without one, lose all but one of them, and that one keeps its text in the next stage."""
    texts = [" ".join(f"{name}{k}" for k in range(60)) for name in ("same", "none", "both", "own")]
    rows = [(1, texts[0])] * 3 + [(None, texts[1])] * 2 + [(7, texts[2]), (7, texts[2]), (None, texts[2]), (9, texts[2]), (4, texts[3])]
    once = corpus_pipeline.near_dedup(spark, frame(spark, rows), SF_DIR)
    assert sorted(r.text for r in once.collect()) == sorted(texts)
    cut = corpus_pipeline.suffix_dedup(spark, once, SF_DIR)
    assert sorted(r.text for r in cut.collect()) == sorted(texts)
    packed = corpus_pipeline.packing(spark, cut, SF_DIR).collect()
    assert len({(r.doc_id, r.ids_crc32) for r in packed}) == 4
