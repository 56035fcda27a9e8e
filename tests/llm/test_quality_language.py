import numpy as np
import pytest
from pyspark.sql import functions as F

from logframe.llm import queries
from logframe.llm.language import fit_language, predict_language
from logframe.llm.quality import fit_quality, score_quality
from logframe.llm.sample import labelled_sample

from .conftest import frame


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = queries.op4_quality(spark, sf_dir)
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r.quality == k] for k in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.4
    # The area under the curve.
    assert np.mean([[g.score > b.score for b in bad] for g in good]) > 0.97
    assert scored.count() == 1000 and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (8, 1), (9, None), (None, 1), (77, 0), (1, 1)], "doc_id long, label int")
    model = fit_quality(edges.select("doc_id", "text"), labels)
    scored = score_quality(edges, model).collect()
    assert len(scored) == edges.count() and scored[0].row == "own row"
    assert all(0 <= r.score <= 1 for r in scored)
    assert score_quality(nothing, model).count() == 0
    for rows, share in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = fit_quality(edges.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, label int"))
        assert {round(r.score, 6) for r in score_quality(edges, model).collect()} == {share}


def test_sample_is_bounded_and_seeded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), 50).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 19_990, "many").otherwise("few").alias("label"))
    rows = labelled_sample(docs, labels, 100, 20, 1).collect()
    again = labelled_sample(docs.repartition(7), labels.repartition(5), 100, 20, 1).collect()
    assert sorted(rows) == sorted(again)
    assert sorted(r.label for r in rows) == ["few"] * 10 + ["many"] * 100
    assert {len(r.text) for r in rows} == {20}


def test_held_out_language(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_language_edges(spark, edges, nothing):
    rows = [(k, f"the cat and the dog {k}", "en") for k in range(30)] + [(100 + k, f"der Hund und die Katze {k}", "de") for k in range(30)]
    rows += [(200, "12 34", "xx"), (201, None, "yy"), (202, "what", None), (None, "le chat", "fr")]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    found = {(r.doc_id, r.lang_pred) for r in predict_language(edges.select("doc_id", "text"), model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "und")} <= found and {p for _, p in found} <= {"und", "de", "en"}
    told = predict_language(frame(spark, [(1, "THE DOG AND THE CAT"), (2, "die Katze"), (3, "1 2 3 !")]).select("doc_id", "text"), model)
    assert {r.doc_id: r.lang_pred for r in told.collect()} == {1: "en", 2: "de", 3: "und"}
    assert predict_language(nothing.select("doc_id", "text"), model).count() == 0
    untaught = fit_language(nothing.select("doc_id", "text", "lang"))
    assert {(r.lang_pred, r.score) for r in predict_language(edges.select("doc_id", "text"), untaught).collect()} == {("und", 0.0)}


def test_long_texts_of_each_language(spark):
    """All documents of a language as one text: far more different n-grams than any text that was learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language(docs.filter("doc_id % 2 = 0"), per_language=100)
    other = docs.filter("doc_id % 2 = 1 AND lang IS NOT NULL AND text IS NOT NULL")
    long = other.groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    long = long.select(F.xxhash64("lang").alias("doc_id"), "lang", "text")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(long.select("doc_id", "text"), model).collect()}
    for r in long.collect():
        assert got[r.doc_id][0] == r.lang and got[r.doc_id][1] > 0.6, (r.lang, len(r.text), got[r.doc_id])
