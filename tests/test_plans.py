"""What the plans must and must not hold."""

import logframe as lf
from logframe.operators.dictionary import first_occurrences
from logframe.schema import DICTIONARY_SCHEMA, LINE_ORDER
from logframe.streaming.batches import BatchTable


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(1, "auth.log", "t h p: m")], "id int, filename string, line string").write.parquet(path)
    return spark.read.parquet(path)


def test_unused_fields_are_not_computed(spark, tmp_path):
    text = plan(lf.parse_auth(lines(spark, tmp_path)).select("severity"))
    assert "regexp_extract" not in text
    assert "id" not in text.split("ReadSchema:")[1]


def test_header_pattern_runs_once(spark, tmp_path):
    records = lf.parse_auth(lines(spark, tmp_path)).filter("hostname = 'h' and severity = 'INFO'")
    text = plan(records)
    assert text.count("regexp_replace(") == 1
    assert "Exchange" not in text and "Python" not in text


def test_all_formats_share_one_scan(spark, tmp_path):
    text = plan(lf.parse_all(lines(spark, tmp_path)))
    assert text.count("FileScan") == 1 and "Union" not in text
    # Three distinct patterns; auth, syslog and kern have the same.
    assert text.count("regexp_replace(") == 3


def test_typed_scan_lists_its_files_only(spark, tmp_path):
    for name in ("auth.log", "AUTH.1", "syslog", "kern.log"):
        (tmp_path / name).write_text("t h p: m\n")
    scan = lf.read_lines(spark, str(tmp_path), "auth")
    assert sorted(f.rsplit("/", 1)[1] for f in scan.inputFiles()) == ["AUTH.1", "auth.log"]


def test_counts_are_combined_before_they_are_spread(spark, tmp_path):
    text = plan(lf.summary_counts(lf.parse_auth(lines(spark, tmp_path))))
    assert "Expand" not in text and "partial_count" in text


def test_preview_does_not_sort_everything(spark, tmp_path):
    assert "TakeOrderedAndProject" in plan(lf.preview(lf.parse_auth(lines(spark, tmp_path)), 5, ["id"]))


def test_exchanges_of_normalising(spark, tmp_path):
    records = lines(spark, tmp_path).selectExpr("id", "line message", "filename")
    dictionary = lf.build_dictionary(records, order_by=["id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(lf.normalize_messages(records, dictionary, key=["id"], head_entries=2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text
    # Whole records by key; open words and the rest of the dictionary by word; what was found by key.
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line or "ReusedExchange" in line]
    by_key = [line for line in exchanges if "hashpartitioning(id" in line and "REPARTITION" in line]
    by_word = [line for line in exchanges if "hashpartitioning(from" in line]
    back = [line for line in exchanges if "hashpartitioning(id" in line and "ENSURE" in line]
    # The first exchange is planned for both branches and runs once.
    assert len(by_key) in (1, 2) and len(by_word) == 2 and len(back) == 1


def test_dictionary_of_lines_is_hash_aggregated(spark, tmp_path):
    schema = "file_path string, block_start bigint, line_id bigint, part int, message string"
    path = str(tmp_path / "records")
    spark.createDataFrame([("/a", 0, 0, 0, "some words")], schema).write.parquet(path)
    words, order = first_occurrences(spark.read.schema(schema).parquet(path), "message", LINE_ORDER)
    assert order == ["block", "packed"]
    assert "HashAggregate" in plan(words) and "SortAggregate" not in plan(words)


def test_normalising_and_expanding_share_a_worker(spark, tmp_path):
    records = lines(spark, tmp_path).selectExpr("id", "line message")
    dictionary = lf.build_dictionary(records, order_by=["id"])
    for head in ({}, {"head_entries": 2}):
        tokens = lf.normalize_messages(records, dictionary, key=["id"], **head)
        # One step of Python only: of two, each would hold workers of its own.
        assert plan(lf.expand_messages(tokens, dictionary, key=["id"])).count("ArrowEvalPython") == 1


def test_nothing_written_needs_no_python(spark, tmp_path):
    rows = BatchTable(spark, str(tmp_path), DICTIONARY_SCHEMA).read()
    assert rows.dtypes == [("word", "string"), ("token", "string"), ("token_no", "bigint"), ("batch", "bigint")]
    # A local list would be read by Python workers of its own, beside those of the batch.
    assert rows.count() == 0 and "ExistingRDD" not in plan(rows)
