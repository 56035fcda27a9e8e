import csv
import json
import shutil

from pyspark.sql import functions as F, types as T

import logframe as lf

ROWS = [
    ("2026-08-03 12:00:00", "HIGH", 'He said "no", twice'),
    ("2026-08-03 12:01:00", None, "  spaces \\ and \\\" kept  "),
    ("2026-08-03 12:02:00", "", "line\nbreak\rand , comma"),
    (None, "LOW", ""),
]
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "severity", "message")])


def test_json(spark, tmp_path):
    path = str(tmp_path / "out" / "json")
    assert lf.read_json(spark, path, SCHEMA).count() == 0
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert lf.write_json(frame, path) == path
    lf.write_json(frame, path)
    assert sorted(map(str, lf.read_json(spark, path, SCHEMA).collect())) == sorted(map(str, frame.collect()))
    written = [json.loads(line) for f in tmp_path.glob("out/json/part-*") for line in f.read_text().splitlines()]
    assert all(set(row) == set(SCHEMA.names) for row in written)
    lf.clear_json(spark, path, SCHEMA)
    assert lf.read_json(spark, path, SCHEMA).count() == 0


def test_json_array_file(spark, tmp_path):
    path = tmp_path / "logs.json"
    path.write_text(json.dumps([dict(zip(SCHEMA.names, row)) for row in ROWS], indent=4))
    got = lf.read_json(spark, str(path), SCHEMA, array_file=True).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, ROWS))


def test_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    assert lf.read_csv(spark, path, SCHEMA.names).count() == 0
    lf.write_csv(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path)
    with open(next(tmp_path.glob("csv/part-*")), newline="") as file:
        by_python = list(csv.DictReader(file))
    wanted = [{k: v or "" for k, v in zip(SCHEMA.names, row)} for row in ROWS]
    assert list(by_python[0]) == ["message", "severity", "timestamp"]
    assert by_python == wanted
    got = lf.read_csv(spark, path, SCHEMA.names, multi_line=True)
    assert [r.asDict() for r in got.collect()] == wanted
    lf.clear_csv(spark, path, SCHEMA)
    assert lf.read_csv(spark, path, SCHEMA.names).count() == 0


def test_records_by_csv(spark, tmp_path):
    lines = spark.createDataFrame([("t h sudo: a \"b\" 'c', d",), ("t h x[1]: for u port 5",)], "line string")
    records = lf.parse_auth(lines).drop("part")
    path = lf.write_csv(records, str(tmp_path / "records"))
    got = lf.read_csv(spark, path).collect()
    assert {r.message for r in got} == {"a \"b\" 'c', d", "for u port 5"}
    assert {(r.pid, r.port) for r in got} == {("", ""), ("1", "5")}


def test_keyed_table(spark, tmp_path):
    table = lf.KeyedTable(spark, str(tmp_path / "keyed"))
    assert (table.count(), table.last_id()) == (0, 0)
    frame = spark.createDataFrame([(3, "c", None), (1, "a", 2.5), (2, "b", 1.0)], "k int, s string, x double")
    table.append(frame, order_by=["k"])
    table.append(frame.repartition(5))
    rows = table.read().orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [json.loads(r.data)["s"] for r in rows[:3]] == ["a", "b", "c"]
    assert json.loads(rows[2].data) == {"k": 3, "s": "c", "x": None}
    table.clear()
    assert table.count() == 0
    table.append(frame, order_by=["k"])
    assert [r.id for r in table.read().orderBy("id").collect()] == [7, 8, 9]
    assert table.count() == 3


def test_an_ordered_append_makes_its_records_once(spark, tmp_path):
    """And counting reads the log alone."""
    calls = tmp_path / "calls"

    def noted(batches):
        with calls.open("a") as file:
            file.write("x")
        yield from batches

    table = lf.KeyedTable(spark, str(tmp_path / "keyed"))
    table.append(spark.range(0, 100, 1, 3).mapInArrow(noted, "id long"), order_by=["id"])
    assert calls.read_text() == "xxx"
    assert [r.id for r in table.read().orderBy("id").collect()] == list(range(1, 101))
    shutil.rmtree(table.rows_path)
    assert table.count() == 100


def test_broken_append_and_clear(spark, tmp_path):
    table = lf.KeyedTable(spark, str(tmp_path / "keyed"))
    frame = spark.range(5).withColumnRenamed("id", "k")
    table.append(frame, order_by=["k"])
    # Rows without their log: an append that broke off. A clearing that broke off has left its rows.
    frame.selectExpr("0 part", "k place", "'torn' data").write.parquet(f"{table.rows_path}/2")
    assert table.count() == 5
    table.append(frame, order_by=["k"])
    assert [r.id for r in table.read().orderBy("id").collect()] == list(range(1, 11))
    assert {json.loads(r.data)["k"] for r in table.read().collect()} == set(range(5))
    shutil.copytree(table.rows_path, tmp_path / "left")
    table.clear()
    shutil.copytree(tmp_path / "left", table.rows_path)
    assert (table.count(), table.last_id()) == (0, 10)
    table.clear()
    table.append(frame)
    assert sorted(r.id for r in table.read().collect()) == list(range(11, 16))


def test_numbers_with_one_frequent_value(spark):
    frame = spark.range(0, 5000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    numbered = lf.number_rows(frame, "n", order_by=["key"], start=10).orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(10, 5010))
    assert [r.key for r in numbered] == sorted(r.key for r in numbered)
    assert len({r.id for r in numbered}) == 5000
