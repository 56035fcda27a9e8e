import json
import random
import sys
import time
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import logframe as lf
from logframe.operators.dictionary import drop_old_versions
from logframe.operators.normalize import late_replacer
from logframe.session import SHUFFLE_CLEANUP, checkpoint_root, materialize

# The package has a function of the module's name.
normalizing = sys.modules[late_replacer.__module__]

MESSAGES = [
    "Password rejected for carol from 10.1.1.9",
    "Session granted for dave at 7",
    "Connection to db-main closed by peer",
    "authentication: Failed!",
    "Password rejected for dave, again",
]
TOKENS = [
    "TK0002 TK0005 for TK0006 from 10.1.1.9",
    "TK0007 TK0008 for TK0009 at 7",
    "TK0004 to TK0010 TK0011 by TK0012",
    "TK0013 TK0001",
    "TK0002 TK0005 for TK0009 TK0014",
]
WORDS = [
    "password rejected for carol from 10.1.1.9",
    "session granted for dave at 7",
    "connection to db-main closed by peer",
    "authentication: failed",
    "password rejected for dave again",
]


def frame_of(spark, messages, partitions=4):
    rows = [(i, m) for i, m in enumerate(messages)]
    random.Random(7).shuffle(rows)
    return spark.createDataFrame(rows, "seq bigint, message string").repartition(partitions)


@pytest.mark.parametrize("head", [{}, {"head_entries": 3, "head_word_chars": 6}])
def test_known_messages(spark, head):
    """Also with most of the dictionary beyond the broadcast head."""
    tokens, dictionary = lf.normalize(frame_of(spark, MESSAGES), order_by=["seq"], **head)
    assert [r.message for r in tokens.orderBy("seq").collect()] == TOKENS
    assert (dictionary.size(), dictionary.counter) == (14, 15)
    words = lf.expand_messages(tokens, dictionary, key=["seq"], **head).orderBy("seq").collect()
    assert [r.message for r in words] == WORDS


@pytest.mark.parametrize("head", [{}, {"head_entries": 5, "head_word_chars": 8}])
def test_many_messages(spark, head):
    """Words w0, w1, ... in order, so that message i has the tokens from 5 + 3i on; every third message ends alike."""
    messages = [f"W{3 * i} the w{3 * i + 1} {i}, w{3 * i + 2}" for i in range(300)] + [None, "", " \t", "!!!"]
    tokens = [f"TK{5 + 3 * i:04d} the TK{6 + 3 * i:04d} {i} TK{7 + 3 * i:04d}" for i in range(300)] + ["", "", "", ""]
    messages += ["averyveryverylongword : Failed 1.5"] * 150
    tokens += ["TK0905 TK0906 TK0001 1.5"] * 150
    records = frame_of(spark, messages).withColumn("other", F.struct(F.col("seq").alias("x")))
    got, dictionary = lf.normalize(records, order_by=["seq"], **head)
    rows = got.orderBy("seq").collect()
    assert got.columns == ["seq", "message", "other"]
    assert [r.message for r in rows] == tokens
    assert [r.other.x for r in rows] == list(range(len(messages)))
    assert dictionary.counter == 907
    expanded = lf.expand_messages(got, dictionary, key=["seq"], **head).orderBy("seq").collect()
    assert expanded[7].message == "w21 the w22 7 w23" and expanded[-1].message == "averyveryverylongword : failed 1.5"


def test_what_is_kept_is_smaller_than_the_texts(spark):
    """Of texts whose words are beyond the head, and of the dictionary."""
    messages = [" ".join(f"word{(n * k) % 700}" for k in range(1, 200)) for n in range(1, 1500)]
    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = {f for f in root.rglob("*") if f.is_file()}
    tokens, dictionary = lf.normalize(frame_of(spark, messages), order_by=["seq"], head_entries=2)
    expanded = lf.expand_messages(tokens, dictionary, key=["seq"], head_entries=2)
    assert [r.message for r in expanded.orderBy("seq").collect()] == messages
    kept = sum(f.stat().st_size for f in root.rglob("*") if f.is_file() and f not in before)
    assert kept < sum(map(len, messages))


def shuffle_folder(spark):
    """Of a local session: where its block manager has its files."""
    return Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())


def test_shuffles_of_what_is_kept_are_deleted(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    frame = spark.range(1000).repartition(3, "id").withColumn("other", F.col("id") + 1)
    shuffles = lambda: {f for f in shuffle_folder(spark).rglob("shuffle_*")}
    there = shuffles()
    kept = materialize(frame)
    for _ in range(50):
        if not (left := shuffles() - there):
            break
        time.sleep(0.1)
    assert not left and kept.count() == frame.count() == 1000 and spark.conf.get(SHUFFLE_CLEANUP, None) == before


@pytest.mark.parametrize("words, size", [(1, 1 << 24), (100_000, 1), (100_000, 1 << 24)])
def test_chunks_of_records(spark, monkeypatch, words, size):
    """Records are the same however they are cut; a key may repeat, and a record without a whole key keeps its words."""
    monkeypatch.setattr(normalizing, "CHUNK_WORDS", words)
    monkeypatch.setattr(normalizing, "CHUNK_BYTES", size)
    rows = [(None if n % 50 == 3 else n // 2, f"aa w{n % 90} {'x' * (n % 7)} the", [n]) for n in range(1200)]
    frame = spark.createDataFrame(rows, "seq bigint, message string, other array<int>").repartition(3)
    entries = [("aa", "TK0001", 1), *((f"w{n}", f"TK{n + 2:04d}", n + 2) for n in range(80))]
    dictionary = lf.Dictionary(spark.createDataFrame(entries, "word string, token string, token_no bigint"), 90)
    got = lf.normalize_messages(frame, dictionary, key=["seq"], head_entries=1)
    assert got.dtypes == frame.dtypes
    for row in got.collect():
        seq, message, _ = rows[row.other[0]]
        wanted = [f"TK{int(w[1:]) + 2:04d}" if seq is not None and w[0] == "w" and int(w[1:]) < 80 else w for w in message.split()[1:]]
        assert (row.seq, row.message) == (seq, " ".join(["TK0001", *wanted]))
    assert got.count() == 1200


def test_numbers_do_not_depend_on_partitions(spark):
    messages = [f"alpha{i % 37} beta{i} gamma" for i in range(200)]
    found = []
    for partitions in (1, 7):
        dictionary = lf.build_dictionary(frame_of(spark, messages, partitions), order_by=["seq"])
        found.append(sorted(map(tuple, dictionary.entries.collect())))
    assert found[0] == found[1]


def test_order_by_several_columns(spark):
    rows = [("b", 0, "second"), ("a", 1, "first"), ("a", 0, "zero")]
    records = spark.createDataFrame(rows, "file string, line int, message string")
    dictionary = lf.build_dictionary(records, order_by=["file", "line"], dictionary=lf.clear_dictionary(spark))
    assert [r.word for r in dictionary.entries.orderBy("token_no").collect()] == ["zero", "first", "second"]


def test_line_order(spark, tmp_path):
    """File, block, line and piece, in this order; a word's first record is not its first row."""
    rows = [("/b", 0, 5, 0, "late"), ("/a", 64, 1, 0, "third two"), ("/a", 0, 9, 1, "two"), ("/a", 0, 9, 0, "one"), ("/a", 0, -1, 0, "zero")]
    records = spark.createDataFrame(rows, "file_path string, block_start bigint, line_id bigint, part int, message string")
    built = lf.build_dictionary(records, dictionary=lf.clear_dictionary(spark))
    words = [r.word for r in built.entries.orderBy("token_no").collect()]
    assert words == ["zero", "one", "two", "third", "late"]


def test_second_build_goes_on(spark):
    first = lf.build_dictionary(frame_of(spark, ["one two"]), order_by=["seq"])
    second = lf.build_dictionary(frame_of(spark, ["two three"]), order_by=["seq"], dictionary=first)
    assert {r.word: r.token for r in second.entries.filter("token_no > 4").collect()} == {
        "one": "TK0005", "two": "TK0006", "three": "TK0007"}


def test_long_numbers_are_not_cut(spark):
    empty = lf.clear_dictionary(spark)
    late = lf.build_dictionary(frame_of(spark, ["x"]), order_by=["seq"], dictionary=lf.Dictionary(empty.entries, 10000))
    assert late.entries.first().token == "TK10000"


def test_save_and_load(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    missing = lf.load_dictionary(spark, path)
    assert (missing.size(), missing.counter) == (0, 1)
    built = lf.build_dictionary(frame_of(spark, MESSAGES), order_by=["seq"])
    lf.save_dictionary(built, path)
    loaded = lf.load_dictionary(spark, path)
    assert (loaded.size(), loaded.counter) == (14, 15)
    # Saving to where it was loaded from.
    more = lf.build_dictionary(frame_of(spark, ["brandnew"]), order_by=["seq"], dictionary=loaded)
    lf.save_dictionary(more, path)
    assert lf.load_dictionary(spark, path).entries.filter("word = 'brandnew'").first().token == "TK0015"
    lf.save_dictionary(lf.clear_dictionary(spark), path)
    cleared = lf.load_dictionary(spark, path)
    assert (cleared.size(), cleared.counter) == (0, 1)


def test_torn_save_is_no_version(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    built = lf.build_dictionary(frame_of(spark, MESSAGES), order_by=["seq"])
    lf.save_dictionary(built, path)
    # A save that broke off has written entries, but not its version.
    built.entries.limit(3).write.parquet(f"{path}/entries/2")
    loaded = lf.load_dictionary(spark, path)
    assert (loaded.size(), loaded.counter) == (14, 15)
    lf.save_dictionary(loaded, path)
    lf.save_dictionary(loaded, path)
    drop_old_versions(spark, path)
    assert sorted(p.name for p in (tmp_path / "dictionary" / "entries").iterdir()) == ["3"]
    assert lf.load_dictionary(spark, path).size() == 14


def test_repeated_words_of_a_text(spark, tmp_path):
    path = tmp_path / "twice.json"
    path.write_text('{"counter": 5, "word_to_token": {"bb": "TK0001", "aa": "TK0003", "bb": "TK0002"}}')
    loaded = lf.import_dictionary(spark, str(path))
    assert {r.word: r.token for r in loaded.entries.collect()} == {"aa": "TK0003", "bb": "TK0002"}
    tokens = lf.normalize_messages(frame_of(spark, ["aa bb cc"]), loaded, key=["seq"])
    assert tokens.first().message == "TK0003 TK0002 cc"


def test_import(spark, tmp_path):
    good, bad, bare = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "bare.json"
    good.write_text(json.dumps({"counter": 9, "word_to_token": {"b": "TK0002", "A": "TK0001", "c": "TK0002"}}, indent=4))
    bad.write_text("{broken")
    bare.write_text('{"word_to_token": {"x": "TK0001"}}')
    loaded = lf.import_dictionary(spark, str(good))
    assert (loaded.size(), loaded.counter) == (3, 9)
    tokens = spark.createDataFrame([(1, "TK0001  TK0002 tk0001 TK0404"), (2, None)], "seq int, message string")
    expanded = lf.expand_messages(tokens, loaded, key=["seq"]).orderBy("seq").collect()
    assert [r.message for r in expanded] == ["A c tk0001 TK0404", None]
    words = spark.createDataFrame([("a",), ("A",), ("b",)], "word string")
    assert {r.word for r in lf.contains_words(words, loaded).collect()} == {"A", "b"}
    assert lf.import_dictionary(spark, str(bare)).counter == 1
    for path in (bad, tmp_path / "absent.json"):
        empty = lf.import_dictionary(spark, str(path))
        assert (empty.size(), empty.counter) == (0, 1)


def test_a_batch_is_rewritten_in_slices():
    class Known:
        value = {"known": "TK0001"}

    rows, words = 20_000, 40
    text = " ".join(f"word{n}" for n in range(words)) + "  known"
    pairs = [{"from": f"word{n}", "to": f"TK{n:06d}"} for n in range(words)]
    kind = pa.list_(pa.struct([("from", pa.string()), ("to", pa.string())]))
    late = pa.concat_arrays([pa.array([pairs] * 1000, kind)] * (rows // 1000 - 1) + [pa.array([None] * 1000, kind)])
    texts = pa.array([text] * (rows - 1) + [None])
    tracemalloc.start()
    found = late_replacer(Known).func(texts, late)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].as_py() == " ".join(pair["to"] for pair in pairs) + " TK0001"
    assert found[rows - 2].as_py() == text.replace("  known", " TK0001") and found[rows - 1].as_py() is None
    # All pairs as Python's own objects would be more than 200 MB.
    assert peak < 20e6
