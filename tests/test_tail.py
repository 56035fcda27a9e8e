import os
import time

import pytest

import logframe as lf
from logframe.streaming.tail import ByteRange, LogStore, TailReader, complete_end, plan_ranges, read_range


class Follower:
    def __init__(self, spark, tmp_path, pattern, **options):
        self.spark, self.tmp, self.pattern, self.options, self.runs = spark, tmp_path, pattern, options, 0

    def __call__(self):
        """The lines a fresh run of the stream brings, in order."""
        self.runs += 1
        output = str(self.tmp / f"out{self.runs}")
        stream = lf.tail_logs(self.spark, self.pattern, **self.options).writeStream.format("parquet")
        query = stream.option("checkpointLocation", str(self.tmp / "state")).trigger(availableNow=True).start(output)
        query.awaitTermination()
        if not [f for f in os.listdir(output) if f.endswith(".parquet")]:
            return []
        rows = self.spark.read.schema(lf.TAIL_SCHEMA).parquet(f"{output}/*.parquet")
        return [r.line for r in rows.orderBy("log_path", "segment", "byte_offset").collect()]


@pytest.fixture()
def log(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    return folder / "auth.log"


@pytest.mark.parametrize("identity", ["inode", "first_line"])
def test_read_append_rotate(spark, tmp_path, log, identity):
    follow = Follower(spark, tmp_path, str(log), identity=identity, rotated_names=r"[.-]\d+$")
    (log.parent / "auth.log.1").write_text("from before\n")
    log.write_text("one\ntwo\n")
    assert follow() == ["one", "two"]
    assert follow() == []
    with log.open("a") as file:
        file.write("three\nhal")
    assert follow() == ["three"]
    with log.open("a") as file:
        file.write("f\nfour\n")
    # Twice rotated before the next look; a compressed copy and a file of another name are no part of it.
    log.rename(log.parent / "auth.log.3")
    (log.parent / "auth.log.2").write_text("between\nunfinished")
    (log.parent / "auth.log.4.gz").write_bytes(b"zip\n")
    (log.parent / "auth.log.bak").write_text("copy\n")
    log.write_text("new \xe9\n")
    assert follow() == ["half", "four", "between", "unfinished", "new \xe9"]
    assert follow() == []


def test_emptied_file_is_read_anew(spark, tmp_path, log):
    follow = Follower(spark, tmp_path, str(log))
    log.write_text("a long first line\n")
    assert follow() == ["a long first line"]
    log.write_text("b\n")
    assert follow() == ["b"]


def test_many_logs_and_tasks_equal_batch(spark, tmp_path, log):
    wanted = []
    for host in ("a", "b"):
        folder = log.parent / host
        folder.mkdir()
        lines = [f"2026 {host} p[{i}]: message {i} " + "x" * (i % 50) for i in range(3000)]
        (folder / "auth.log").write_text("\n".join(lines) + "\n")
        wanted += lines
    follow = Follower(spark, tmp_path, f"file:{log.parent}/*/auth.log", split_bytes=5000)
    assert follow() == wanted
    batch = lf.parse_auth(lf.read_lines(spark, str(log.parent))).select("hostname", "pid", "message")
    stream = lf.parse_auth(spark.read.schema(lf.TAIL_SCHEMA).parquet(f"{tmp_path}/out1/*.parquet"))
    assert sorted(batch.collect()) == sorted(stream.select("hostname", "pid", "message").collect())


def test_stream_is_parsed_like_a_batch(spark, tmp_path, log):
    log.write_text("t h sshd[1]: Failed password for root from 1.1.1.1\njunk\n")
    records = lf.parse_auth(lf.tail_logs(spark, str(log))).select("event_type", "user")
    query = (
        records.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s"))
        .trigger(availableNow=True).start(str(tmp_path / "o"))
    )
    query.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("AUTH_FAILURE", "root")]


def test_replay_after_a_rename(log):
    log.write_text("one\ntwo\n")
    reader = TailReader({"path": str(log)})
    end = reader.latestOffset()
    log.rename(log.parent / "auth.log.1")
    log.write_text("other\n")
    parts = reader.partitions({}, end)
    assert [line for p in parts for b in reader.read(p) for line in b.column("line").to_pylist()] == ["one", "two"]
    (log.parent / "auth.log.1").unlink()
    with pytest.raises(FileNotFoundError, match="gone before"):
        list(reader.read(parts[0]))


def test_late_lines_of_a_rotated_file(log):
    log.write_text("one\n")
    reader = TailReader({"path": str(log)})
    first = reader.latestOffset()
    log.rename(log.parent / "auth.log.1")
    log.write_text("two\n")
    second = reader.latestOffset()
    with (log.parent / "auth.log.1").open("a") as file:
        file.write("late\n")
    third = reader.latestOffset()
    holds = reader.store.holds
    assert [(begin, f["end"]) for _, f, begin in plan_ranges(first, second, holds)] == [(0, 4)]
    late = [(os.path.basename(f["path"]), begin, f["end"]) for _, f, begin in plan_ranges(second, third, holds)]
    assert late == [("auth.log.1", 4, 9)]
    assert plan_ranges(third, third, holds) == []


@pytest.mark.parametrize("identity", ["inode", "first_line"])
def test_trigger_between_rename_and_create(spark, tmp_path, log, identity):
    follow = Follower(spark, tmp_path, str(log), identity=identity)
    log.write_text("one\n")
    assert follow() == ["one"]
    with log.open("a") as file:
        file.write("two\n")
    log.rename(log.parent / "auth.log.1")
    assert follow() == ["two"]
    log.write_text("three\n")
    assert follow() == ["three"]
    assert follow() == []


@pytest.mark.parametrize("identity", ["inode", "first_line"])
def test_trigger_with_an_empty_new_file(spark, tmp_path, log, identity):
    follow = Follower(spark, tmp_path, str(log), identity=identity)
    log.write_text("one\n")
    assert follow() == ["one"]
    with log.open("a") as file:
        file.write("two\n")
    log.rename(log.parent / "auth.log.1")
    log.write_text("")
    assert follow() == ["two"]
    log.write_text("three\n")
    assert follow() == ["three"]


def test_new_file_that_begins_like_the_old_one(spark, tmp_path, log):
    follow = Follower(spark, tmp_path, str(log), identity="first_line")
    log.write_text("header\nold1\n")
    assert follow() == ["header", "old1"]
    with log.open("a") as file:
        file.write("old2\n")
    log.rename(log.parent / "auth.log.1")
    log.write_text("header\nnew1\nnew2\n")
    assert follow() == ["old2", "header", "new1", "new2"]
    # Replaced in place, with more bytes than were read.
    log.write_text("header\nlast1\nlast2\nlast3\n")
    assert follow() == ["header", "last1", "last2", "last3"]


def test_rotated_under_any_name(spark, tmp_path, log):
    follow = Follower(spark, tmp_path, str(log))
    log.write_text("one\n")
    assert follow() == ["one"]
    with log.open("a") as file:
        file.write("two\n")
    log.rename(log.parent / "auth.log.older")
    (log.parent / "auth.log.old").write_text("three\n")
    log.write_text("four\n")
    assert follow() == ["two", "three", "four"]


def test_copy_and_truncate(spark, tmp_path, log):
    follow = Follower(spark, tmp_path, str(log))
    log.write_text("one\n")
    assert follow() == ["one"]
    (log.parent / "auth.log.1").write_text("one\ntwo\n")
    log.write_text("")
    assert follow() == ["two"]
    log.write_text("three, and more\n")
    (log.parent / "auth.log.bak").write_text("three, and more\n")
    assert follow() == ["three, and more"]


def test_old_files_of_a_new_log_are_not_read(log):
    (log.parent / "auth.log.1").write_text("from before\n")
    reader = TailReader({"path": str(log)})
    first = reader.latestOffset()
    assert reader.partitions({}, first) == []
    log.write_text("new\n")
    parts = reader.partitions(first, reader.latestOffset())
    assert [line for p in parts for b in reader.read(p) for line in b.column("line").to_pylist()] == ["new"]


def test_many_logs_are_listed_fast(tmp_path):
    for k in range(10_000):
        (tmp_path / f"{k}.log").touch()
    store = LogStore(f"{tmp_path}/*.log")
    began = time.perf_counter()
    assert len(store.logs()) == 10_000
    assert time.perf_counter() - began < 1


def test_ranges_cover_each_line_once(tmp_path):
    data = b"".join(b"%d %s\n" % (i, b"y" * (i * 7 % 23)) for i in range(200)) + b"bad \xff line\nlast, unfinished"
    path = tmp_path / "x.log"
    path.write_bytes(data)
    wanted = data.decode("utf-8", "ignore").split("\n")
    store = LogStore(str(path))
    for begin in (0, data.index(b"57 ")):
        for step in (1, 7, 64, 1000, 10**6):
            got = []
            for low in range(begin, len(data), step):
                part = ByteRange("", "", "", 0, begin, len(data), low, min(low + step, len(data)))
                with store.open(str(path)) as file:
                    for starts, lines in read_range(file, part):
                        got += zip(starts.tolist(), lines)
            skipped = data[:begin].count(b"\n")
            assert [line for _, line in got] == wanted[skipped:], step
            assert all(data[s:].startswith(line.encode()) for s, line in got if "bad" not in line)
    with store.open(str(path)) as file:
        assert complete_end(file, len(data)) == data.rindex(b"\n") + 1
        assert complete_end(file, 0) == 0
