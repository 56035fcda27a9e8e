"""Bounded batches, progress by version, and running counts of followed logs."""

import json
import os

import pytest

import logframe as lf
from logframe.streaming.progress import ProgressLog, limited, line_cut
from logframe.streaming.tail import TailReader


class Limited:
    """Runs of one stream with limits, which write each batch to a folder of its own."""

    def __init__(self, spark, tmp_path, pattern, **options):
        self.spark, self.tmp, self.pattern = spark, tmp_path, pattern
        self.options = {"progress": str(tmp_path / "progress"), **options}

    def __call__(self, most_batches=None):
        """The batches that a run brings, each as lines in order."""
        found = []

        def take(batch, number):
            if most_batches is not None and len(found) >= most_batches:
                raise RuntimeError("stopped in the middle")
            found.append([(r.log_path, r.line) for r in batch.orderBy("log_path", "segment", "byte_offset").collect()])

        stream = lf.tail_logs(self.spark, self.pattern, **self.options).writeStream.foreachBatch(take)
        query = stream.option("checkpointLocation", str(self.tmp / "state")).start()
        try:
            query.processAllAvailable()
        except Exception as error:
            assert "stopped in the middle" in str(error)
        finally:
            query.stop()
        return found

    def offsets(self):
        folder = self.tmp / "state" / "offsets"
        for name in sorted((n for n in os.listdir(folder) if n.isdigit()), key=int):
            yield json.loads((folder / name).read_text().splitlines()[-1])


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path / "logs"


def size(batch):
    return sum(len(line.encode()) + 1 for _, line in batch)


def test_backlog_comes_in_limited_batches(spark, tmp_path, folder):
    wanted = {}
    for k in range(100):
        path = folder / f"{k}.log"
        lines = [f"{k} line {n} " + "ü" * (n % 7) for n in range(k % 11 + 1)]
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (k, k))
        wanted[str(path)] = lines
    follow = Limited(spark, tmp_path, f"{folder}/*.log", max_bytes=1500, max_files=9)
    batches = follow(most_batches=3)
    batches += follow()
    # The batch that was stopped comes again, and nothing else does.
    assert len(batches) > 10 and all(0 < size(b) <= 1500 and len({log for log, _ in b}) <= 10 for b in batches)
    got = {}
    for log, line in (pair for batch in batches for pair in batch):
        got.setdefault(log, []).append(line)
    assert got == wanted
    # What waited longest came first.
    firsts = [min(int(os.path.basename(log)[:-4]) for log, _ in b) for b in batches]
    assert firsts == sorted(firsts)
    assert all(set(offset) == {"version", "stream"} for offset in follow.offsets())
    kept = [n for n in os.listdir(tmp_path / "progress") if n.endswith(".state")]
    assert len(kept) < len(batches)


def test_rotation_while_files_wait(spark, tmp_path, folder):
    log = folder / "a.log"
    log.write_text("".join(f"one {n}\n" for n in range(50)))
    follow = Limited(spark, tmp_path, str(log), max_bytes=100)
    lines = [line for b in follow(most_batches=2) for _, line in b]
    assert 0 < len(lines) < 50
    with log.open("a") as file:
        file.write("last of one\n")
    log.rename(folder / "a.log.1")
    log.write_text("two\nhalf")
    lines += [line for b in follow(most_batches=1) for _, line in b]
    log.rename(folder / "a.log.0")
    log.write_text("three\n")
    lines += [line for b in follow() for _, line in b]
    assert lines == [f"one {n}" for n in range(50)] + ["last of one", "two", "half", "three"]
    assert follow() == []


def test_long_lines_pass_the_limit_alone(spark, tmp_path, folder):
    log = folder / "a.log"
    log.write_text("short\n" + "x" * 5000 + "\nshort\n")
    batches = Limited(spark, tmp_path, str(log), max_bytes=10)()
    assert [[line[:5] for _, line in b] for b in batches] == [["short"], ["xxxxx"], ["short"]]


def test_old_checkpoint_goes_on_with_a_progress_folder(spark, tmp_path, folder):
    log = folder / "a.log"
    log.write_text("one\ntwo\n")
    follow = Limited(spark, tmp_path, str(log), progress=None)
    assert follow() == [[(str(log), "one"), (str(log), "two")]]
    with log.open("a") as file:
        file.write("three\nfour\n")
    follow.options = {"progress": str(tmp_path / "progress"), "max_bytes": 6}
    assert [[line for _, line in b] for b in follow()] == [["three"], ["four"]]
    assert follow() == []


def test_progress_belongs_to_one_stream(tmp_path):
    log, other = ProgressLog(str(tmp_path / "a")), ProgressLog(f"file:{tmp_path}/b")
    offset = log.write(1, {"x": 1}, [("l", {}, 0)])
    assert ProgressLog(str(tmp_path / "a")).read(offset) == ({"x": 1}, [("l", {}, 0)])
    assert log.between({}, offset) == [("l", {}, 0)] and log.between(offset, offset) == []
    with pytest.raises(ValueError, match="another stream"):
        other.read(offset)
    with pytest.raises(FileNotFoundError, match="lost version 7"):
        log.read(log.offset(7))


def test_limits_need_a_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="progress"):
        lf.tail_logs(spark, str(tmp_path), max_bytes=5)


def test_line_cut(tmp_path):
    data = b"ab\ncdef\n\nghi\njk"
    (tmp_path / "f").write_bytes(data)
    ends = {k + 1 for k, c in enumerate(data) if c == 10} | {len(data)}
    with open(tmp_path / "f", "rb") as file:
        for begin in sorted(ends | {0})[:-1]:
            for room in range(1, 20):
                for block in (1, 3, 100):
                    inside = [e for e in ends if begin < e <= begin + room]
                    wanted = max(inside) if inside else min(e for e in ends if e > begin)
                    assert line_cut(file, begin, room, len(data), block) == wanted


def test_a_known_path_is_opened_without_listing(folder):
    log = folder / "a.log"
    log.write_text("one\n")
    reader = TailReader({"path": str(log)})
    parts = reader.partitions({}, reader.latestOffset())
    calls = []
    reader.store.files = type("Files", (), {"get_file_info": lambda *a: calls.append(a) or []})()
    assert [b.column("line").to_pylist() for b in reader.read(parts[0])] == [["one"]] and not calls
    log.rename(folder / "a.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    assert len(calls) == 1


def count_rows(frame):
    return sorted(map(str, frame.select("dimension", "value", "n").collect()))


def test_counts_of_a_rotated_log(spark, tmp_path, folder):
    log = folder / "auth.log"
    line = "2026-01-01T00:00:0{} host sshd[1]: {}\n"
    texts = ["Failed password for root from 1.1.1.1 port 22 ssh2", "Accepted password for bob from 2.2.2.2 port 22 ssh2", "other"]
    rounds = [[line.format(k % 10, texts[(k + r) % 3 if r else 0]) for k in range(5 + r)] for r in range(4)]

    def run():
        records = lf.parse_auth(lf.tail_logs(spark, str(log)))
        writer = lf.write_counts(lf.summary_counts(records), str(tmp_path / "counts"), str(tmp_path / "state"), compact_every=2)
        writer.trigger(availableNow=True).start().awaitTermination()

    kinds = "dimension string, value string, n long"
    assert lf.read_counts(spark, str(tmp_path / "counts"), kinds).count() == 0
    written = []
    for number, lines in enumerate(rounds):
        if number == 2:
            log.rename(folder / "auth.log.1")
        with log.open("a") as file:
            file.writelines(lines)
        written += lines
        run()
        (tmp_path / f"all{number}").mkdir()
        (tmp_path / f"all{number}" / "auth.log").write_text("".join(written))
        batch = lf.summary_counts(lf.parse_auth(lf.read_lines(spark, str(tmp_path / f"all{number}"))))
        assert count_rows(lf.read_counts(spark, str(tmp_path / "counts"), kinds)) == count_rows(batch)
    assert sorted(os.listdir(tmp_path / "counts" / "all")) == ["batch=1", "batch=3"]


def test_a_line_beyond_the_room_waits():
    """After 90 of 100 bytes, a line of 30 is left to the next batch; as the first one it is read whole."""
    files = [{"path": name, "mtime": k, "end": 90, "check": ""} for k, name in enumerate(("/a", "/b"))]
    now = {f["path"]: {"files": {"0": f}, "current": "0"} for f in files}
    ranges = [(f["path"], f, 0) for f in files]
    cut = lambda file, begin, room: (begin + max(30, room // 30 * 30), "")
    found = [limited(ranges[k:], now, most, None, cut, lambda file, at: "")[1] for k, most in ((0, 100), (1, 10))]
    assert [[(log, file["end"] - begin) for log, file, begin in read] for read in found] == [[("/a", 90)], [("/b", 30)]]
