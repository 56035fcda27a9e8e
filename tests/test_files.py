import gzip
import os
from pathlib import Path, PurePath

import pytest
from pyspark.errors import AnalysisException

import logframe as lf
from logframe.session import sizing
from workload.files import cut_in_half, write_files

AUTH = "2026-01-01T00:00:00+00:00 h sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
DPKG = "2026-07-01 10:00:00 install vim:amd64 1.0\n"
DMESG = "[    1.000000] usb 1-1: new\n"


def test_catalogue_of_names(spark):
    cases = {
        "auth.log": ("auth", False, 0, ".log", "file"),
        "auth.log.1": ("auth", False, 1, ".1", "file"),
        "auth.log.1.gz": ("auth", True, 1, ".gz", "gzip"),
        "syslog": ("syslog", False, 0, "", "file"),
        "dmesg.1.gz": ("dmesg", True, 1, ".gz", "gzip"),
        "AUTH.LOG.2.GZ": ("auth", True, 0, ".gz", "gzip"),
        "auth.log.1.gz-2026071921.backup": ("auth", False, 0, ".backup", "file"),
        "nginx.log": ("nginx", False, 0, ".log", "file"),
        "foo.txt": ("unknown", False, 0, ".txt", "file"),
        "kernel_x": ("kern", False, 0, "", "file"),
        "authors.txt": ("auth", False, 0, ".txt", "file"),
        ".auth": ("unknown", False, 0, "", "file"),
        "docker.20260719210000": ("docker", False, 20260719210000, ".20260719210000", "file"),
        "a..b": ("unknown", False, 0, ".b", "file"),
    }
    paths = [f"/var/log/{name}" for name in cases] + ["plain", "/root.log"]
    rows = {r.path: r for r in lf.catalog_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    for name, expected in cases.items():
        row = rows[f"/var/log/{name}"]
        assert (row.log_type, row.compressed, row.rotation, row.extension, row.reader) == expected, name
    for path in paths:
        pure, row = PurePath(path), rows[path]
        assert (row.directory, row.stem, row.suffix) == (str(pure.parent), pure.stem, pure.suffix), path


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "a+b c%20d"
    folder.mkdir()
    (folder / "auth.log").write_text(AUTH * 3 + "junk\n")
    (folder / "AUTH.LOG.1").write_text(AUTH)
    (folder / "dpkg.log").write_text("\n" + DPKG + DPKG)
    (folder / "kern.log").write_text("nothing here\n")
    with gzip.open(folder / "dmesg.1.gz", "wt") as file:
        file.write(DMESG * 2)
    return folder


def test_scan_keeps_order_and_bytes(spark, tmp_path):
    lines = [f"line {i} é" for i in range(5000)]
    (tmp_path / "syslog").write_bytes("\r\n".join(lines).encode() + b"\nbad \xff\xe9 byte")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16384)
    try:
        frame = lf.read_lines(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 3
        rows = lf.frame_lines(frame).orderBy("file_path", "block_start", "line_id", "part").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in rows] == [*lines, "bad  byte"]
    assert {(r.filename, r.log_type) for r in rows} == {("syslog", "syslog")}


def test_gzip_lines_are_dealt_out(spark, tmp_path):
    with gzip.open(tmp_path / "syslog.1.gz", "wt") as file:
        file.write("".join(f"line {i}\n" for i in range(1000)))
    frame = lf.read_lines(spark, str(tmp_path), spread_out=True)
    assert frame.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = lf.frame_lines(frame).orderBy("file_path", "block_start", "line_id", "part").collect()
    assert [r.line for r in rows] == [f"line {i}" for i in range(1000)]


def test_sizing():
    small, large = sizing(10**9), sizing(100 * 10**12)
    assert small == {"spark.sql.files.maxPartitionBytes": 128 << 20, "spark.sql.shuffle.partitions": 200}
    assert large == {"spark.sql.files.maxPartitionBytes": 10**9, "spark.sql.shuffle.partitions": 50_000}


def test_job_over_real_files(spark, logs):
    files, records = lf.process_logs(spark, str(logs))
    assert {r.filename for r in files.collect()} == {"auth.log", "AUTH.LOG.1", "dpkg.log", "kern.log", "dmesg.1.gz"}
    assert {(r.log_type, r.n_records) for r in lf.record_counts(records).collect()} == {("auth", 4), ("dpkg", 2), ("dmesg", 2)}
    joined = records.join(files.select("path", "rotation"), records.file_path == files.path)
    assert {(r.filename, r.rotation) for r in joined.select("filename", "rotation").collect()} == {
        ("auth.log", 0), ("AUTH.LOG.1", 1), ("dpkg.log", 0), ("dmesg.1.gz", 1)}
    first = lf.preview(records.filter("log_type = 'auth'"), 2).collect()
    assert [r.filename for r in first] == ["AUTH.LOG.1", "auth.log"]


def test_unsupported_and_missing(spark, logs):
    (logs / "nginx.log").write_text("GET /\n")
    with pytest.raises(lf.UnsupportedLogType, match="nginx"):
        lf.process_logs(spark, str(logs))
    assert lf.process_logs(spark, str(logs), strict=False)[1].count() == 8
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        lf.process_logs(spark, str(logs / "absent"))


def test_report(spark, logs):
    (logs / "foo.txt").write_text("x\n")
    files, lines = lf.catalog_files(spark, str(logs)), lf.read_lines(spark, str(logs))
    present = files.select("path").first().path
    # Plain paths are those of the listing.
    asked = [(present,), (present.removeprefix("file:"),), ("file://" + present.removeprefix("file:"),), ("/nowhere/auth.log",)]
    report = lf.run_report(files, lines, expected=spark.createDataFrame(asked, "path string"))
    found = {(r.path.rsplit("/", 1)[1], r.status, r.n_lines, r.n_records) for r in report.collect()}
    assert found == {
        ("auth.log", "ok", 4, 3), ("AUTH.LOG.1", "ok", 1, 1), ("dpkg.log", "ok", 2, 2), ("kern.log", "empty", 1, 0),
        ("dmesg.1.gz", "ok", 2, 2), ("foo.txt", "unsupported", 1, 0), ("auth.log", "missing", 0, 0)}
    assert tuple(lf.report_totals(report).first()) == (5, 8)
    chars = {Path(r.file_path).name: (r.n_lines, r.n_chars) for r in lf.chars_read(lines).collect()}
    assert chars["auth.log"] == (4, 3 * (len(AUTH) - 1) + 4)


def test_run_over_some_files(spark, tmp_path):
    """Absent paths are left out, and a torn file is told from a whole one."""
    (tmp_path / "auth.log").write_text(AUTH * 3)
    whole = gzip.compress((DMESG * 20_000).encode(), mtime=0)
    (tmp_path / "dmesg.1.gz").write_bytes(whole)
    (tmp_path / "dmesg.2.gz").write_bytes(whole[: len(whole) // 2])
    paths = [str(tmp_path), str(tmp_path / "absent" / "kern.log")]
    files, records = lf.process_logs(spark, paths, tolerant=True)
    assert records.filter("log_type = 'auth'").count() == 3
    lines = lf.read_lines(spark, str(tmp_path), tolerant=True)
    asked = spark.createDataFrame([(paths[1],)], "path string")
    report = lf.run_report(files, lines, expected=asked, broken=lf.broken_files(files))
    found = {r.path.rsplit("/", 1)[1]: (r.status, r.n_records) for r in report.collect()}
    assert found.pop("dmesg.2.gz")[0] == "failed"
    assert found == {"auth.log": ("ok", 3), "dmesg.1.gz": ("ok", 20_000), "kern.log": ("missing", 0)}
    assert lf.process_logs(spark, paths[1:], tolerant=True)[1].count() == 0


def test_files_written_at_once_and_cut(spark, tmp_path):
    lines = spark.range(9).selectExpr("concat('line ', id) line", "id % 2 * 2 file")
    files = [str(tmp_path / f"auth.log.{n}.gz") for n in range(4)]
    write_files(lines, "file", str(tmp_path / "scratch"), files, "gzip")
    found = [gzip.open(file, "rt").read().split() for file in files]
    assert [sorted(f for f in each if f != "line") for each in found] == [list("02468"), [], list("1357"), []]
    size = os.path.getsize(files[0])
    whole = open(files[0], "rb").read()
    cut_in_half(spark, files[0])
    assert open(files[0], "rb").read() == whole[: size // 2]
