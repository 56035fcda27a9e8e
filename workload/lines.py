"""Log lines made from the rows of ``events``, one line per event, in each of the log formats.

``oracles.py`` makes the same lines in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logframe.sources.spread import spread

SYSLOG_PROCESSES = (
    "systemd",
    "rsyslogd",
    "snapd",
    "PackageKit",
    "anacron",
    "CRON",
    "kernel",
    "NetworkManager",
    "dbus-daemon",
    "cron",
    "osboxes",
)
KERNEL_WORDS = (
    "usb",
    "pci",
    "cpu",
    "memory",
    "filesystem",
    "ext4",
    "data",
    "nvme",
    "audit",
    "network",
    "error",
    "warning",
    "plain",
)
DPKG_ACTIONS = ("install", "upgrade", "remove", "configure", "status", "purge")
FILE_NAMES = (
    "auth.log",
    "syslog.1",
    "kern.log.1",
    "dpkg.log",
    "dmesg.1.gz",
    "nginx.log",
    "AUTH.LOG.2.GZ",
    "auth.log.1.gz-2026071921.backup",
    "foo.txt",
    ".auth",
)

def event_id() -> Column:
    return F.col("event_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(values: tuple[str, ...], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def iso_time() -> Column:
    """Six decimals always, and independent of the session's time zone."""
    text = F.col("ts").cast("timestamp_ntz").cast("string")
    return concat(F.replace(F.left(text, F.lit(19)), F.lit(" "), F.lit("T")), ".", F.rpad(F.substring(text, 21, 6), 6, "0"))


def header() -> Column:
    return concat(iso_time(), "+00:00 host", F.col("user_id") % 7, " ")


def auth_line() -> Column:
    pid = concat("[", 100 + event_id() % 900, "]")
    user = concat("u", F.col("user_id"))
    source = concat("10.0.", F.col("user_id") % 256, ".", event_id() % 256)
    port = 1024 + event_id() % 50000
    bodies = [
        concat("sshd", pid, ": Failed password for invalid user ", user, " from ", source, " port ", port, " ssh2"),
        concat("sshd", pid, ": Failed password for ", user, " from ", source, " port ", port, " ssh2"),
        concat("sshd", pid, ": Accepted password for ", user, " from ", source, " port ", port, " ssh2"),
        concat("sshd", pid, ": pam_unix(sshd:session): session opened for user ", user, "(uid=1000) by root(uid=0)"),
        concat("sudo: pam_unix(sudo:session): session closed for user ", user),
        concat("sudo:  ", user, " : TTY=pts/1 ; USER=root ; COMMAND=/usr/bin/ls"),
        concat("passwd", pid, ": password updated successfully"),
        concat("sshd", pid, ": Invalid user ", user, " from ", source, " port ", port),
        F.lit("no header colon here"),
        concat("cron: job ", F.col("event_type")),
    ]
    body = F.lit(None)
    for place, text in enumerate(bodies):
        body = F.when(event_id() % 10 == place, text).otherwise(body)
    return concat(header(), body)


def syslog_line() -> Column:
    process = pick(SYSLOG_PROCESSES, event_id() % 11)
    pid = F.when(event_id() % 2 == 0, concat("[", 100 + event_id() % 900, "]")).otherwise(F.lit(""))
    body = concat(process, pid, ": unit ", F.col("event_type"), " of u", F.col("user_id"), " done")
    return concat(header(), F.when(event_id() % 17 == 0, F.lit("no header colon here")).otherwise(body))


def kernel_word() -> Column:
    word = pick(KERNEL_WORDS, event_id() % 13)
    return F.when(event_id() % 2 == 0, F.upper(word)).otherwise(word)


def kern_line() -> Column:
    body = concat("kernel: ", kernel_word(), " ", F.col("event_type"), " ", event_id(), ": state changed")
    return concat(header(), F.when(event_id() % 17 == 0, F.lit("no header colon here")).otherwise(body))


def dmesg_line() -> Column:
    seconds = F.lpad((event_id() / 1000).cast("bigint").cast("string"), 5, " ")
    time = concat(seconds, ".", F.lpad((event_id() % 1000).cast("string"), 3, "0"), "000")
    line = concat("[", time, "] ", kernel_word(), " ", F.col("event_type"), " ", event_id())
    return F.when(event_id() % 17 == 0, concat("[Mon Jan 1 00:00:00 2024] usb ", event_id())).otherwise(line)


def dpkg_line() -> Column:
    time = F.replace(F.left(iso_time(), F.lit(19)), F.lit("T"), F.lit(" "))
    details = F.when(event_id() % 7 == 0, F.lit("")).otherwise(concat("   1.", event_id() % 10, "  2.0"))
    line = concat(time, " ", pick(DPKG_ACTIONS, event_id() % 6), "  pkg", F.col("user_id"), ":amd64", details)
    return F.when(event_id() % 17 == 0, concat(time, " startup")).otherwise(line)


LINES = {"auth": auth_line, "syslog": syslog_line, "kern": kern_line, "dpkg": dpkg_line, "dmesg": dmesg_line}


def lines_of(spark: SparkSession, sf_dir: str, log_type: str) -> DataFrame:
    """``event_id, line``: every event as a line of one format."""
    return spread(table(spark, sf_dir, "events")).select("event_id", LINES[log_type]().alias("line"))


def file_path() -> Column:
    return concat("/var/log/host", F.col("user_id") % 7, "/", pick(FILE_NAMES, event_id() % len(FILE_NAMES)))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, file_path, filename, line``: every event as a line of the file it falls to."""
    name = F.lower(pick(FILE_NAMES, event_id() % len(FILE_NAMES)))
    line = concat("GET /", F.col("event_type"), " ", event_id())
    for log_type, make in LINES.items():
        line = F.when(F.startswith(name, F.lit(log_type)), make()).otherwise(line)
    events = spread(table(spark, sf_dir, "events")).select("event_id", file_path().alias("file_path"), line.alias("line"))
    return events.withColumn("filename", F.substring_index("file_path", "/", -1))
