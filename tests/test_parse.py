import pytest
from pyspark.sql import functions as F

import logframe as lf
from logframe.functions.classify import Rule, RuleTable
from logframe.operators.parse import FORMATS, HEADER_LAYOUT, HEADER_PATTERN, LogFormat


def parsed(spark, log_type, *lines):
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "seq int, line string")
    records = lf.parse(frame, FORMATS[log_type]).orderBy("seq", "part").collect()
    return [r.asDict() for r in records]


def one(spark, log_type, line, **expected):
    records = parsed(spark, log_type, line)
    assert len(records) == 1, line
    assert {k: records[0][k] for k in expected} == expected


@pytest.mark.parametrize("log_type", list(FORMATS))
def test_plain_text_is_rejected(spark, log_type):
    assert parsed(spark, log_type, "Hello World", "", "   ") == []


def test_header_edges(spark):
    one(spark, "syslog", "Jul 19 21:07:46 host sudo: msg", timestamp="Jul", hostname="19", process="21", pid=None,
        message="07:46 host sudo: msg")
    assert parsed(spark, "syslog", "2026 h proc[abc]: x") == []
    one(spark, "syslog", "2026 h foo bar[12]: x", process="foo bar", pid=12)
    one(spark, "syslog", "t h p:", message="")
    one(spark, "syslog", "t h  : m", process=" ", message="m")
    one(spark, "syslog", "t h p[99999999999999999999]: m", pid=None, process="p")
    one(spark, "syslog", "t h p: café", timestamp="t", hostname="h", process="p", message="café")


def test_record_has_all_fields(spark):
    record = parsed(spark, "auth", "t h sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2")[0]
    assert record == {
        "log_type": "auth", "source_file": "auth.log", "timestamp": "t", "hostname": "h", "process": "sshd", "pid": 1,
        "severity": "HIGH", "event": "Failed password", "event_type": "AUTH_FAILURE", "user": "root", "ip": "10.0.0.1",
        "port": 22, "protocol": "ssh2", "message": "Failed password for root from 10.0.0.1 port 22 ssh2",
        "seq": 0, "part": 0,
    }


def test_auth_edges(spark):
    one(spark, "auth", "t h sshd[1]: Failed password for invalid user  from 1.2.3.4 port 22 ssh2",
        event_type="AUTH_FAILURE", severity="HIGH", user="from", ip="1.2.3.4", port=22, protocol="ssh2")
    one(spark, "auth", "t h sshd[1]: Invalid user bob from 999.1.1.1", event_type="INVALID_USER", user=None, ip="999.1.1.1")
    one(spark, "auth", "t h sshd[1]: FAILED PASSWORD for user bob", event="Failed password", user="bob")
    one(spark, "auth", "t h SUDO: x", event="sudo command", event_type="SUDO_COMMAND", severity="MEDIUM")
    one(spark, "auth", "t h sudo: session closed", event_type="SESSION_CLOSE")
    one(spark, "auth", "t h x: before dawn, support 5, sshd", user=None, event_type="UNKNOWN", port=5, protocol=None)
    one(spark, "auth", "t h x: key for(x) ssh-rsa", user=None, protocol="ssh")
    one(spark, "auth", "t h x: éssh2 ssh2x", protocol=None)


def test_other_formats(spark):
    one(spark, "syslog", "t h cron: x", event_type="SYSTEM_EVENT", event="SYSTEM_EVENT", severity="INFO")
    one(spark, "syslog", "t h CRON: x", event_type="CRON", event="CRON")
    one(spark, "kern", "t h kernel: data error", event_type="STORAGE")
    one(spark, "kern", "t h kernel: audit: x", event_type="AUDIT", source_file="kern.log", user=None)
    one(spark, "kern", "t h kernel: x", event="Kernel Event", event_type="KERNEL", severity="INFO")
    one(spark, "dmesg", "[    0.123456] usb 1-1: new device", timestamp="0.123456", event_type="USB", severity="LOW",
        hostname=None, process="kernel", source_file="dmesg")
    assert parsed(spark, "dmesg", "[Mon Jan 1 00:00:00 2024] usb") == []
    one(spark, "dmesg", "[ 1.0] network error", event_type="NETWORK", severity="LOW")
    one(spark, "dmesg", "[1.2.3] audit", timestamp="1.2.3", event_type="BOOT")
    one(spark, "dpkg", "2026-07-01 10:00:00 upgrade  vim:amd64   1.0  2.0", event_type="PACKAGE_UPGRADE", severity="MEDIUM",
        message="upgrade vim:amd64 1.0  2.0", timestamp="2026-07-01 10:00:00", hostname=None, process="dpkg", pid=None)
    one(spark, "dpkg", "2026-07-01 10:00:00 status installed vim 1.0", event="Package Event", event_type="PACKAGE")
    one(spark, "dpkg", "2026-07-01 10:00:00 Install vim", event_type="PACKAGE_INSTALL", message="Install vim")
    assert parsed(spark, "dpkg", "2026-07-01 10:00:00 startup") == []


def test_lines_are_framed_before_they_are_parsed(spark):
    records = parsed(spark, "syslog", "  t h a: 1\x0b\tt h b: 2\r\n\r\nt h c: 3  junk ")
    assert [(r["process"], r["message"], r["part"]) for r in records] == [("a", "1", 0), ("b", "2", 1), ("c", "3", 5)]


def test_dispatch_equals_single_formats(spark):
    line = "2026-07-01 10:00:00 install kernel: usb Failed password for root"
    names = ["auth.log", "syslog", "kern.log.1", "dpkg.log", "dmesg", "nginx.log", "foo.txt"]
    frame = spark.createDataFrame([(n, line if n != "dmesg" else "[1.0] usb") for n in names], "filename string, line string")
    together = lf.parse_all(frame)
    for name, log_format in FORMATS.items():
        mine = F.startswith("filename", F.lit(name))
        alone = lf.parse(frame.filter(mine), log_format)
        assert sorted(map(str, together.filter(mine).collect())) == sorted(map(str, alone.collect()))
    rejects = {(r.filename, r.reason) for r in lf.parse_rejects(frame).collect()}
    assert rejects == {("nginx.log", "unsupported"), ("foo.txt", "unsupported")}
    assert together.count() + lf.parse_rejects(frame).count() == len(names)


def test_own_format(spark):
    rules = RuleTable((Rule("get", "Read", "READ", "LOW"),), ("Other", "OTHER", "INFO"))
    own = LogFormat("nginx", "nginx.log", HEADER_PATTERN, HEADER_LAYOUT, rules)
    frame = spark.createDataFrame([("nginx.log", "t h p: GET /"), ("auth.log", "t h p: x")], "filename string, line string")
    found = {(r.log_type, r.event_type) for r in lf.parse_all(frame, {**FORMATS, "nginx": own}).collect()}
    assert found == {("nginx", "READ"), ("auth", "UNKNOWN")}


def test_predicates_and_counts(spark):
    frame = spark.createDataFrame(
        [("t h sshd: Failed password for u from 1.1.1.1",), ("t h x: y",), ("t h sudo: y",)], "line string"
    )
    records = lf.parse_auth(frame)
    assert lf.security_events(records).count() == 2
    assert lf.network_events(records).count() == lf.user_events(records).count() == 1
    counts = {(r.dimension, r.value): r.n for r in lf.summary_counts(records).collect()}
    assert counts == {
        ("event_type", "AUTH_FAILURE"): 1, ("event_type", "UNKNOWN"): 1, ("event_type", "SUDO_COMMAND"): 1,
        ("severity", "HIGH"): 1, ("severity", "INFO"): 1, ("severity", "MEDIUM"): 1,
        ("process", "sshd"): 1, ("process", "x"): 1, ("process", "sudo"): 1,
    }
    assert [tuple(r) for r in lf.record_counts(records).collect()] == [("auth", 3)]
