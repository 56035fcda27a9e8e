"""Random lines against Python's regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

import logframe as lf
from logframe.functions import extract
from logframe.operators.parse import FORMATS

# The shapes of lines and of the fields in messages, as Python patterns.
HEADER = re.compile(r"^(\S+)\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.*)$")
DPKG = re.compile(r"^(\S+\s+\S+)\s+(\w+)\s+(\S+)(?:\s+(.*))?$")
DMESG = re.compile(r"^\[\s*([0-9.]+)\]\s+(.*)$")
FIELDS = {
    "user": re.compile(r"for\s+(?:invalid\s+user\s+|user\s+)?([^\s(]+)"),
    "ip": re.compile(r"from\s+(\d{1,3}(?:\.\d{1,3}){3})"),
    "port": re.compile(r"port\s+(\d+)"),
    "protocol": re.compile(r"\b(ssh2|ssh)\b"),
}
PIECES = [
    "a", "b1", "host", "[", "]", "] ", "[12]", "[3", ":", ": ", "::", " ", "  ", "\t", "\xa0", "\x1f", "　", ".", "1.5", "12",
    "for", "for ", "invalid user ", "user ", "from ", "1.2.3.4", "999.9.9.99999", "port ", "22", "ssh", "ssh2", "_", "-",
    "(", "é", "٣", "install", "purge", "[ 1.0] ", "中", "½",
]


def lines(seed, start=""):
    chooser = random.Random(seed)
    return [start + "".join(chooser.choices(PIECES, k=chooser.randrange(1, 14))) for _ in range(3000)]


def number(digits):
    return int(digits) if digits and digits.isascii() else None


def expected(log_type, line):
    if log_type == "dpkg":
        match = DPKG.match(line)
        if match:
            time, action, package, details = match.groups()
            return time, None, "dpkg", None, f"{action} {package} {details or ''}".strip()
    elif log_type == "dmesg":
        match = DMESG.match(line)
        if match:
            return match[1], None, "kernel", None, match[2]
    else:
        match = HEADER.match(line)
        if match:
            return match[1], match[2], match[3], number(match[4]), match[5]
    return None


@pytest.mark.parametrize("log_type,start", [("kern", ""), ("kern", "t h p[1]: "), ("dpkg", "d t "), ("dmesg", "[ 1")])
def test_lines(spark, log_type, start):
    cases = lines(11, start)
    frame = spark.createDataFrame(list(enumerate(cases)), "seq int, line string")
    rows = {r.seq: r for r in lf.parse(frame, FORMATS[log_type]).collect()}
    assert len(rows) > 50
    for seq, case in enumerate(cases):
        wanted = expected(log_type, case.strip()) if case.strip() else None
        row = rows.get(seq)
        got = row and (row.timestamp, row.hostname, row.process, row.pid, row.message)
        assert got == wanted, repr(case)


def test_fields(spark):
    cases = lines(12)
    frame = spark.createDataFrame(list(enumerate(cases)), "seq int, message string")
    columns = [getattr(extract, f"extract_{name}")(F.col("message")).alias(name) for name in FIELDS]
    for row in frame.select("seq", *columns).collect():
        for name, pattern in FIELDS.items():
            match = pattern.search(cases[row.seq])
            wanted = match and match[1]
            assert row[name] == (number(wanted) if name == "port" else wanted), (name, cases[row.seq])
