"""Log lines to records.

A format is data: a pattern, a layout that puts the captured groups in the record's order, and a rule table.
The layout joins the groups by line feeds, which a framed line never holds, so one pass of the pattern yields
all header fields and also the verdict: a line that does not match comes back as a single piece.

The pattern is the costly step. It sits under an ``explode`` of a one-element array: Catalyst pushes filters
on parsed columns down as far as there and no further, so the pattern runs once per line whatever the query
asks. The same holds for the search for a rule. Fields that nobody selects are pruned above them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as path_functions
from ..functions.classify import AUTH_RULES, DMESG_RULES, DPKG_RULES, KERN_RULES, SYSLOG_RULES, RuleTable
from ..functions.extract import extract_ip, extract_port, extract_protocol, extract_user
from ..functions.text import NON_SPACE as NS, SPACE as S, empty_to_null
from ..schema import RECORD_FIELDS
from .frame import frame_lines

LAYOUT_PARTS = ("timestamp", "hostname", "process", "pid", "message", "action")


@dataclass(frozen=True)
class LogFormat:
    """``layout`` is a replacement string with one line per name in ``LAYOUT_PARTS``; ``network`` asks for
    user, address, port and protocol to be looked up in the message."""

    name: str
    source_file: str
    pattern: str
    layout: str
    rules: RuleTable
    network: bool = False


# Line shapes of the five formats, and the file name each puts into its records.
HEADER_PATTERN = rf"(?U)^({NS}++){S}++({NS}++){S}+([^\[:]++)(?:\[(\d+)\])?:{S}*(.*)$"
HEADER_LAYOUT = "$1\n$2\n$3\n$4\n$5\n"
DPKG_PATTERN = rf"(?U)^({NS}+{S}+{NS}+){S}+([\p{{L}}\p{{N}}_]+){S}+({NS}+)(?:{S}+(.*))?$"
DPKG_LAYOUT = "$1\n\ndpkg\n\n$2 $3 $4\n$2"
DMESG_PATTERN = rf"(?U)^\[{S}*([0-9.]+)\]{S}+(.*)$"
DMESG_LAYOUT = "$1\n\nkernel\n\n$2\n"

AUTH = LogFormat("auth", "auth.log", HEADER_PATTERN, HEADER_LAYOUT, AUTH_RULES, network=True)
SYSLOG = LogFormat("syslog", "syslog", HEADER_PATTERN, HEADER_LAYOUT, SYSLOG_RULES)
KERN = LogFormat("kern", "kern.log", HEADER_PATTERN, HEADER_LAYOUT, KERN_RULES)
DPKG = LogFormat("dpkg", "dpkg.log", DPKG_PATTERN, DPKG_LAYOUT, DPKG_RULES)
DMESG = LogFormat("dmesg", "dmesg", DMESG_PATTERN, DMESG_LAYOUT, DMESG_RULES)

FORMATS: dict[str, LogFormat] = {f.name: f for f in (AUTH, SYSLOG, KERN, DPKG, DMESG)}


def layout_pieces(line: Column, pattern: str, layout: str) -> Column:
    return F.split(F.regexp_replace(line, pattern, layout), "\n", -1)


def _per_type(
    formats: Sequence[LogFormat],
    value: Callable[[LogFormat], Column],
    share: Callable[[LogFormat], object] = lambda log_format: log_format.name,
) -> Column:
    """The value for the row's log type, else null; a lone format needs no test. Formats with the same ``share``
    have one branch for all: the three with the same header have their pattern in the plan once."""
    if len(formats) == 1:
        return value(formats[0])
    groups: dict[object, list[LogFormat]] = {}
    for log_format in formats:
        groups.setdefault(share(log_format), []).append(log_format)
    branches = [F.when(F.col("log_type").isin(*[f.name for f in group]), value(group[0])) for group in groups.values()]
    return F.coalesce(*branches)


def _typed(lines: DataFrame, formats: Sequence[LogFormat]) -> DataFrame:
    """Framed lines with a ``log_type`` column."""
    framed = lines if "part" in lines.columns else frame_lines(lines)
    if len(formats) == 1:
        return framed.withColumn("log_type", F.lit(formats[0].name))
    if "log_type" in lines.columns:
        return framed
    return framed.withColumn("log_type", path_functions.log_type(F.col("filename")))


def match_lines(lines: DataFrame, formats: Sequence[LogFormat]) -> DataFrame:
    """Framed lines with ``_pieces``: as many as ``LAYOUT_PARTS`` for a match, else one, or null where the log
    type has no format."""
    typed = _typed(lines, formats)
    pieces = _per_type(
        formats, lambda f: layout_pieces(F.col("line"), f.pattern, f.layout), lambda f: (f.pattern, f.layout)
    )
    return typed.select("*", F.explode(F.array(pieces)).alias("_pieces"))


def is_match() -> Column:
    return F.coalesce(F.size("_pieces") == len(LAYOUT_PARTS), F.lit(False))


def _fields(matched: DataFrame, kept: Sequence[str]) -> DataFrame:
    piece = {name: F.col("_pieces")[position] for position, name in enumerate(LAYOUT_PARTS)}
    return matched.filter(is_match()).select(
        *kept,
        "log_type",
        piece["timestamp"].alias("timestamp"),
        empty_to_null(piece["hostname"]).alias("hostname"),
        piece["process"].alias("process"),
        empty_to_null(piece["pid"]).try_cast("bigint").alias("pid"),
        F.rtrim(piece["message"]).alias("message"),
        piece["action"].alias("action"),
    )


def _kept(matched: DataFrame, taken: Sequence[str]) -> list[str]:
    return [c for c in matched.columns if c not in taken and c not in ("line", "log_type", "action", "_pieces")]


def parse(lines: DataFrame, formats: LogFormat | Mapping[str, LogFormat]) -> DataFrame:
    """Records of the lines that match; other lines are dropped (see ``parse_rejects``).

    With one format every line is read by it. With several, a line is read by the format of its ``log_type``,
    which is taken from ``filename`` if there is no such column; all types share a single pass over the lines.
    The other columns of the framed lines follow the fourteen record fields.
    """
    chosen = [formats] if isinstance(formats, LogFormat) else list(formats.values())
    matched = match_lines(lines, chosen)
    kept = _kept(matched, RECORD_FIELDS)
    fields = _fields(matched, kept)
    lowered = fields.select(
        "*",
        F.lower("message").alias("message_lower"),
        F.lower("process").alias("process_lower"),
        F.lower("action").alias("action_lower"),
    )
    # All rule tables stand one after the other in three literal arrays; a rule's number is its place there.
    names = ("message", "process", "action")
    rule_fields = {n: F.col(n) for n in names} | {f"{n}_lower": F.col(f"{n}_lower") for n in names}
    starts, tables = {}, ([], [], [])
    for log_format in chosen:
        starts[log_format.name] = len(tables[0])
        for attribute in range(3):
            tables[attribute].extend(log_format.rules.values(attribute))
    rule = _per_type(chosen, lambda f: f.rules.number(rule_fields) + starts[f.name])
    ruled = lowered.select(*fields.columns, F.explode(F.array(rule)).alias("_rule"))

    def looked_up(attribute: int) -> Column:
        return F.element_at(F.array(*map(F.lit, tables[attribute])), F.col("_rule"))

    networked = [f.name for f in chosen if f.network]

    def network_field(extract: Callable[[Column], Column], kind: str) -> Column:
        if len(networked) == len(chosen):
            return extract(F.col("message"))
        if not networked:
            return F.lit(None).cast(kind)
        return F.when(F.col("log_type").isin(*networked), extract(F.col("message")))

    return ruled.select(
        "log_type",
        _per_type(chosen, lambda f: F.lit(f.source_file)).alias("source_file"),
        "timestamp",
        "hostname",
        "process",
        "pid",
        looked_up(2).alias("severity"),
        looked_up(0).alias("event"),
        looked_up(1).alias("event_type"),
        network_field(extract_user, "string").alias("user"),
        network_field(extract_ip, "string").alias("ip"),
        network_field(extract_port, "bigint").alias("port"),
        network_field(extract_protocol, "string").alias("protocol"),
        "message",
        *kept,
    )


def parse_auth(lines: DataFrame) -> DataFrame:
    return parse(lines, AUTH)


def parse_syslog(lines: DataFrame) -> DataFrame:
    return parse(lines, SYSLOG)


def parse_kern(lines: DataFrame) -> DataFrame:
    return parse(lines, KERN)


def parse_dpkg(lines: DataFrame) -> DataFrame:
    return parse(lines, DPKG)


def parse_dmesg(lines: DataFrame) -> DataFrame:
    return parse(lines, DMESG)


def parse_all(lines: DataFrame, formats: Mapping[str, LogFormat] = FORMATS) -> DataFrame:
    return parse(lines, formats)


def parse_header(lines: DataFrame) -> DataFrame:
    """Header fields alone: ``timestamp, hostname, process, pid, message`` and the other columns."""
    taken = ("timestamp", "hostname", "process", "pid", "message")
    matched = match_lines(lines, [SYSLOG])
    kept = _kept(matched, taken)
    return _fields(matched, kept).select(*taken, *kept)


def parse_rejects(lines: DataFrame, formats: LogFormat | Mapping[str, LogFormat] = FORMATS) -> DataFrame:
    """The framed lines that ``parse`` drops, with ``reason``: unsupported (no format for the log type) or
    unmatched."""
    chosen = [formats] if isinstance(formats, LogFormat) else list(formats.values())
    supported = F.col("log_type").isin(*[f.name for f in chosen])
    reason = F.when(supported, F.lit("unmatched")).otherwise(F.lit("unsupported"))
    return match_lines(lines, chosen).filter(~is_match()).withColumn("reason", reason).drop("_pieces")
