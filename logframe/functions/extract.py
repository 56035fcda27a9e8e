"""First-match extractors for authentication messages. No match gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import empty_to_null

# What each field looks like.
USER_PATTERN = r"(?U)for[\s\x1c-\x1f]+(?:invalid[\s\x1c-\x1f]+user[\s\x1c-\x1f]+|user[\s\x1c-\x1f]+)?([^\s\x1c-\x1f(]+)"
IP_PATTERN = r"(?U)from[\s\x1c-\x1f]+(\d{1,3}(?:\.\d{1,3}){3})"
PORT_PATTERN = r"(?U)port[\s\x1c-\x1f]+(\d+)"
PROTOCOL_PATTERN = r"(?<![\p{L}\p{N}_])(ssh2|ssh)(?![\p{L}\p{N}_])"


def _first(message: Column, keyword: str, pattern: str) -> Column:
    # The substring test spares the pattern for messages that cannot match.
    found = F.regexp_extract(message, pattern, 1)
    return F.when(F.contains(message, F.lit(keyword)), empty_to_null(found))


def extract_user(message: Column) -> Column:
    return _first(message, "for", USER_PATTERN)


def extract_ip(message: Column) -> Column:
    return _first(message, "from", IP_PATTERN)


def extract_port(message: Column) -> Column:
    """Null beyond the range of bigint."""
    return _first(message, "port", PORT_PATTERN).try_cast("bigint")


def extract_protocol(message: Column) -> Column:
    return _first(message, "ssh", PROTOCOL_PATTERN)
