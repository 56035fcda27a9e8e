"""File metadata read off a path."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import empty_to_null

# Name prefixes, each naming its log type, in order of precedence.
LOG_TYPES = ("auth", "syslog", "kern", "dpkg", "dmesg", "apache", "nginx", "docker", "apport")
UNKNOWN_TYPE = "unknown"


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The parent path: ``.`` for a bare name, ``/`` for a name at the root."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    at_root = F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    return F.when(parent != "", parent).otherwise(at_root)


def suffix(name: Column) -> Column:
    """The last dot and what follows; empty without one, with nothing before it, or with nothing after it."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def log_type(name: Column) -> Column:
    lowered = F.lower(name)
    return F.coalesce(*[F.when(F.startswith(lowered, F.lit(p)), F.lit(p)) for p in LOG_TYPES], F.lit(UNKNOWN_TYPE))


def is_compressed(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".gz"))


def rotation(name: Column) -> Column:
    """The number after the last dot, before an optional lower-case ``.gz``; 0 without one."""
    number = F.regexp_extract(name, r"(?U)\.(\d+)(?:\.gz)?$", 1)
    return F.when(number == "", F.lit(0).cast("bigint")).otherwise(empty_to_null(number).try_cast("bigint"))


def extension(name: Column) -> Column:
    return F.when(is_compressed(name), F.lit(".gz")).otherwise(suffix(name))


def reader(name: Column) -> Column:
    return F.when(is_compressed(name), F.lit("gzip")).otherwise(F.lit("file"))
