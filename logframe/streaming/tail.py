"""A streaming source that follows growing, rotating log files.

The offset of the stream is, per log, the list of its files from the oldest to the newest, each with its identity, the
byte position up to which it may be read, and a hash of the bytes before that position; one of them may be the
current file. Files are known by identity and those bytes, not by name, so a rename does not lose the place, a new file
that begins like the old one is told from it, and a batch that is replayed after a rename reads the same bytes. A log
whose current file is absent, or too short to be told from others yet, stays in the offset by its renamed files.
"""

from __future__ import annotations

import fnmatch
import hashlib
import logging
import os
import re
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .progress import ProgressLog, limited, line_cut

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "log_tail"
SCHEMA = "log_path string, file_id string, segment int, byte_offset bigint, line string"

_BLOCK = 4 << 20
_FIRST_LINE_BYTES = 64 << 10
_CHECK_BYTES = 4 << 10


class LogStore:
    """Lists and opens log files on a local or shared disk or, by URI, on any file system Arrow knows."""

    def __init__(self, pattern: str, identity: str | None = None):
        if pattern.startswith("file:"):
            pattern = "/" + pattern.removeprefix("file:").lstrip("/")
        self.local = "://" not in pattern
        self.identity = identity or ("inode" if self.local else "first_line")
        if self.identity not in ("inode", "first_line") or (self.identity == "inode" and not self.local):
            raise ValueError(f"identity {self.identity!r} does not suit {pattern!r}")
        fixed = re.split(r"[*?\[]", pattern, maxsplit=1)[0].rsplit("/", 1)[0] or "/"
        if self.local:
            self.files, self.base, self.pattern = pafs.LocalFileSystem(), fixed, pattern
        else:
            self.files, self.base = pafs.FileSystem.from_uri(fixed)
            self.pattern = self.base + pattern[len(fixed) :]

    def logs(self) -> dict[str, list[pafs.FileInfo]]:
        """The files of each log, oldest first, the current one last if it is there.

        A log is named by the pattern. Its other files are those whose names start with its name; where its current
        file is absent, it is known by files whose names go on behind a dot or a dash.
        """
        parts = self.pattern.split("/")
        selector = pafs.FileSelector(self.base, allow_not_found=True, recursive=self.base.count("/") + 2 < len(parts))
        folders: dict[str, dict[str, pafs.FileInfo]] = {}
        for info in self.files.get_file_info(selector):
            if info.type == pafs.FileType.File and not info.path.endswith(".gz"):
                folder, name = info.path.rsplit("/", 1)
                # As in a shell, hidden files are none of a pattern's; file systems keep checksums in them.
                if name.startswith(".") and not parts[-1].startswith("."):
                    continue
                folders.setdefault(folder, {})[name] = info
        found = {}
        for folder, infos in folders.items():
            above = folder.split("/")
            if len(above) + 1 != len(parts) or not all(map(fnmatch.fnmatchcase, above, parts)):
                continue
            names = sorted(infos)
            logs = {name for name in names if fnmatch.fnmatchcase(name, parts[-1])}
            for name in names:
                if name not in logs:
                    cuts = (name[: cut.start()] for cut in re.finditer(r"[.-]", name))
                    logs.update(cut for cut in cuts if cut and fnmatch.fnmatchcase(cut, parts[-1]))
            for log in logs:
                others, at = [], bisect_left(names, log)
                while at < len(names) and names[at].startswith(log):
                    if names[at] != log:
                        others.append(infos[names[at]])
                    at += 1
                others.sort(key=lambda i: (i.mtime_ns or 0, i.path))
                found[f"{folder}/{log}"] = others + ([infos[log]] if log in infos else [])
        return found

    def open(self, path: str):
        return open(path, "rb") if self.local else self.files.open_input_file(path)

    def identify(self, file) -> str | None:
        """The identity of an open file; None as long as it holds less than what identifies it."""
        if self.identity == "inode":
            stat = os.fstat(file.fileno())
            return f"{stat.st_dev}:{stat.st_ino}"
        file.seek(0)
        head = file.read(_FIRST_LINE_BYTES)
        line, found, _ = head.partition(b"\n")
        if not found and len(head) < _FIRST_LINE_BYTES:
            return None
        return hashlib.blake2b(line, digest_size=16).hexdigest()

    def holds(self, path: str, end: int, check: str) -> bool:
        """Whether a file has bytes up to this position, and those before it are the ones that were seen."""
        try:
            with self.open(path) as file:
                return file.seek(0, os.SEEK_END) >= end and bytes_before(file, end) == check
        except FileNotFoundError:
            return False

    def open_known(self, path: str, log: str, identity: str, end: int, check: str):
        """Open the file with this identity and these bytes before ``end``: under the path it was seen at, or else
        among the log's files."""

        def candidates() -> Iterator[str]:
            yield path
            # Only a file that is no longer there is looked for.
            infos = self.files.get_file_info(pafs.FileSelector(log.rsplit("/", 1)[0]))
            yield from (i.path for i in infos if i.path.startswith(log) and i.path != path and not i.path.endswith(".gz"))

        for candidate in candidates():
            try:
                file = self.open(candidate)
            except FileNotFoundError:
                continue
            if self.identify(file) == identity and file.seek(0, os.SEEK_END) >= end and bytes_before(file, end) == check:
                return file
            file.close()
        raise FileNotFoundError(f"{path} is gone before its lines were read (file {identity} of {log})")


def bytes_before(file, end: int) -> str:
    """A hash of the last bytes before a position."""
    start = max(0, end - _CHECK_BYTES)
    file.seek(start)
    return hashlib.blake2b(file.read(end - start), digest_size=16).hexdigest()


def complete_end(file, size: int) -> int:
    """The position behind the last line feed."""
    end = size
    while end > 0:
        start = max(0, end - _FIRST_LINE_BYTES)
        file.seek(start)
        found = file.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


@dataclass
class ByteRange(InputPartition):
    """Lines that begin in [low, high) of a file's bytes [begin, end)."""

    log: str
    path: str
    file_id: str
    segment: int
    begin: int
    end: int
    low: int
    high: int
    check: str = ""


def same_files(known: list[dict], chain: list[dict], holds: Callable[[str, int, str], bool]) -> dict[int, dict]:
    """Which files of a chain were known before: place to what was known.

    The identity must be the same, and the bytes before the known position. Of several such files the oldest is it. A
    file of another identity with these bytes is a copy from before the file was emptied, if nothing else is left of it.
    """
    matched: dict[int, dict] = {}
    for same_id in (True, False):
        for old in known:
            if any(old is m for m in matched.values()) or not (same_id or old["end"]):
                continue
            for place, file in enumerate(chain):
                if place in matched or (file["id"] == old["id"]) != same_id or file["end"] < old["end"]:
                    continue
                unchanged = (file["end"], file["check"]) == (old["end"], old["check"])
                if unchanged or holds(file["path"], old["end"], old["check"]):
                    matched[place] = old
                    break
    return matched


def plan_ranges(
    start: dict, end: dict, holds: Callable[[str, int, str], bool] = lambda *_: False, rotated_names: str = ""
) -> list[tuple[str, dict, int]]:
    """What to read between two offsets: log, file, and the position to read it from, in reading order."""
    ranges = []
    for log, now in end.items():
        chain, current = list(now["files"].values()), now["current"]
        if log not in start:
            # At first only the current file is read.
            ranges += [(log, f, 0) for f in chain if f["path"] == current]
            continue
        known = list(start[log]["files"].values())
        matched = same_files(known, chain, holds)
        newest = max((f["mtime"] for f in known), default=0)
        if any(not any(old is m for m in matched.values()) and old["path"] == start[log]["current"] for old in known):
            logging.getLogger(__name__).warning("%s: the file read last is gone, and with it what was added to it", log)
        for place, f in enumerate(chain):
            if place in matched:
                ranges.append((log, f, matched[place]["end"]))
            elif f["path"] == current:
                ranges.append((log, f, 0))
            elif f["mtime"] >= newest and re.search(rotated_names, f["path"]):
                # It came and went since; unless it is a copy of a file that is read anyway.
                others = [g for k, g in enumerate(chain) if k in matched and g["end"] >= f["end"] > 0]
                if not any(holds(g["path"], f["end"], f["check"]) for g in others):
                    ranges.append((log, f, 0))
    return [r for r in ranges if r[2] < r[1]["end"]]


def read_range(file, part: ByteRange) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Line positions and texts, block by block. Bytes that are not UTF-8 are dropped."""
    position = part.low
    if part.low > part.begin:
        # The line that spans the boundary belongs to the range before.
        position -= 1
        file.seek(position)
        while True:
            block = file.read(min(_BLOCK, part.end - position))
            found = block.find(b"\n")
            if found >= 0:
                position += found + 1
                break
            if not block:
                return
            position += len(block)
    file.seek(position)
    at, pending, size = position, [], 0
    while position < part.high:
        block = file.read(min(_BLOCK, part.end - at))
        at += len(block)
        cut = block.rfind(b"\n") + 1
        if block and not cut:
            pending.append(block)
            size += len(block)
            continue
        data = b"".join(pending) + (block[:cut] if block else b"")
        if not data:
            return
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        starts = position + np.concatenate(([0], breaks[breaks < len(data)])).astype(np.int64)
        taken = int(np.searchsorted(starts, part.high))
        yield starts[:taken], data.decode("utf-8", "ignore").split("\n")[:taken]
        if not block:
            return
        position += size + cut
        pending, size = [block[cut:]], len(block) - cut


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.store = LogStore(options["path"], options.get("identity"))
        self.split_bytes = int(options.get("splitbytes", 128 << 20))
        self.rotated_names = options.get("rotatednames", "")
        self.max_bytes, self.max_files = (int(options[k]) if options.get(k) else None for k in ("maxbytes", "maxfiles"))
        self.progress = ProgressLog(options["progress"]) if options.get("progress") else None
        self.looked_at: dict[tuple, dict] = {}
        self.planned: tuple[int, dict] | None = None

    def __getstate__(self) -> dict:
        # Tasks need neither what the driver has seen nor where it keeps it.
        return {**self.__dict__, "looked_at": {}, "planned": None, "progress": None}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if not self.progress:
            return self._latest_state()
        if self.planned is None:
            last = max(self.progress.versions(), default=None)
            self.planned = (0, {}) if last is None else (last, self.progress.read(self.progress.offset(last))[0])
            if last is not None and last > self.progress.begun():
                # Planned by a run that ended before it was read.
                return self.progress.offset(last)
        version, start = self.planned
        state, ranges = self._next_state(start)
        if state == start:
            return self.progress.offset(version) if version else {}
        self.planned = (version + 1, state)
        return self.progress.write(version + 1, state, ranges)

    def _next_state(self, start: dict) -> tuple[dict, list]:
        now = self._latest_state()
        ranges = plan_ranges(start, now, self.store.holds, self.rotated_names)

        def check(file: dict, end: int) -> str:
            with self.store.open(file["path"]) as opened:
                return bytes_before(opened, end)

        def cut(file: dict, begin: int, room: int) -> tuple[int, str]:
            with self.store.open(file["path"]) as opened:
                end = line_cut(opened, begin, room, file["end"])
                return end, bytes_before(opened, end)

        return limited(ranges, now, self.max_bytes, self.max_files, cut, check)

    def _ranges(self, start: dict, end: dict) -> list[tuple[str, dict, int]]:
        if "version" not in end:
            if "version" in start:
                raise ValueError("the checkpoint was made with a progress folder: give it again")
            return plan_ranges(start, end, self.store.holds, self.rotated_names)
        if start and "version" not in start:
            # A checkpoint from before there was a progress folder: what was planned from nothing is planned from there.
            state, ranges = self._next_state(start)
            self.progress.write(end["version"], state, ranges)
            self.planned = (end["version"], state)
        else:
            ranges = self.progress.between(start, end)
        self.progress.begin(end["version"])
        return ranges

    def commit(self, end: dict) -> None:
        if self.progress and "version" in end:
            self.progress.forget(end["version"])

    def _latest_state(self) -> dict:
        logs = self.store.logs()
        # Files that stayed as they were since the last call are not opened again.
        keys = {(i.path, i.size, i.mtime_ns, i.path in logs) for infos in logs.values() for i in infos}
        with ThreadPoolExecutor(16) as pool:
            fresh = [key for key in keys if key not in self.looked_at]
            found = dict(zip(fresh, pool.map(self._look_at, fresh)))
        self.looked_at = {key: self.looked_at.get(key) or found.get(key) for key in keys}
        offset = {}
        for log, infos in logs.items():
            chain = [self.looked_at[i.path, i.size, i.mtime_ns, i.path in logs] for i in infos]
            chain = [file for file in chain if file]
            if chain:
                files = {f"{place:06d}": file for place, file in enumerate(chain)}
                offset[log] = {"files": files, "current": log if chain[-1]["path"] == log else None}
        return offset

    def _look_at(self, key: tuple) -> dict | None:
        path, _, mtime, is_current = key
        try:
            with self.store.open(path) as file:
                identity = self.store.identify(file)
                size = file.seek(0, os.SEEK_END)
                # The current file may end in half a line, which has to wait. A rotated file is finished.
                end = complete_end(file, size) if is_current else size
                check = bytes_before(file, end)
        except FileNotFoundError:
            return None
        return None if identity is None else {"id": identity, "path": path, "end": end, "check": check, "mtime": mtime or 0}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        parts, segments = [], {}
        for log, file, begin in self._ranges(start, end):
            segment = segments[log] = segments.get(log, -1) + 1
            stop = file["end"]
            for low in range(begin, stop, self.split_bytes):
                high = min(low + self.split_bytes, stop)
                parts.append(ByteRange(log, file["path"], file["id"], segment, begin, stop, low, high, file["check"]))
        return parts

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        with self.store.open_known(
            partition.path, partition.log, partition.file_id, partition.end, partition.check
        ) as file:
            for starts, lines in read_range(file, partition):
                n = len(lines)
                columns = [
                    pa.array([partition.log] * n, pa.string()),
                    pa.array([partition.file_id] * n, pa.string()),
                    pa.array(np.full(n, partition.segment, np.int32)),
                    pa.array(starts),
                    pa.array(lines, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["log_path", "file_id", "segment", "byte_offset", "line"])


class TailDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def register_tail_source(spark: SparkSession) -> None:
    spark.dataSource.register(TailDataSource)


def tail_logs(
    spark: SparkSession,
    path: str,
    split_bytes: int | None = None,
    identity: str | None = None,
    rotated_names: str | None = None,
    max_bytes: int | None = None,
    max_files: int | None = None,
    progress: str | None = None,
) -> DataFrame:
    """A stream of the lines added to the logs that match ``path``: a current file's path or a pattern of such.

    At first a log's current file is read in full. From then on each batch brings what was added, and after a
    rotation what the renamed file still had, files rotated in between, and the new file; also if a batch falls
    between renaming the old file and creating the new one. ``segment`` and ``byte_offset`` order the lines that a batch has
    of a log. ``split_bytes`` is how much of a file one task reads.

    With ``progress``, a folder that this stream alone uses, offsets name versions of its state there and stay small however
    many files there are; a checkpoint from before can be continued with one, but not the other way. It is needed for
    limits: a batch then reads about ``max_bytes``, to the end of a line, and whole files up to ``max_files``, what has
    waited longest first. Sources of this kind are asked once in a run with ``availableNow``, which so ends after one
    batch; other triggers go on.

    Files are identified by inode, or by their first line (``identity="first_line"``) where the file system has none, and
    by the last bytes that were read of them. Files rotated in between are all those with the log's name in front that are
    not older than what was read last, other than copies of files that are read anyway; ``rotated_names``, a regular
    expression, limits them by path. Progress is kept in the query's checkpoint. A file that is gone before the rest of it
    was read fails the batch, or, if it went between two batches, is reported in the driver's log.
    """
    register_tail_source(spark)
    stream = spark.readStream.format(FORMAT).option("path", path)
    if (max_bytes or max_files) and not progress:
        raise ValueError("limits need a folder for the progress")
    options = {"splitBytes": split_bytes, "identity": identity, "rotatedNames": rotated_names}
    options |= {"maxBytes": max_bytes, "maxFiles": max_files, "progress": progress}
    for name, value in options.items():
        if value:
            stream = stream.option(name, str(value))
    return stream.load()
