"""What a tail source has planned so far, in versions in a folder of its own, and how far the next batch may go."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark import cloudpickle

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Versions that stay behind the last finished one; a restarted query goes back by one batch.
KEPT_VERSIONS = 3


class ProgressLog:
    """Numbered states of a stream. An offset names a version and the stream, whatever the number of files."""

    def __init__(self, folder: str):
        if folder.startswith("file:"):
            folder = "/" + folder.removeprefix("file:").lstrip("/")
        if "://" in folder:
            self.files, self.folder = pafs.FileSystem.from_uri(folder)
        else:
            self.files, self.folder = pafs.LocalFileSystem(), folder
        self.files.create_dir(self.folder, recursive=True)
        self.stream = self._read("stream.json") or self._new_stream()

    def _new_stream(self) -> str:
        self._write("stream.json", uuid.uuid4().hex)
        return self._read("stream.json")

    def _read(self, name: str):
        try:
            with self.files.open_input_stream(f"{self.folder}/{name}") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def _write(self, name: str, value: object) -> None:
        """A name shows up with its whole content or not at all."""
        part = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as file:
            file.write(json.dumps(value).encode())
        self.files.move(part, f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        names = [info.base_name for info in self.files.get_file_info(pafs.FileSelector(self.folder))]
        return sorted(int(n.removesuffix(".state")) for n in names if n.endswith(".state") and not n.startswith("."))

    def write(self, version: int, state: dict, ranges: list[tuple[str, dict, int]]) -> dict:
        """Keep a state and what is read to reach it from the version before; gives the offset that names it."""
        self._write(f"{version:012d}.state", {"state": state, "ranges": ranges})
        return self.offset(version)

    def begin(self, version: int) -> None:
        """Note that a batch up to this version is being read."""
        if version > self.begun():
            self._write("begun.json", version)

    def begun(self) -> int:
        return self._read("begun.json") or 0

    def offset(self, version: int) -> dict:
        return {"version": version, "stream": self.stream}

    def read(self, offset: dict) -> tuple[dict, list[tuple[str, dict, int]]]:
        """The state and the ranges of the version that an offset names."""
        if offset["stream"] != self.stream:
            raise ValueError(f"{self.folder} belongs to another stream than the checkpoint")
        found = self._read(f"{offset['version']:012d}.state")
        if found is None:
            raise FileNotFoundError(f"{self.folder} has lost version {offset['version']}")
        return found["state"], [tuple(r) for r in found["ranges"]]

    def between(self, start: dict, end: dict) -> list[tuple[str, dict, int]]:
        """What is read from one version to another: as it was planned, whatever has been renamed since."""
        first = start["version"] + 1 if start else 1
        return [r for k in range(first, end["version"] + 1) for r in self.read({**end, "version": k})[1]]

    def forget(self, done: int) -> None:
        """Delete the versions well before one whose batch is finished."""
        for version in self.versions():
            if version < done - KEPT_VERSIONS:
                self.files.delete_file(f"{self.folder}/{version:012d}.state")


def line_cut(file, begin: int, room: int, end: int, block: int = 64 << 10) -> int:
    """The last position within ``room`` bytes of ``begin`` at which a line has ended, or else the next such position."""
    limit = at = min(begin + room, end)
    if limit == end:
        return end
    while at > begin:
        low = max(begin, at - block)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    at = limit
    while at < end:
        file.seek(at)
        data = file.read(min(block, end - at))
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not data:
            break
        at += len(data)
    return end


def limited(
    ranges: list[tuple[str, dict, int]],
    now: dict,
    max_bytes: int | None,
    max_files: int | None,
    cut: Callable[[dict, int, int], tuple[int, str]],
    check: Callable[[dict, int], str],
) -> tuple[dict, list[tuple[str, dict, int]]]:
    """The state that is reached when of the planned ranges only so much is read, and the ranges that are read for it.

    ``ranges`` has log, file and first position, those of a log in reading order. Logs come in the order of what waits
    longest in them; a log's later files wait for its earlier ones. A file that waits, or is left in its middle, stands in
    the state with the position up to which it was read. At least one range moves on. ``cut`` finds the end of a line
    within so many bytes, with a hash of what stands before it.
    """
    by_log: dict[str, list[tuple[dict, int]]] = {}
    for log, file, begin in ranges:
        by_log.setdefault(log, []).append((file, begin))
    left_bytes = max_bytes if max_bytes is not None else float("inf")
    left_files = max_files if max_files is not None else float("inf")
    reached: dict[tuple[str, str], tuple[int, str]] = {}
    for log, waiting in sorted(by_log.items(), key=lambda item: (item[1][0][0]["mtime"], item[0])):
        blocked = False
        for file, begin in waiting:
            size = file["end"] - begin
            if blocked or left_bytes <= 0 or left_files <= 0:
                reached[log, file["path"]] = (begin, check(file, begin))
                blocked = True
            elif size > left_bytes:
                end, seen = cut(file, begin, int(left_bytes))
                if end - begin > left_bytes < max_bytes:
                    # A line that goes beyond the room waits, unless it would be the first one read.
                    end, seen = begin, check(file, begin)
                reached[log, file["path"]] = (end, seen)
                left_bytes, blocked = 0, True
            else:
                left_bytes -= size
                left_files -= 1
    state = {}
    for log, entry in now.items():
        files = {}
        for place, file in entry["files"].items():
            end, seen = reached.get((log, file["path"]), (file["end"], file["check"]))
            files[place] = {**file, "end": end, "check": seen}
        state[log] = {"files": files, "current": entry["current"]}
    paths = {(log, file["path"]): file for log, entry in state.items() for file in entry["files"].values()}
    read = [(log, paths[log, file["path"]], begin) for log, file, begin in ranges]
    return state, [r for r in read if r[2] < r[1]["end"]]
