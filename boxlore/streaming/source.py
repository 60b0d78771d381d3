"""A streaming source of lines that are appended to files: offsets are bytes, so a file that grows is read on from where it was."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sinks.commit import DIGITS

#: Bytes of a file that one task reads.
SPLIT = 64 << 20
_BLOCK = 1 << 16
#: Bits of a position that count the bytes of an append or file; those above are the append's number or count a batch's files.
FILE_BITS = 40


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def _files(path: str) -> list[str]:
    """The journal's files: the path itself, or those in the folder but for hidden and marker files."""
    if os.path.isdir(path):
        return sorted(e.path for e in os.scandir(path) if e.is_file() and not e.name.startswith((".", "_")))
    return [path] if os.path.exists(path) else []


def _entries(path: str) -> list[int]:
    """The numbers of a journal folder's appends, which have no gap among them."""
    if not os.path.isdir(path):
        return []
    return sorted(int(e.name) for e in os.scandir(path) if e.is_dir() and len(e.name) == DIGITS and e.name.isdigit())


def _parts(path: str, number: int) -> list[str]:
    """The files of an append in the order in which it was written."""
    folder = os.path.join(path, f"{number:0{DIGITS}d}")
    return sorted(_files(folder), key=lambda p: (int((re.findall(r"part-(\d+)", os.path.basename(p)) or ["0"])[0]), p))


def whole_lines(path: str) -> int:
    """The number of bytes up to the end of the last ended line; a line that is still being written waits."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end:
            begin = max(0, end - _BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [begin, end); ``first`` is where the batch's lines of this file begin, ``base`` the position
    of its first byte."""

    path: str
    base: int
    first: int
    begin: int
    end: int


class JournalReader(DataSourceStreamReader):
    """Offsets: the number of the last append that was read, and by name of other files the bytes that were read and the file's
    time then, in nanoseconds."""

    def __init__(self, path: str, split: int = SPLIT):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"entry": 0, "files": {}}

    def latestOffset(self) -> dict:
        numbers = _entries(self.path)
        return {"entry": numbers[-1] if numbers else 0, "files": {os.path.basename(p): {"bytes": whole_lines(p), "at": os.stat(p).st_mtime_ns} for p in _files(self.path)}}

    def _spans(self, path: str, base: int, first: int, last: int) -> list[Span]:
        return [Span(path, base, first, a, min(last, a + self.split)) for a in range(first, last, self.split)]

    def partitions(self, start: dict, end: dict) -> list[Span]:
        grown, out = [], []
        for number in range(start.get("entry", 0) + 1, end.get("entry", 0) + 1):
            base = number << FILE_BITS
            for path in _parts(self.path, number):
                size = os.path.getsize(path)
                out += self._spans(path, base, 0, size)
                base += size
        for name, to in end["files"].items():
            had = start["files"].get(name, {"bytes": 0})["bytes"]
            if to["bytes"] < had:
                raise ValueError(f"{name} has shrunk: a journal is only appended to")
            if to["bytes"] > had:
                grown.append((to["at"], name, had, to["bytes"]))
        if grown and end.get("entry", 0):
            raise ValueError("a journal is a folder of numbered appends, or files that grow, not both")
        for turn, (_, name, first, last) in enumerate(sorted(grown)):
            out += self._spans(os.path.join(self.path, name) if os.path.isdir(self.path) else self.path, turn << FILE_BITS, first, last)
        return out

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        with open(partition.path, "rb") as f:
            at = partition.begin
            if at > partition.first:  # the line that goes on from the part before is that part's
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                yield partition.base + at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    """Options: path, a file or a folder that every executor reads by the same name."""

    @classmethod
    def name(cls) -> str:
        return "boxlore_journal"

    def schema(self) -> str:
        return "pos long, line string"

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(_local(self.options["path"]), int(self.options.get("split", SPLIT)))
