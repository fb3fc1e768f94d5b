"""A streaming source of the lines that are appended to log files, and the listing of task files.

An offset names each file by its identity (device and inode, and the digest of its first bytes) and holds its path and how many bytes of whole lines
have been read. So a file that is renamed goes on where it was, a new file under the old name starts at 0, and so does one
that was cut shorter. Partitions are ranges of at most ``PIECE`` bytes; the line that a range cuts belongs to the range in which it starts. Offsets are Spark's
checkpoint: a restart reads the planned ranges again and loses and repeats nothing. Driver and executors must see the files under the same paths.
"""

from __future__ import annotations

import glob
import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 64 << 20
HEAD = 64
MOST = 2000


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def whole_lines(f, start: int, end: int) -> int:
    """Where the last whole line before ``end`` ends, ``start`` at least; read backwards in steps."""
    at = end
    while at > start:
        step = max(start, at - 65_536)
        f.seek(step)
        cut = f.read(at - step).rfind(b"\n")
        if cut >= 0:
            return step + cut + 1
        at = step
    return start


def identity(f, length: int = HEAD) -> str:
    s = os.fstat(f.fileno())
    f.seek(0)
    return f"{s.st_dev}:{s.st_ino}:{length}:{hashlib.md5(f.read(length)).hexdigest()}"


def same(f, name: str) -> bool:
    return identity(f, int(name.split(":")[2])) == name


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, piece: int):
        self.pattern, self.piece = pattern, piece
        self.known: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """What the files hold now, from what was told before: identity -> [path, bytes]."""
        out = {}
        for path in sorted(glob.glob(self.pattern)):
            try:
                with open(path, "rb") as f:
                    size = os.fstat(f.fileno()).st_size
                    name = next((n for n in self.known if n not in out and same(f, n) and size >= self.known[n][1]), None)
                    at = self.known[name][1] if name else 0
                    end = whole_lines(f, at, size)
                    if end:
                        out[name or identity(f, min(HEAD, end))] = [path, end]
            except FileNotFoundError:
                continue
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = self.known or end
        found = []
        for name, (path, stop) in end.items():
            first = start.get(name, [path, 0])[1]
            found += [Range(path, a, min(stop, a + self.piece)) for a in range(first, stop, self.piece)]
        return found

    def read(self, part: Range):
        with open(part.path, "rb") as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at = at - 1 + len(f.readline())  # the rest of the line that started before
            f.seek(at)
            while at < part.end and (line := f.readline()):
                yield os.path.basename(part.path), at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class TailSource(DataSource):
    """spark.readStream.format("line_tail").option("path", pattern).load(): file, at, line."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], int(self.options.get("piece", PIECE)))


def tail(spark: SparkSession, pattern: str, piece: int = PIECE) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("line_tail").option("path", pattern).option("piece", piece).load()


def task_files(spark: SparkSession, root: str, most: int = MOST) -> DataFrame:
    """path (relative), size, modified of the first ``most`` files below a folder, by path. Linked files and folders are left out."""

    def below(folder: str, prefix: str):
        with os.scandir(folder) as found:
            for x in sorted(found, key=lambda x: x.name):
                if x.is_symlink():
                    continue
                if x.is_dir(follow_symlinks=False):
                    yield from below(x.path, f"{prefix}{x.name}/")
                elif x.is_file(follow_symlinks=False):
                    s = x.stat(follow_symlinks=False)
                    yield f"{prefix}{x.name}", s.st_size, s.st_mtime

    rows = []
    for row in below(root, ""):
        if len(rows) == most:  # the listing's own bound
            break
        rows.append(row)
    return spark.createDataFrame(rows, "path string, size long, modified double")
