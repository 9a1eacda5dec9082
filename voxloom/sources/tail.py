"""A streaming data source that reads logs on from their last byte.

An offset holds, for each log, the byte after the last whole line that was read. Spark keeps offsets in
the checkpoint of the query, so that a restart goes on where the last finished batch ended, and each
line comes once. New bytes of a batch are cut into ranges, which tasks read side by side.

Logs grow, or, with a marker, count once they are finished: a log `x` is then read only when a file `x` + marker stands beside it,
and read anew when that marker is written again. The last line of a growing log waits for its end of line; that of a finished log does not.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, value string"
#: Bytes that a task reads, and that are read at once where the end of the last line is looked for.
RANGE_BYTES, STEP_BYTES = 32 << 20, 1 << 16
#: Between a log's path and the time of its marker, in the keys of offsets.
STAMP = "::"


def store_of(path: str) -> tuple[Any, str]:
    """The file system of a path, and the path in it."""
    import pyarrow.fs

    if "://" in path:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")


def end_of_lines(system, path: str, size: int, low: int) -> int:
    """The byte after the last end of line from `low` to `size`; `low` if there is none."""
    with system.open_input_file(path) as log:
        high = size
        while high > low:
            start = max(low, high - STEP_BYTES)
            found = log.read_at(high - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            high = start
    return low


@dataclass
class Range(InputPartition):
    """The lines of a log that start from byte `start` on and before `stop`; those of a finished log may end without an end of line."""

    path: str
    start: int
    stop: int
    first: int
    last: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.marker = options.get("marker", "")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where each log that is there ends now, in whole lines."""
        import pyarrow.fs

        system, root = store_of(self.path)
        files = {f.path: f for f in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file}
        ends = {}
        for path, info in sorted(files.items()):
            name = path.rsplit("/", 1)[-1]
            if not fnmatch.fnmatch(name, self.pattern) or (self.marker and name.endswith(self.marker)):
                continue
            if not self.marker:
                known = self.seen.get(path, 0)
                ends[path] = known if known == info.size else end_of_lines(system, path, info.size, known if known < info.size else 0)
            elif mark := files.get(path + self.marker):
                ends[f"{path}{STAMP}{mark.mtime_ns}"] = info.size
        self.seen = ends
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges of the new bytes; a log that has become shorter was written anew and is read from its start."""
        out = []
        for key, stop in end.items():
            first = start.get(key, 0)
            first = first if first <= stop else 0
            path = key.rsplit(STAMP, 1)[0] if self.marker else key
            out += [Range(path, a, min(a + self.range_bytes, stop), first, stop) for a in range(first, stop, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = store_of(self.path)
        with system.open_input_file(partition.path) as log:
            at = partition.start
            if at > partition.first:  # a line that began in the range before is that range's
                at = self.next_line(log, at - 1, partition.last)
            held, spot = b"", at
            while spot < partition.last and at < partition.stop:
                block = log.read_at(min(STEP_BYTES * 16, partition.last - spot), spot)
                if not block:
                    break
                spot += len(block)
                *lines, held = (held + block).split(b"\n")
                rows = []
                for line in lines:
                    if at >= partition.stop:
                        break
                    rows.append((at, line))
                    at += len(line) + 1
                yield from self.batch(partition.path, rows)
            if held and at < partition.stop and spot >= partition.last:
                yield from self.batch(partition.path, [(at, held)])

    @staticmethod
    def next_line(log, at: int, last: int) -> int:
        """The first byte after an end of line at `at` or later."""
        while at < last:
            block = log.read_at(min(STEP_BYTES, last - at), at)
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block) or last
        return last

    @staticmethod
    def batch(path: str, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        """The lines that are not blank, without the space around them; bytes that are no UTF-8 are left out."""
        kept = [(at, text) for at, line in rows if (text := line.decode("utf-8", "ignore").strip())]
        if kept:
            columns = [pa.array([path] * len(kept), pa.string()), pa.array([a for a, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "at", "value"])


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_log(spark: SparkSession, path: str, pattern: str = "*", marker: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of logs as a stream: `file`, the byte `at` which a line starts, and `value`."""
    spark.dataSource.register(Tail)
    reader = spark.readStream.format("tail").option("path", path).option("pattern", pattern).option("rangebytes", range_bytes)
    return (reader.option("marker", marker) if marker else reader).load()
