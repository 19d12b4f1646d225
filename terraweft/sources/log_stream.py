"""A streaming source of growing text files: format `terraweft_log`.

An offset is, for each file of a folder, the bytes up to its last line end: a line without its end is still being written and
is left for a later trigger. A trigger's new bytes are planned as ranges of at most `rangeBytes`; a range reads the lines
that begin in it, so that every line is read once, by one task, however the ranges fall. A task reads many small ranges, so
that tasks follow the bytes and not the number of files; a file that has not grown is not opened again. Offsets are kept in
the query's checkpoint; a restarted query reads the same ranges again or goes on behind them.

Files may grow or be replaced by longer ones of the same beginning; a file that has become shorter is an error. The folder is
any that pyarrow can open (a local or shared path, or the URI of a store), seen by the driver and the executors alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from terraweft.session import sent_whole

SCHEMA = "log string, offset long, line string"
#: Bytes of a range, and of a block when a file's last line end is looked for.
RANGE_BYTES, BLOCK = 8 << 20, 1 << 16
#: Bytes and ranges of a task, about.
TASK_BYTES, TASK_RANGES = 1 << 20, 1_000
#: Files whose last line end is looked for at a time.
OPENED = 16
#: Lines of one batch.
BATCH = 10_000


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Range:
    """Bytes of a file: lines that begin in [start, end) are read; `first` is where the trigger's new bytes begin."""

    log: str
    first: int
    start: int
    end: int


@dataclass
class Task(InputPartition):
    ranges: list[Range]


def packed(ranges: list[Range]) -> list[Task]:
    """Ranges in order as tasks of TASK_BYTES and TASK_RANGES, about."""
    out, held = [], 0
    for r in ranges:
        if not out or held >= TASK_BYTES or len(out[-1].ranges) >= TASK_RANGES:
            out.append(Task([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.end - r.start
    return out


def last_line_end(file, size: int, known: int = 0) -> int:
    """The offset behind the last line end of a file's first `size` bytes; `known` where nothing behind it ends a line."""
    at = size
    while at > known:
        low = max(known, at - BLOCK)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return known


def lines_of(file, first: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); file is at any place."""
    at = start
    file.seek(max(first, start - 1))
    if start > first:  # the line that the byte before start belongs to is the previous range's
        skipped = file.readline()
        at = start - 1 + len(skipped)
    while at < end:
        line = file.readline()
        if not line.endswith(b"\n"):
            return
        yield at, line[:-1]
        at += len(line)


class LogReader(DataSourceStreamReader):
    def __init__(self, folder: str, range_bytes: int) -> None:
        self.folder, self.range_bytes = folder, range_bytes
        #: Of each file the size that was looked at, and the offset behind its last line end.
        self.seen: dict[str, tuple[int, int]] = {}

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        store, root = _opened(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path[len(root) :].lstrip("/"): f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        import io
        from concurrent.futures import ThreadPoolExecutor

        store, root = _opened(self.folder)

        def end(log: str, size: int) -> int:
            before, known = self.seen.get(log, (0, 0))
            known = min(size, known)
            if size != before and size > known:
                with store.open_input_file(f"{root}/{log}") as f:
                    known = last_line_end(io.BufferedReader(f, BLOCK), size, known)
            return known

        files = sorted(self._files().items())
        with ThreadPoolExecutor(OPENED) as pool:
            ends = list(pool.map(lambda f: end(*f), files))
        self.seen = {log: (size, known) for (log, size), known in zip(files, ends, strict=True)}
        return {log: known for log, (_, known) in self.seen.items() if known}

    def partitions(self, start: dict, end: dict) -> Sequence[Task]:
        out: list[Range] = []
        for log, upto in end.items():
            first = start.get(log, 0)
            if upto < first:
                raise ValueError(f"{log} has become shorter: {upto} bytes of whole lines after {first}")
            out += [Range(log, first, at, min(upto, at + self.range_bytes)) for at in range(first, upto, self.range_bytes)]
        return packed(out)

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        import io

        store, root = _opened(self.folder)
        held: list[tuple[str, int, str]] = []
        for part in partition.ranges:
            with store.open_input_file(f"{root}/{part.log}") as raw:
                for at, line in lines_of(io.BufferedReader(raw, BLOCK), part.first, part.start, part.end):
                    held.append((part.log, at, line.decode("utf-8", "replace")))
                    if len(held) >= BATCH:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(held: list[tuple[str, int, str]]) -> pa.RecordBatch:
        logs, at, lines = zip(*held, strict=True)
        return pa.record_batch([pa.array(logs, pa.string()), pa.array(at, pa.int64()), pa.array(lines, pa.string())], ["log", "offset", "line"])


class LogSource(DataSource):
    """options: path (folder), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "terraweft_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def stream(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES):
    """log (path below the folder), offset (of the line, in bytes) and line, as a streaming frame."""
    with sent_whole(__name__):
        spark.dataSource.register(LogSource)
    return spark.readStream.format("terraweft_log").option("path", folder).option("rangeBytes", range_bytes).load()
