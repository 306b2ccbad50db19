"""Captured commit logs as a data source: ``spark.read.format("commitlog").load(path)``, and as a stream.

A log is cut into byte ranges; a range's task reads the records that begin in it, up to the next record's head. So
one very large log is read by many tasks, each of which holds a record at a time. Comparisons on a record's head (hash, author,
date, message) can be pushed into the reader, which then doesn't build what they leave out. A stream remembers
how far each log has been read, and goes on from there after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

HEAD = b"COMMIT|"
FIELDS = ("hash", "author", "date", "message")
SCHEMA = "log string, hash string, author string, date string, message string, files array<struct<path:string,added:int,deleted:int>>"
_ARROW = pa.schema([("log", pa.string()), *((f, pa.string()) for f in FIELDS), ("files", pa.list_(pa.struct([("path", pa.string()), ("added", pa.int32()), ("deleted", pa.int32())])))])
#: Bytes of a range, of a read, and records of a batch.
SPLIT, READ, BATCH = 32 << 20, 1 << 20, 2048


@dataclass
class Range(InputPartition):
    """The records whose heads begin at ``start`` or later and before ``end``; nothing is read from ``stop`` on."""

    path: str
    start: int
    end: int
    stop: int | None = None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def logs(path: str) -> list[tuple[str, int]]:
    """(path, size) of a log, or of all logs in a folder and below; hidden files and markers are none."""
    system, at = opened(path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f"{scheme}{f.path}" if scheme not in ("", "file://") else f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def lines(path: str, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at ``start`` or later, without their ends."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        f.seek(max(start - 1, 0))
        offset, rest, skip = max(start - 1, 0), b"", start > 0
        while True:
            want = READ if stop is None else min(READ, stop - offset - len(rest))
            more = f.read(want) if want > 0 else b""
            whole = (rest + more).split(b"\n")
            rest = whole.pop() if more else b""
            for line in whole:
                if skip:
                    skip = False  # the rest of a line that began before
                else:
                    yield offset, line.removesuffix(b"\r")
                offset += len(line) + 1
            if not more:
                return


def records(part: Range, keep: Sequence[Filter] = ()) -> Iterator[dict]:
    """The records of a range whose heads pass the filters."""
    now, tests = None, [_test(f) for f in keep]
    for offset, line in lines(part.path, part.start, part.stop):
        if line.startswith(HEAD):
            if now:
                yield now
            if offset >= part.end:
                return
            fields = line.decode("utf-8", "replace").split("|")[1:]
            head = {"hash": fields[0], "author": fields[1] if len(fields) > 1 else None, "date": fields[2] if len(fields) > 2 else None, "message": "|".join(fields[3:])}
            now = {"log": part.path} | head | {"files": []} if head["hash"] and all(t(head) for t in tests) else None
        elif now is not None and line.count(b"\t") >= 2:
            added, deleted, path = line.decode("utf-8", "replace").split("\t", 2)
            now["files"].append({"path": path, "added": _count(added), "deleted": _count(deleted)})
        elif offset >= part.end and now is None:
            return
    if now:
        yield now


def _count(x: str) -> int:
    """A number, 0 for anything else."""
    try:
        n = int(x)
    except ValueError:
        return 0
    return n if -(2**31) <= n < 2**31 else 0


def _test(f: Filter):
    name = f.attribute[0]
    if isinstance(f, IsNotNull):
        return lambda head: head[name] is not None
    value = f.value
    compare = {EqualTo: str.__eq__, GreaterThan: str.__gt__, GreaterThanOrEqual: str.__ge__, LessThan: str.__lt__, LessThanOrEqual: str.__le__, StringStartsWith: str.startswith}.get(type(f))
    if compare:
        return lambda head: head[name] is not None and compare(head[name], value)
    return lambda head: head[name] in value  # In


def _known(f: Filter) -> bool:
    """Whether the reader can decide a filter: comparisons of a head's field with texts, in an order that is the bytes' own."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in FIELDS:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return all(isinstance(v, str) for v in f.value)
    ordered = isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
    # Python compares code points, Spark UTF-8 bytes: the same order.
    return isinstance(getattr(f, "value", None), str) and (ordered or isinstance(f, (EqualTo, StringStartsWith)))


def _batches(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in found:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _ranges(path: str, start: int, end: int, split: int, stop: int | None = None) -> list[Range]:
    return [Range(path, at, min(at + split, end), stop) for at in range(start, end, split)]


class LogReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.keep = path, split, []

    def partitions(self) -> list[Range]:
        return [r for path, size in logs(self.path) for r in _ranges(path, 0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(records(partition, self.keep)) if partition.path else iter(())


class FilteringReader(LogReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _known(f):
                self.keep.append(f)
            else:
                yield f


class LogStreamReader(DataSourceStreamReader):
    """Offsets are the bytes read of each log, up to the end of a line; logs grow by whole records."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"logs": "{}"}

    def latestOffset(self) -> dict:
        return {"logs": json.dumps({path: _whole_lines(path, size) for path, size in logs(self.path)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["logs"]), json.loads(end["logs"])
        return [r for path, size in after.items() for r in _ranges(path, before.get(path, 0), size, self.split, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(records(partition)) if partition.path else iter(())


def _whole_lines(path: str, size: int) -> int:
    """Where the last line that has an end ends."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        end = size
        while end > 0:
            lo = max(0, end - READ)
            f.seek(lo)
            found = f.read(end - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            end = lo
    return 0


class CommitLog(DataSource):
    """Options: the path of a log or of a folder of logs; ``splitBytes``, the length of a range; ``pushFilters``, to have the
    reader filter. Spark keeps what was pushed for as long as the DataFrame that was loaded lives, also for queries that push
    nothing: load anew for each query with that option.
    """

    @classmethod
    def name(cls) -> str:
        return "commitlog"

    def schema(self) -> str:
        return SCHEMA

    def _how(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT)))

    def reader(self, schema) -> LogReader:
        push = self.options.get("pushfilters", self.options.get("pushFilters", "false")).lower() == "true"
        return (FilteringReader if push else LogReader)(*self._how())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(*self._how())


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters where a reader takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLog)
