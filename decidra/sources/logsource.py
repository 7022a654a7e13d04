"""Log files as a data source of their own: `decision_log`.

Lines that match a pattern become typed rows, `None` and empty groups null, as readers.log_fields has it, but the files are read
here: in byte ranges of SPLIT, so that a long file is many tasks, with conditions on the columns checked before a row is made,
and as a stream whose offset is the number of whole lines' bytes taken of each file, so that files may grow between two runs.

Options: path (a folder or a file; a URI where the store is not the machine's own), pattern, and fields, names with types in order
of the pattern's groups as `name type, ...` with the types bigint, double and string. Lines end with a line feed;
a last line without one is a row of a batch, and of a stream once it has ended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SPLIT, CHUNK, ROWS = 32 << 20, 1 << 20, 10_000
_KINDS = {"bigint": (int, pa.int64()), "double": (float, pa.float64()), "string": (str, pa.string())}
_TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y, IsNotNull: lambda x, _: True}


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in these bytes."""

    path: str
    start: int
    stop: int


class Lines:
    """The files of a path and what their lines hold."""

    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], re.compile(options["pattern"])
        self.fields = [tuple(x.split()) for x in options["fields"].split(",")]
        self.tests: list[tuple[int, object, object]] = []

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def sizes(self) -> dict[str, int]:
        store, base = self.store()
        info = store.get_file_info(base)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        return {x.path: x.size for x in found if x.is_file and x.size and not x.base_name.startswith(("_", "."))}

    def lines(self, part: Range) -> Iterator[str]:
        """Lines that begin in the range; the one over its end is read to its own end."""
        store, _ = self.store()
        with store.open_input_file(part.path) as file:
            size = file.size()
            at = part.start - 1 if part.start else 0
            file.seek(at)
            held, first = b"", bool(part.start)
            while at < size:
                held += file.read(CHUNK)
                *whole, held = held.split(b"\n")
                at_next = file.tell()
                for line in whole:
                    if not first and at >= part.stop:
                        return
                    if not first:
                        yield line.decode()
                    first, at = False, at + len(line) + 1
                if at_next >= size:
                    break
            if held and not first and at < part.stop:
                yield held.decode()

    def value(self, text: str | None, kind: str):
        if text is None or text in ("", "None"):
            return None
        try:
            return _KINDS[kind][0](text)
        except ValueError:
            return None

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for line in self.lines(part):
            if found := self.pattern.search(line):
                row = [self.value(x, kind) for x, (_, kind) in zip(found.groups(), self.fields, strict=True)]
                if all(row[k] is not None and test(row[k], y) for k, test, y in self.tests):
                    rows.append(row)
            if len(rows) >= ROWS:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind][1]) for c, (_, kind) in zip(zip(*rows, strict=True), self.fields, strict=True)], names=[n for n, _ in self.fields])


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.source = Lines(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Conditions on one column are checked here; others go back."""
        names = [n for n, _ in self.source.fields]
        for f in filters:
            test = _TESTS.get(type(f))
            if test and len(f.attribute) == 1 and f.attribute[0] in names:
                self.source.tests.append((names.index(f.attribute[0]), test, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(n, a + SPLIT)) for p, n in sorted(self.source.sizes().items()) for a in range(0, n, SPLIT)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.source.batches(partition) if partition.path else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.source = Lines(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Bytes of each file up to the end of its last whole line."""
        store, _ = self.source.store()
        out = {}
        for path, size in self.source.sizes().items():
            with store.open_input_file(path) as file:
                end = size
                while end > 0:
                    begin = max(0, end - CHUNK)
                    file.seek(begin)
                    at = file.read(end - begin).rfind(b"\n")
                    if at >= 0:
                        out[path] = begin + at + 1
                        break
                    end = begin
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(p, a, min(n, a + SPLIT)) for p, n in sorted(end.items()) for a in range(start.get(p, 0), n, SPLIT)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for batch in self.source.batches(partition):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class DecisionLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "decision_log"

    def schema(self) -> str:
        return self.options["fields"]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format and hands conditions to it."""
    spark.dataSource.register(DecisionLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
