"""Tables of JSON lines that a crash can't spoil: parts are staged, and a commit names those that count.

A table is a folder with parts and numbered commits. A write goes into a part of its own first; then a commit, one small file
that lists the table's parts, is written aside and renamed to the next number, which fails if another writer was faster. Readers
take the parts of the last commit, so they see all of a write or nothing, and what a crashed writer left is never read.
The commit also holds the bounds of a key filter: a Bloom filter of the stored keys as a table of bitmaps, so that rows
with a new key need no look at what is stored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Bits of a page of the filter, bits for each key, and hashes of a key: about one key in a hundred passes by chance.
PAGE, BITS, HASHES = 32768, 10, 7


class Conflict(RuntimeError):
    """Another writer has committed first."""


class _Files:
    """The table's store, as Spark reaches it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._path(path))] if self.fs.exists(self._path(path)) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, old: str, new: str) -> bool:
        return not self.fs.exists(self._path(new)) and self.fs.rename(self._path(old), self._path(new))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


def _last(files: _Files, path: str) -> tuple[int, dict]:
    numbers = [int(x.split(".")[0]) for x in files.names(f"{path}/commits") if x.endswith(".json") and x.split(".")[0].isdigit()]
    return (max(numbers), json.loads(files.read(f"{path}/commits/{max(numbers):012d}.json"))) if numbers else (0, {"parts": [], "pages": 0, "filters": []})


def _commit(files: _Files, path: str, number: int, content: dict) -> None:
    """Renames the commit into its place, which only one writer can do."""
    aside = f"{path}/commits/_{uuid.uuid4().hex}"
    files.write(aside, json.dumps(content))
    if not files.rename(aside, f"{path}/commits/{number:012d}.json"):
        files.delete(aside)
        raise Conflict(f"commit {number} of {path} is there already")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as of its last commit."""
    _, now = _last(_Files(spark, path), path)
    return spark.read.schema(schema).json([f"{path}/parts/{p}" for p in now["parts"]]) if now["parts"] else spark.createDataFrame([], schema)


def _staged(rows: DataFrame, path: str) -> tuple[str, int]:
    """Rows as a part that no commit names yet, and their number; they are computed once."""
    part, seen = uuid.uuid4().hex, Observation()
    rows.observe(seen, F.count("*").alias("n")).write.json(f"{path}/parts/{part}")
    return part, seen.get["n"]


def overwrite_unless_empty(rows: DataFrame, path: str) -> bool:
    """Replaces the table; an empty result never does. The parts before stay until vacuum."""
    files = _Files(rows.sparkSession, path)
    number, _ = _last(files, path)
    part, n = _staged(rows, path)
    if n:
        _commit(files, path, number + 1, {"parts": [part], "pages": 0, "filters": []})
    else:
        files.delete(f"{path}/parts/{part}")
    return n > 0


def _places(key: Column, pages: int) -> Column:
    """Where a key's bits are in a filter of some pages: all in one page."""
    page = F.pmod(F.xxhash64(key), F.lit(pages))
    return F.struct(page.alias("page"), *[F.pmod(F.xxhash64(F.lit(i), key), F.lit(PAGE)).alias(f"b{i}") for i in range(HASHES)])


def _filter(keys: DataFrame, key: str, pages: int) -> DataFrame:
    """(page, bits): bitmaps of PAGE bits."""
    each = keys.select(_places(F.col(key), pages).alias("p")).select("p.page", F.explode(F.array(*[F.col(f"p.b{i}") for i in range(HASHES)])).alias("bit"))
    return each.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _maybe(rows: DataFrame, key: str, pages: int, filters: DataFrame) -> DataFrame:
    """rows with _maybe: whether one of the filters holds all bits of the key."""
    placed = rows.withColumn("_p", _places(F.col(key), pages))
    merged = filters.groupBy("page").agg(F.bitmap_or_agg("bits").alias("_bits"))
    at = lambda b: F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = [F.getbit(at(F.col(f"_p.b{i}")), (F.col(f"_p.b{i}") % 8).cast("int")) == 1 for i in range(HASHES)]
    every = held[0]
    for h in held[1:]:
        every = every & h
    joined = placed.join(merged.withColumnRenamed("page", "_page"), F.col("_p.page") == F.col("_page"), "left")
    return joined.withColumn("_maybe", F.col("_bits").isNotNull() & every).drop("_p", "_page", "_bits")


def append_new(rows: DataFrame, path: str, key: str, schema: str, expected: int = 1 << 20) -> int:
    """Appends rows whose key (not null) is not stored yet, once each, so that an interrupted run can be repeated; returns how many.

    expected is a number of keys for the filter, fixed with the first append: more make it less sharp, not wrong. Only
    rows that the filter can't rule out meet the stored keys. If another writer commits in between, Conflict is raised and nothing
    of this write counts.
    """
    spark = rows.sparkSession
    files = _Files(spark, path)
    number, now = _last(files, path)
    names = [c for c in rows.columns if c != key]
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.first(F.struct(*names)).alias("_row")).select(key, "_row.*").select(*rows.columns) if names else rows.where(F.col(key).isNotNull()).distinct()
    pages = now["pages"] or max(1, -(-expected * BITS // PAGE))
    if now["parts"]:
        if now["filters"]:
            filters = spark.read.schema("page long, bits binary").parquet(*[f"{path}/filters/{f}" for f in now["filters"]])
            judged = scratch.stored(_maybe(new, key, pages, filters))
        else:
            judged = new.withColumn("_maybe", F.lit(True))
        there = spark.read.schema(schema).json([f"{path}/parts/{p}" for p in now["parts"]]).select(key)
        new = judged.where("_maybe").join(there, key, "left_anti").unionByName(judged.where("not _maybe")).select(*rows.columns)
    part, n = _staged(new, path)
    if not n:
        files.delete(f"{path}/parts/{part}")
        return 0
    name = uuid.uuid4().hex
    _filter(spark.read.schema(schema).json(f"{path}/parts/{part}"), key, pages).write.parquet(f"{path}/filters/{name}")
    whole = bool(now["filters"]) or not now["parts"]
    _commit(files, path, number + 1, {"parts": [*now["parts"], part], "pages": pages, "filters": [*now["filters"], name] if whole else []})
    return n


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes parts, filters and commits that the last commit doesn't name; not while others write. Returns how many."""
    files = _Files(spark, path)
    number, now = _last(files, path)
    gone = [f"{path}/parts/{x}" for x in files.names(f"{path}/parts") if x not in now["parts"]]
    gone += [f"{path}/filters/{x}" for x in files.names(f"{path}/filters") if x not in now["filters"]]
    gone += [f"{path}/commits/{x}" for x in files.names(f"{path}/commits") if x != f"{number:012d}.json"]
    for x in gone:
        files.delete(x)
    return len(gone)
