"""Shared pieces: table reading, scratch tables, byte tokenisers and bit counts."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="decidra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/decidra"


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the step are dropped once its table is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage of df with a table in the shared scratch folder."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with _freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more, not even to compute lost parts again."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)
        _written.remove((t.sparkSession, t._scratch))


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Scratch tables that are written inside go at the end; what reads them must be stored before."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            with contextlib.suppress(Exception):
                _delete(spark, path)
        del _written[before:]


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """path, which is removed when the process ends."""
    _written.append((spark, path))
    return path


def drop_written() -> None:
    """Removes the scratch tables of this process; results that still read them must be stored first."""
    while _written:
        with contextlib.suppress(Exception):
            _delete(*_written.pop())


atexit.register(drop_written)


#: Bytes of file names up to which their numbers are broadcast; beyond, the numbered rows are stored once.
FILE_NAMES = 64 << 20


def with_row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """A number per row of a stored table: the place of its file among the sorted names, and its place in the file.

    It is the same at each read, however many cores read and however files are split, also where ids repeat or are null.
    Rows that come from no file are stored once with their numbers. A column of that name is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    path, place, number = (unused(docs, c) for c in ("_path", "_place", "_number"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in placed.select(path).distinct().collect())  # as many as Spark's driver has listed for the scan
    if len(files) < 2:
        return placed.select(*[placed[c] for c in kept], F.col(place).alias(name))
    if sum(map(len, files)) > FILE_NAMES:
        return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    numbers = docs.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(files)), "array<string>")).alias(number, path))
    joined = placed.join(F.broadcast(numbers), path)
    return joined.select(*[placed[c] for c in kept], F.shiftleft(F.col(number).cast("long"), 40).bitwiseOR(F.col(place)).alias(name))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that a worker holds what it makes of a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A-Z in lower case, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same; every ASCII byte that is no letter or digit becomes a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return text.translate(WORDS).split()


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased words between blanks (space and the controls from tab to return)."""
    return text.translate(LOWER).split()
