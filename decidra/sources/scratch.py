"""Tables that cut the lineage of a job, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one; below one of our own only in local mode, where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="decidra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a written table, which goes when the process ends."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _stored.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped() -> None:
    """Removes the tables of this process."""
    while _stored:
        spark, path = _stored.pop()
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(dropped)
