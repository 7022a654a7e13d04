"""Streams: training logs as they grow, and episodes step by step with their state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from decidra import schemas


def training_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> tuple[DataFrame, DataFrame]:
    """The two kinds of record in a folder of training logs: loss rows and evaluation rows."""
    rows = spark.readStream.schema(schemas.TRAIN_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where("eval is null").select("step", "loss", "lr", "elapsed"), rows.where("eval is not null").select("step", "eval")


def drained(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", kind: str = "parquet") -> StreamingQuery:
    """Writes what is there now and ends; the next call goes on where this one stopped. Returns the query, which has ended."""
    writer = stream.writeStream.outputMode(mode).format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start(sink)
    query.awaitTermination()
    return query


def counted_by_window(events: DataFrame, time: str, kind: str, length: str, late: str) -> DataFrame:
    """Events per window and kind; rows later than the watermark are dropped (an extension, not one of the row model)."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def episodes(steps: DataFrame, entries: int = 10, time: str | None = None, late: str = "1 hour", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Steps (episode, step, entry, done) of a stream, each with the number of steps before, the last entries and whether
    the goal was reached up to it. State per episode is a count, a flag and the last entries. With a column of time an episode's
    state goes once the watermark is idle_ms past its last step; without one it stays, which is for streams that end."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, reached, last = state.get if state.exists else (0, False, [])
        last, out, newest = list(last), [], state.getCurrentWatermarkMs() if time else 0
        for frame in frames:
            out += zip(frame["step"].tolist(), frame["entry"].tolist(), frame["done"].tolist(), strict=True)
            newest = max([newest, *frame["_ms"].tolist()])
        for k, (step, entry, done) in enumerate(sorted(out)):
            reached = bool(reached or done)
            out[k] = (key[0], step, seen, list(last), reached)
            seen, last = seen + 1, [*last, entry][-entries:]
        state.update((seen, reached, last))
        if time:
            state.setTimeoutTimestamp(newest + idle_ms)
        yield pd.DataFrame(out, columns=["episode", "step", "before", "recent", "reached"])

    timed = steps.withWatermark(time, late).withColumn("_ms", F.unix_millis(time)) if time else steps.withColumn("_ms", F.lit(0).cast("long"))
    kind = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return timed.groupBy("episode").applyInPandasWithState(run, "episode long, step long, before long, recent array<string>, reached boolean", "seen long, reached boolean, last array<string>", "append", kind)
