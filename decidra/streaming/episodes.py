"""Episodes of a stream whose state ends: a timer closes an episode when the watermark has passed its last step by a gap."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, while a stream is started."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def merged(spans: list[dict], gap: int, entries: int) -> list[dict]:
    """Spans in order of time; those less than gap apart are one, which keeps its last entries."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda s: s["first"]):
        if out and x["first"] - out[-1]["last"] < gap:
            a = out[-1]
            out[-1] = {"first": a["first"], "last": max(a["last"], x["last"]), "n": a["n"] + x["n"], "reached": a["reached"] or x["reached"], "recent": sorted([*a["recent"], *x["recent"]])[-entries:]}
        else:
            out.append(x)
    return out


class Closing(StatefulProcessor):
    """Open episodes of a key as spans of time (microseconds) with a count, a flag and the last entries."""

    def __init__(self, gap: int, entries: int) -> None:
        self.gap, self.entries = gap, entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans string")

    def _spans(self) -> list[dict]:
        return json.loads(self.open.get()[0]) if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        spans = self._spans()
        for frame in rows:
            new = [{"first": t, "last": t, "n": 1, "reached": bool(done), "recent": [[t, entry]]} for t, entry, done in zip(frame["at"].tolist(), frame["entry"].tolist(), frame["done"].tolist(), strict=True)]
            spans = merged([*spans, *new], self.gap, self.entries)
        self.open.update((json.dumps(spans),))
        for x in spans:
            self.handle.registerTimer(self._closes(x))
        yield pd.DataFrame()

    def _closes(self, span: dict) -> int:
        return -(-(span["last"] + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        spans = self._spans()
        over = [x for x in spans if self._closes(x) <= now]
        rest = [x for x in spans if self._closes(x) > now]
        if rest:
            self.open.update((json.dumps(rest),))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame([(key[0], x["first"], x["last"], x["n"], x["reached"], [e for _, e in x["recent"]]) for x in over], columns=["episode", "first", "last", "n", "reached", "recent"])

    def close(self) -> None:
        pass


def closed(steps: DataFrame, gap_seconds: float, late: str, entries: int = 10) -> DataFrame:
    """Episodes of a stream of steps (episode long, time, entry, done) once they are over: first and last time, number of steps, whether
    the goal was reached, and the last entries.

    Steps of an episode that are gap or more apart belong to different ones. A step may come up to `late` after others; one
    that comes later is dropped, as its episode may have been closed. What is kept is a span for each episode that is still
    open, and it goes with its timer. Start the stream inside state_store.
    """
    kept = steps.withWatermark("time", late).select("episode", "time", F.unix_micros("time").alias("at"), "entry", "done")
    out = kept.groupBy("episode").transformWithStateInPandas(Closing(int(gap_seconds * 1e6), entries), "episode long, first long, last long, n long, reached boolean, recent array<string>", "Append", "EventTime")
    return out.select("episode", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "reached", "recent")
