"""Episodes of a stream in many batches: their state ends, late steps are dropped."""

import datetime as dt

from decidra.streaming import episodes, logs

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def batch(spark, path, number, rows):
    frame = spark.createDataFrame([(e, at(m), entry, done) for e, m, entry, done in rows], "episode long, time timestamp, entry string, done boolean")
    frame.coalesce(1).write.parquet(f"{path}/{number}")


def test_episodes_close_after_a_gap(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "episode long, time timestamp, entry string, done boolean"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
        with episodes.state_store(spark):
            return logs.drained(episodes.closed(stream, 600, "5 minutes", 3), str(tmp_path / "out"), str(tmp_path / "state"))

    def found():
        return sorted((r.episode, r.first, r.last, r.n, r.reached, r.recent) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    naive = lambda m: at(m).replace(tzinfo=None)
    batch(spark, path, 1, [(1, 0, "a", False), (1, 4, "c", False), (2, 1, "x", True), (1, 2, "b", False)])
    batch(spark, path, 2, [(1, 6, "d", True), (2, 12, "y", False)])  # eleven minutes after: another episode of 2
    run()
    assert found() == []
    batch(spark, path, 3, [(3, 24, "z", False)])  # the watermark goes to 19, so 1 and the first of 2 are over
    run()
    assert found() == [(1, naive(0), naive(6), 4, True, ["b", "c", "d"]), (2, naive(1), naive(1), 1, True, ["x"])]
    batch(spark, path, 4, [(1, 3, "late", False), (3, 33, "w", False), (1, 60, "e", False)])
    last = run()
    assert found()[2:] == [(2, naive(12), naive(12), 1, False, ["y"]), (3, naive(24), naive(33), 2, False, ["z", "w"])]
    assert sum(x["numRowsTotal"] for x in last.lastProgress["stateOperators"]) <= 4  # a span and a timer of the episode that is open
    run()
    assert len(found()) == 4


def test_merged_spans():
    span = lambda t, n=1: {"first": t, "last": t, "n": n, "reached": False, "recent": [[t, str(t)]]}
    out = episodes.merged([span(30), span(1), span(9), span(21)], 10, 2)
    assert [(x["first"], x["last"], x["n"], x["recent"]) for x in out] == [(1, 9, 2, [[1, "1"], [9, "9"]]), (21, 30, 2, [[21, "21"], [30, "30"]])]


def test_state_of_idle_episodes_goes(spark, tmp_path):
    schema = "episode long, step long, entry string, done boolean, time timestamp"
    for number, rows in enumerate([[(1, 0, "a", False, at(0)), (1, 1, "b", True, at(1))], [(2, 0, "z", False, at(200))], [(2, 1, "y", False, at(201))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        last = logs.drained(logs.episodes(stream, 1, "time", "1 minute", 60_000), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.episode, r.step): (r.before, r.recent, r.reached) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): (0, [], False), (1, 1): (1, ["a"], True), (2, 0): (0, [], False), (2, 1): (1, ["z"], False)}
    assert sum(x["numRowsTotal"] for x in last.lastProgress["stateOperators"]) == 1
