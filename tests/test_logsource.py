"""Log files read in ranges, with conditions, and as a stream that is stopped and started again."""

import random

import pytest
from pyspark.sql import functions as F

from decidra.sources import logsource
from decidra.streaming import logs

OPTIONS = {"pattern": r"^\[(\d+)\] k=(\S*) p=(\S*)$", "fields": "i bigint, k string, p double"}


def lines(rng, first, n):
    rows, text = [], []
    for i in range(first, first + n):
        k, p = rng.choice(["a", "bé", "None", ""]), rng.choice(["0.5", "None", "x", "1e3"])
        text.append(f"[{i}] k={k} p={p}")
        rows.append((i, k if k not in ("None", "") else None, float(p) if p[0] in "01" else None))
        if rng.random() < 0.2:
            text.append(rng.choice(["", "noise", "[1] broken"]))
    return rows, "\n".join(text) + "\n"


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_ranges_hold_each_line_once(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(logsource, "CHUNK", chunk)
    rows, text = lines(random.Random(chunk), 0, 60)
    (tmp_path / "a.log").write_text(text.removesuffix("\n") if chunk == 7 else text)
    source = logsource.Lines({"path": str(tmp_path), **OPTIONS})
    size = len((tmp_path / "a.log").read_bytes())
    for split in (1, 13, 100, size):
        parts = [logsource.Range(str(tmp_path / "a.log"), a, min(size, a + split)) for a in range(0, size, split)]
        got = [tuple(r.values()) for p in parts for b in source.batches(p) for r in b.to_pylist()]
        assert got == rows


def test_batch_with_conditions(spark, tmp_path):
    rng, rows = random.Random(1), []
    for name in ("a", "b"):
        own, text = lines(rng, len(rows), 200)
        (tmp_path / f"{name}.log").write_text(text)
        rows += own
    (tmp_path / "_SUCCESS").write_text("[9] k=a p=1\n")
    frame = logsource.registered(spark).read.format("decision_log").options(**OPTIONS).load(str(tmp_path))
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, rows))
    some = frame.where((F.col("i") >= 50) & (F.col("k") == "a") & (F.col("p") + 1 > 1.4))
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[0] >= 50 and r[1] == "a" and (r[2] or 0) + 1 > 1.4)
    assert frame.where("k is null").count() == sum(r[1] is None for r in rows)
    (tmp_path / "none").mkdir()
    assert spark.read.format("decision_log").options(**OPTIONS).load(str(tmp_path / "none")).count() == 0


def test_stream_goes_on_without_loss_or_repeat(spark, tmp_path):
    rng, folder = random.Random(2), tmp_path / "in"
    folder.mkdir()

    def run():
        stream = logsource.registered(spark).readStream.format("decision_log").options(**OPTIONS).load(str(folder))
        logs.drained(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(map(repr, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())))

    rows, text = lines(rng, 0, 50)
    (folder / "a.log").write_text(text + "[50] k=a")  # a line that is still being written
    assert run() == sorted(map(repr, rows))
    more, text = lines(rng, 51, 30)
    with (folder / "a.log").open("a") as f:
        f.write(" p=1\n" + text)
    others, text = lines(rng, 100, 20)
    (folder / "b.log").write_text(text)
    rows += [(50, "a", 1.0), *more, *others]
    assert run() == sorted(map(repr, rows))
    assert run() == sorted(map(repr, rows))
