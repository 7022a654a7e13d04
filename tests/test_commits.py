"""Writers that are killed between their phases, two at a time, and the key filter."""

import os

import pytest
from pyspark.sql import functions as F

from decidra.sources import commits

SCHEMA = "id long, v string"


def stored(spark, path):
    return sorted(r.id for r in commits.read(spark, path, SCHEMA).collect())


def frame(spark, ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], SCHEMA)


class Killed(BaseException):
    pass


@pytest.mark.parametrize("phase", ["_staged", "_filter", "_commit", "rename"])
def test_a_killed_writer_leaves_the_table(spark, tmp_path, monkeypatch, phase):
    path = str(tmp_path / "t")
    assert commits.append_new(frame(spark, range(20)), path, "id", SCHEMA) == 20

    def killed(*_, **__):
        raise Killed

    with monkeypatch.context() as m:
        if phase == "_staged":  # killed once the part is there
            before = commits._staged
            m.setattr(commits, "_staged", lambda *a: (before(*a), killed()))
        elif phase == "rename":
            m.setattr(commits._Files, "rename", killed)
        else:
            m.setattr(commits, phase, killed)
        with pytest.raises(Killed):
            commits.append_new(frame(spark, range(10, 30)), path, "id", SCHEMA)
        if phase != "_filter":
            with pytest.raises(Killed):
                commits.overwrite_unless_empty(frame(spark, [7]), path)
    assert stored(spark, path) == list(range(20))
    assert commits.append_new(frame(spark, range(10, 30)), path, "id", SCHEMA) == 10
    assert stored(spark, path) == list(range(30))
    assert commits.vacuum(spark, path) >= 2 and stored(spark, path) == list(range(30))
    assert commits.vacuum(spark, path) == 0


def test_the_slower_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commits.append_new(frame(spark, [1]), path, "id", SCHEMA)
    before = commits._staged

    def other_first(*a):
        out = before(*a)
        monkeypatch.setattr(commits, "_staged", before)
        assert commits.append_new(frame(spark, [2]), path, "id", SCHEMA) == 1
        return out

    monkeypatch.setattr(commits, "_staged", other_first)
    with pytest.raises(commits.Conflict):
        commits.append_new(frame(spark, [2, 3]), path, "id", SCHEMA)
    assert stored(spark, path) == [1, 2]
    assert commits.append_new(frame(spark, [2, 3]), path, "id", SCHEMA) == 1
    assert stored(spark, path) == [1, 2, 3]


def test_repeated_and_null_keys_and_empty_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.read(spark, path, SCHEMA).count() == 0
    assert commits.append_new(frame(spark, []), path, "id", SCHEMA) == 0
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], SCHEMA)
    assert commits.append_new(rows, path, "id", SCHEMA) == 1
    assert not commits.overwrite_unless_empty(frame(spark, []), path) and stored(spark, path) == [1]
    assert commits.overwrite_unless_empty(frame(spark, [5, 6]), path) and stored(spark, path) == [5, 6]
    assert commits.append_new(frame(spark, [1, 6]), path, "id", SCHEMA) == 1 and stored(spark, path) == [1, 5, 6]
    commits.vacuum(spark, path)
    assert len([x for x in os.listdir(f"{path}/parts") if not x.startswith(".")]) == 2


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    pages = 4
    keys = spark.range(pages * commits.PAGE // commits.BITS).select(F.col("id").cast("string").alias("k"))
    filters = commits._filter(keys, "k", pages)
    assert commits._maybe(keys, "k", pages, filters).where("not _maybe").count() == 0
    others = spark.range(10**6, 10**6 + 20_000).select(F.col("id").cast("string").alias("k"))
    assert commits._maybe(others, "k", pages, filters).where("_maybe").count() < 20_000 * 0.03
