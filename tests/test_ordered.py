"""Places, selections and resamples of whole groups against plain versions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from decidra.operators import metrics as M
from decidra.operators import ordered, resampling


def test_numbers_of_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, 1, 2, 2, 2, 5]), i) for i in range(400)] + [("same", 7, 1)] * 300
    frame = spark.createDataFrame(rows, "g string, v int, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = [tuple(r) for r in ordered.numbered(frame, ["g"], "v", "i").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, (r[:3] for r in out))) == sorted(map(repr, rows))
    groups = defaultdict(list)
    for g, v, _, i in out:
        groups[g].append((i, v is not None, v or 0))
    for found in groups.values():
        found.sort()
        assert [i for i, _, _ in found] == list(range(len(found))) and [x[1:] for x in found] == sorted(x[1:] for x in found)
    assert ordered.numbered(frame.where("false"), ["g"], "v", "i").count() == 0


def plain_selective(rows, share):
    groups = defaultdict(list)
    for g, conf, hit, i in rows:
        if conf is not None and hit is not None:
            groups[g].append((-conf, i, -hit))
    out = {}
    for g, found in groups.items():
        k = max(1, round(len(found) * share))
        out[g] = sum(-h for _, _, h in sorted(found)[:k]) / k
    return out


@pytest.mark.parametrize("kind", ["tied", "mixed", "close"])
def test_selection_equals_a_sort(spark, kind):
    rng = random.Random(2)
    conf = {"tied": lambda: 1.0, "mixed": lambda: rng.choice([0.5, 0.75, 1.0, rng.random(), None, 1e-300, -2.0]), "close": lambda: 0.9 + rng.randint(0, 40) * 2**-53}[kind]
    rows = [(rng.choice(["a", "b", None]), conf(), rng.choice([0, 1, 1, None]), i * 3 - 500 if rng.random() < 0.9 else 7) for i in range(900)] + [("one", 0.5, 1, 1)]
    frame = spark.createDataFrame(rows, "g string, conf double, hit int, id long").repartition(4)
    out = {r.g: (r.x, r.y, r.z) for r in M.selective(frame, ["g"], {"x": 0.8, "y": 0.0, "z": 1.0}).collect()}
    expected = {g: tuple(plain_selective(rows, s)[g] for s in (0.8, 0.0, 1.0)) for g in plain_selective(rows, 0.5)}
    assert out == expected
    if kind == "tied":  # by text, with long common beginnings
        name = lambda i: "common/" * 3 + ("é" if i % 5 == 0 else "") + f"{i % 7}" * (i % 4) + f"/{i}"
        rows = [(g, c, h, name(i)) for g, c, h, i in rows]
        frame = spark.createDataFrame(rows, "g string, conf double, hit int, id string").repartition(4)
        out = {r.g: r.x for r in M.selective(frame, ["g"], {"x": 0.63}).collect()}
        assert out == plain_selective([(g, c, h, i.encode()) for g, c, h, i in rows], 0.63)


def test_values_at_places(spark):
    rng = random.Random(3)
    groups = {"spread": [rng.gauss(0, 1e6) for _ in range(501)], "same": [4.0] * 200, "powers": [2.0**-k for k in range(60)], "ends": [float("-inf"), 1.0, 2.0, float("inf"), float("nan"), -0.0], None: [1.0, 2.0], "one": [3.5]}
    frame = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [("none", None)], "g string, v double")
    out = {r.g: (r.low, r.mid, r.high) for r in ordered.nth_values(frame, ["g"], "v", {"low": lambda n: n * 0, "mid": lambda n: (n / 2).cast("long"), "high": lambda n: n - 1}).collect()}
    for g, x in groups.items():
        x = sorted(x, key=lambda v: (math.isnan(v), v))
        assert repr(out[g]) == repr((x[0], x[len(x) // 2], x[-1]))
    mid = {r.g: r.v for r in ordered.medians(frame.where("g <> 'ends' or g is null"), ["g"], "v").collect()}
    assert mid == {g: float(np.median(x)) for g, x in groups.items() if g != "ends"} | {"none": None}


def exact_binomial(n, share, unit):
    """The inverse of the distribution by whole numbers' logarithms."""
    upto = 0.0
    for k in range(n + 1):
        upto += math.comb(n, k) * share**k * (1 - share) ** (n - k)
        if upto >= unit - 1e-12:
            return k
    return n


def test_draws_are_the_inverse_of_the_binomial():
    rng = random.Random(4)
    for _ in range(300):
        n, share, unit = rng.randint(0, 60), rng.uniform(0.01, 0.99), rng.random()
        assert resampling.binomial(np.array([n]), share, np.array([unit]))[0] == exact_binomial(n, share, unit)
    big = resampling.binomial(np.full(4000, 10**9), 0.3, np.random.default_rng(1).random(4000))
    assert abs(big.mean() - 3e8) < 6 * math.sqrt(2.1e8 / 4000) and 0.9 < big.std() / math.sqrt(2.1e8) < 1.1


@pytest.mark.parametrize("cells", [4096, 40])
def test_bootstrap_of_two_values_and_of_many(spark, monkeypatch, cells):
    monkeypatch.setattr(resampling, "CELLS", cells)
    rng = random.Random(5)
    rows = [("a", float(rng.random() < 0.7)) for _ in range(80)] + [("b", rng.gauss(3, 1)) for _ in range(300)] + [(None, 2.0)] * 5 + [("", 1.0), ("a", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    means = defaultdict(list)
    for r in resampling.bootstrap_means(frame, ["g"], "v", 300, "s").collect():
        means[r.g].append((r._b, r.m))
    ones = [v for g, v in rows if g == "a" and v is not None]
    wrong = ones.count(0.0) / len(ones)
    expected = [(b, 1 - exact_binomial(len(ones), wrong, int(hashlib.md5(f"s:a:{b}".encode()).hexdigest()[:13], 16) / 2**52) / len(ones)) for b in range(300)]
    assert [m for _, m in sorted(means["a"])] == pytest.approx([m for _, m in expected])
    assert sorted(means[None]) == [(b, 2.0) for b in range(300)] and sorted(means[""]) == [(b, 1.0) for b in range(300)]
    many = np.array([m for _, m in means["b"]])
    values = np.array([v for g, v in rows if g == "b"])
    assert len(many) == 300 and abs(many.mean() - values.mean()) < 5 * values.std() / math.sqrt(300 * 300)
    assert 0.85 < many.std() / (values.std() / math.sqrt(300)) < 1.15


def test_multiplicities_of_a_split():
    weights = np.array([1, 1, 5, 1, 2, 90])
    base = resampling.bases("x", "g", range(4000))
    drawn = resampling.split(np.full(4000, 100), weights, base, 3)
    assert (drawn.sum(axis=0) == 100).all() and (drawn >= 0).all()
    assert np.allclose(drawn.mean(axis=1), weights, rtol=0.1)
    cov = np.cov(drawn)
    expected = np.diag(weights.astype(float)) - np.outer(weights, weights) / 100
    assert np.abs(cov - expected).max() < 0.6
