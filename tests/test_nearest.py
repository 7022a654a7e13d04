"""Nearest rows by widening cells against all pairs."""

import hashlib
import random
from collections import defaultdict

import pytest

from decidra.operators import items as I
from decidra.operators import joins as J


def plain(rows, k, weights):
    groups = defaultdict(list)
    for g, key, *xs in rows:
        groups[g].append((key, xs))
    out = set()
    for own in groups.values():
        for a, xa in own:
            far = sorted((sum(w * abs(p - q) for w, p, q in zip(weights, xa, xb, strict=True)), b) for b, xb in own if b != a)
            out |= {(a, b, round(d, 6), r) for r, (d, b) in enumerate(far[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_all_pairs(spark, k):
    rng = random.Random(k)
    points = [("even", rng.uniform(0, 50), rng.uniform(0, 9)) for _ in range(150)] + [(None, rng.choice([1.0, 1.0, 2.0, 900.0, 1e6]), rng.choice([0.0, 3.0])) for _ in range(80)]
    points += [("cluster", rng.gauss(0, 1e-3), 0.0) for _ in range(60)] + [("cluster", 1e4, 1.0), ("cluster", -5e5, 2.0), ("one", 1.0, 1.0), ("two", 1.0, 1.0), ("two", 1.0, 1.0)]
    rows = [(g, i * 7 % 1009, x, y) for i, (g, x, y) in enumerate(points)]
    frame = spark.createDataFrame(rows, "g string, key long, x double, y double").repartition(3)
    out = [(r.key, r.other, round(r.distance, 6), r["rank"]) for r in J.nearest(frame, ["g"], "key", {"x": 1.0, "y": 2.5}, k).collect()]
    assert len(out) == len(set(out)) and set(out) == plain(rows, k, (1.0, 2.5))


def test_rows_at_one_place_are_not_paired(spark):
    """One brand, one size: candidates are the first rows of the place, so the pairs grow with the rows, not their square."""
    n = 3000
    frame = spark.range(n).selectExpr("id", "'b' AS g", "id % 2 AS x")
    out = J.nearest(frame, ["g"], "id", {"x": 1.0}, 3)
    got = defaultdict(list)
    for r in out.collect():
        got[r.id].append((r["rank"], r.other, r.distance))
    assert len(got) == n
    assert all([o for _, o, _ in sorted(v)] == [x for x in range(i % 2, 10, 2) if x != i][:3] for i, v in got.items())


def plain_confusable(rows, k, seed):
    """All pairs: others of the same role first, then length and jitter."""
    out, groups = set(), defaultdict(list)
    for g, key, role, text in rows:
        groups[g].append((key, role, len(text)))
    for own in groups.values():
        for a, role, n in own:
            far = sorted((r != role, abs(n - m) + int(hashlib.md5(f"{seed}:{a}:{b}".encode()).hexdigest()[:8], 16) / 4294967296.0 * 3, b) for b, r, m in own if b != a)
            out |= {(a, b, i) for i, (_, _, b) in enumerate(far[:k], 1)}
    return out


def joined_rows(spark):
    """Rows that come out of each join of the session so far."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    executions = store.executionsList()
    for i in range(executions.size()):
        number = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if not node.name().endswith("Join"):
                continue
            for m in range(node.metrics().size()):
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    out.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return out


def test_confusable_equals_all_pairs(spark):
    """Crowded and lonely lengths, roles that only a few have, groups of fewer than k and equal texts."""
    rng = random.Random(3)
    rows = [("even", rng.randint(0, 2), "x" * rng.randint(0, 60)) for _ in range(150)] + [("one length", rng.choice([0, 0, 0, 1]), "xxx") for _ in range(120)]
    rows += [("hot", i % 40 == 0, "x" * (5 if i % 20 else i)) for i in range(200)] + [(None, 0, "x" * i) for i in range(3)] + [("alone", 0, "x")]
    rows = [(g, i * 7 % 1009, int(role), text) for i, (g, role, text) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "g string, key long, role int, text string").repartition(3)
    out = [(r.key, r.other, r["rank"]) for r in I.confusable(frame, ["g"], "key", "role", "text", 4, "22").collect()]
    assert len(out) == len(set(out)) and set(out) == plain_confusable(rows, 4, "22")


def test_pairs_of_a_place_are_not_passed_on(spark):
    """One group, one role, one length: every pair is hashed, but only some of a row's leave the join."""
    n = 1200
    frame = spark.range(n).selectExpr("id", "'b' AS g", "1 AS role", "'same' AS text")
    seen = len(joined_rows(spark))
    out = I.confusable(frame, ["g"], "id", "role", "text", 4, "22").collect()
    assert len(out) == 4 * n
    assert max(joined_rows(spark)[seen:]) < 40 * n
