"""Histories, masks and batches of whole groups against plain versions."""

import random
from collections import defaultdict

import pytest

from decidra.operators import sequences as Q
from decidra.plans import QUERIES


@pytest.mark.parametrize("block", [16, 4096])
def test_histories_as_ranges(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = random.Random(1)
    rows = [(e, s * 2, rng.choice(["a", "b", None, "c"])) for e, n in (("x", 50), (None, 33), ("y", 1)) for s in range(n)]
    frame = spark.createDataFrame(rows, "e string, step long, kind string").repartition(3)
    own = defaultdict(list)
    for e, s, k in rows:
        own[e].append((s, k))
    got = {(r.e, r.step): (r.before, r.recent) for r in Q.history(frame, ["e"], "step", "kind", 10).collect()}
    assert got == {(e, s): (i, [k for _, k in x[max(0, i - 10) : i]]) for e, x in own.items() for i, (s, _) in enumerate(x)}
    chunks = defaultdict(list)
    for r in Q.history_chunks(frame, ["e"], "step", "kind").orderBy("chunk").collect():
        assert len(r.entries) <= block
        chunks[r.e] += r.entries
    assert chunks == {e: [k for _, k in x] for e, x in own.items()}
    later = {(r.e, r.step): r.later for r in Q.later_values(frame, ["e"], "step", "kind", "later").collect()}
    assert later == {(e, s): sorted({k for t, k in x if t > s and k}) for e, x in own.items() for s, _ in x}


@pytest.mark.parametrize("block", [7, 4096])
def test_whole_histories(spark, monkeypatch, block):
    """Every entry before a step is there, however many chunks the episode has."""
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = random.Random(2)
    rows = [(e, s * 2, rng.choice(["a", "b", None, "c"])) for e, n in (("x", 50), (None, 33), ("y", 1)) for s in range(n)]
    frame = spark.createDataFrame(rows, "e string, step long, kind string").repartition(3)
    own = defaultdict(list)
    for e, s, k in rows:
        own[e].append((s, k))
    got = {(r.e, r.step): (r.before, r.history) for r in Q.histories(frame, ["e"], "step", "kind").collect()}
    assert got == {(e, s): (i, [k for _, k in x[:i]]) for e, x in own.items() for i, (s, _) in enumerate(x)}
    assert Q.histories(frame.where("false"), ["e"], "step", "kind").count() == 0


def test_query_gives_whole_histories(spark):
    """A step shows the entries of all steps before it, not the last ten alone."""
    rows = QUERIES["episode_history"](spark, "/root/testdata/sf0.001").collect()
    assert max(r.before for r in rows) > 10
    assert all(len(r.history.split(",") if r.history else []) == r.before for r in rows)


def test_masks_by_ranges(spark):
    sequences = {1: [0, 0, 0, 1, 1, 2, 3, 3, 3], 2: [0], 3: [1, 1], 4: [0, 0, 1]}
    places = spark.createDataFrame([(k, i, s) for k, x in sequences.items() for i, s in enumerate(x)], "k long, i int, segment int")
    segments = Q.segment_ranges(places, ["k"], "i", "segment")
    pairs = {(k, i, j) for k, x in sequences.items() for i in range(len(x)) for j in range(i + 1) if x[i] == x[j] or x[j] == 0}
    written = [tuple(r) for r in Q.attends(Q.mask_ranges(segments, ["k"]), ["k"]).collect()]
    assert len(written) == len(pairs) and set(written) == pairs
    assert {r.k: r.allowed for r in Q.allowed(segments, ["k"]).collect()} == {k: sum(p[0] == k for p in pairs) for k in sequences}


def plain_batches(sizes, budget, most):
    out, batch, count, longest = [], 0, 0, 0
    for n in sizes:
        if count and (count >= most or max(longest, n) * (count + 1) > budget):
            batch, count, longest = batch + 1, 0, 0
        count, longest = count + 1, max(longest, n)
        out.append(batch)
    return out


@pytest.mark.parametrize(("span", "most", "budget"), [(8, 4, 60), (32, 32, 500), (1024, 32, 500), (16, 1, 10**9), (16, 16, 1)])
def test_batches_over_blocks(spark, monkeypatch, span, most, budget):
    """One shard holds nearly all rows and spans many blocks."""
    monkeypatch.setattr(Q, "SPAN", span)
    rng = random.Random(span)
    rows = [(1, i, rng.randint(1, 90)) for i in range(700)] + [(None, 2000 + i, 5) for i in range(40)] + [(2, 5000, 10**6)]
    frame = spark.createDataFrame(rows, "shard long, key long, size long").repartition(3)
    out = Q.length_batches(frame, "shard", "key", "size", budget, most).collect()
    assert sorted((r.key, r.size) for r in out) == sorted((k, n) for _, k, n in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append((r.size, r.key, r.batch))
    for found in by.values():
        found.sort()
        assert [b for _, _, b in found] == plain_batches([n for n, _, _ in found], budget, most)
    assert Q.length_batches(frame.where("false"), "shard", "key", "size", budget, most).count() == 0
