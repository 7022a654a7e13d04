"""Bootstrap by splitting counts: no resample is ever made.

A resample of n rows with replacement is a multinomial count of the rows, and rows of equal value count together. The count of
each round is split down a binary tree over the distinct values, a node's left part by a binomial draw, first over parts of
CELLS values, then inside a part. A round sends one number to a part and takes one sum from it, so what is shuffled
depends on the distinct values and on parts times rounds, not on rows times rounds.

Draws come from hashes of seed, group, round and node by the inverse of the binomial distribution, so they are the same at any
partitioning: the root takes the hash of the round as it is, every other node a mix of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.sources.scratch import stored

from .ordered import grouped, numbered

#: Distinct values of a part, and rounds that one task draws for all parts of a group.
CELLS, ROUNDS = 4096, 250
_UNIT = 1 << 52


def bases(seed: str, group: str, rounds: range) -> np.ndarray:
    """52 bits of the hash of each round."""
    return np.array([int(hashlib.md5(f"{seed}:{group}:{b}".encode()).hexdigest()[:13], 16) for b in rounds], np.uint64)


def units(base: np.ndarray, tree: int, node: int) -> np.ndarray:
    """Uniform numbers of a node (the root is 1) of a tree for each round."""
    if (tree, node) == (0, 1):
        return base / _UNIT
    x = base + np.uint64((tree * 0x9E3779B97F4A7C15 + node * 0xD1B54A32D192ED03) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)) / _UNIT


def binomial(n: np.ndarray, share: float, unit: np.ndarray) -> np.ndarray:
    """The smallest k for each n with P(X <= k) >= unit. Places over 12 standard deviations off the mean have no weight."""
    out = np.zeros(len(n), np.int64)
    order = np.argsort(n, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        size = int(n[part[0]]) if len(part) else 0
        if not size:
            continue
        mean, reach = size * share, 12 * math.sqrt(size * share * (1 - share)) + 12
        low, high = max(0, math.floor(mean - reach)), min(size, math.ceil(mean + reach))
        k = np.arange(low, high, dtype=float)
        steps = np.log((size - k) / (k + 1)) + math.log(share / (1 - share))
        weight = np.concatenate(([0.0], np.cumsum(steps)))
        upto = np.cumsum(np.exp(weight - weight.max()))
        out[part] = low + np.minimum(np.searchsorted(upto / upto[-1], unit[part]), high - low)
    return out


def split(counts: np.ndarray, weights: np.ndarray, base: np.ndarray, tree: int) -> np.ndarray:
    """counts (one for each round) dealt to the weights: a row for each weight."""
    sums = np.concatenate(([0], np.cumsum(weights)))
    out = np.zeros((len(weights), len(counts)), np.int64)
    rest = [(0, len(weights), 1, counts)]
    while rest:
        low, high, node, n = rest.pop()
        if high - low == 1:
            out[low] = n
            continue
        middle = (low + high) // 2
        left = binomial(n, float(sums[middle] - sums[low]) / float(sums[high] - sums[low]), units(base, tree, node))
        rest += [(low, middle, 2 * node, left), (middle, high, 2 * node + 1, n - left)]
    return out


def _dealt(seed: str):
    """The rounds' counts of each part of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                weights = np.array(r["weights"], np.int64)
                base = bases(seed, r["name"], range(r["first"], r["last"]))
                counts = split(np.full(len(base), weights.sum()), weights, base, 1 << 40)
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(weights)), pa.array(range(len(weights)), pa.int64()), pa.array([r["first"]] * len(weights), pa.int64()), pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["key", "part", "first", "counts"])

    return run


def _sums(seed: str):
    """The rounds' sums of values in each part, from the counts it was dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, weights = np.array([x["_v"] for x in r["cells"]]), np.array([x["_n"] for x in r["cells"]], np.int64)
                for x in r["dealt"]:
                    base = bases(seed, r["name"], range(x["first"], x["first"] + len(x["counts"])))
                    drawn = split(np.array(x["counts"], np.int64), weights, base, r["part"])
                    yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(base)), pa.array(range(x["first"], x["first"] + len(base)), pa.int64()), pa.array((values[:, None] * drawn).sum(axis=0))], names=["key", "b", "s"])

    return run


def bootstrap_means(rows: DataFrame, by: list[str], value: str, rounds: int, seed: str) -> DataFrame:
    """Mean of the values in each of the rounds of resamples of a group: by, _b and m. Groups are named by their keys as text."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cells = grouped(counts.withColumn("name", name), by).withColumn("key", F.to_json("_g")).select("_g", "key", "name", "_v", "_n")
    cells = stored(numbered(cells, ["key"], "_v", "_i").withColumn("part", F.floor(F.col("_i") / CELLS)))
    parts = cells.groupBy("_g", "key", "name", "part").agg(F.sum("_n").alias("n"))
    groups = stored(parts.groupBy("_g", "key", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda x: x["n"]).alias("weights"), F.sum("n").alias("n")))
    spans = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1), F.lit(ROUNDS))).alias("first")
    asked = groups.select("key", "name", "weights", spans).select("key", "name", "weights", "first", F.least(F.col("first") + ROUNDS, F.lit(rounds)).alias("last")).repartition("key", "first")
    dealt = asked.mapInArrow(_dealt(seed), "key string, part long, first long, counts array<long>")
    dealt = dealt.groupBy("key", "part").agg(F.collect_list(F.struct("first", "counts")).alias("dealt"))
    inside = cells.groupBy("key", "name", "part").agg(F.array_sort(F.collect_list(F.struct("_v", "_n"))).alias("cells"))
    sums = inside.join(dealt, ["key", "part"]).select("key", "name", "part", "cells", "dealt").mapInArrow(_sums(seed), "key string, b long, s double")
    found = sums.groupBy("key", "b").agg(F.sum("s").alias("s")).join(groups.select("_g", "key", "n"), "key")
    return found.select(*[F.col(f"_g.{c}").alias(c) for c in by], F.col("b").alias("_b"), (F.col("s") / F.col("n")).alias("m"))


def bootstrap(rows: DataFrame, by: list[str], value: str, rounds: int, seed: str) -> DataFrame:
    """95 % interval of a mean from resamples with replacement: the means at places int(0.025 rounds) and int(0.975 rounds)."""
    means = bootstrap_means(rows, by, value, rounds, seed)
    ranked = means.groupBy(*by).agg(F.sort_array(F.collect_list("m")).alias("m"))  # rounds values
    return ranked.select(*by, F.element_at("m", int(0.025 * rounds) + 1).alias("low"), F.element_at("m", int(0.975 * rounds) + 1).alias("high"))
