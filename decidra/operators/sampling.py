"""Samples, splits and picks, decided by hashes of keys: the same rows at any partitioning and in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions.numeric import hash_order, hash_unit

#: Rows of a table of options, which every task gets.
MOST_OPTIONS = 10_000


def bernoulli(rows: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    return rows.where(hash_unit(F.col(key), seed) < share)


def pick(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement: a top-n, no full sort."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def top_per_group(rows: DataFrame, by: list[str], n: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def pick_per_group(rows: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """Up to n rows of each group, by hash. Spark keeps the best n of a group before the shuffle."""
    return top_per_group(rows, by, n, hash_order(F.col(key), seed), F.col(key))


def half_positive(rows: DataFrame, by: list[str], key: str, label: str, k: int, seed: str) -> DataFrame:
    """k rows of a group, half of them positive where there are enough; negatives fill up."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, label).orderBy(hash_order(F.col(key), seed), key)))
    best = ranked.where(F.col("_r") <= k)
    kp = best.groupBy(*by).agg(F.least(F.count_if(F.col(label) == 1), F.lit(k // 2)).alias("_kp"))
    return best.join(kp, by).where(F.when(F.col(label) == 1, F.col("_r") <= F.col("_kp")).otherwise(F.col("_r") <= k - F.col("_kp"))).drop("_r", "_kp")


def group_split(rows: DataFrame, group: str, order: str, last: int) -> DataFrame:
    """The last groups by first appearance become validation; a group is never on both sides."""
    groups = rows.groupBy(group).agg(F.min(order).alias("_first"))
    held = groups.orderBy(F.desc("_first")).limit(last).select(group, F.lit("validation").alias("split"))
    return rows.join(held, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def hash_split(rows: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    return rows.withColumn("split", F.when(hash_unit(F.col(group), seed) < share, "validation").otherwise("train"))


def quota(rows: DataFrame, group: str, key: str, total: int, seed: str) -> DataFrame:
    """The same number of rows of each group, total in all, one at least."""
    n = rows.select(group).distinct().count()
    return pick_per_group(rows, [group], key, max(1, total // max(1, n)), seed)


def oversampled(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.union(rows.where(condition))


def policy(unit: Column, mix: dict[str, float]) -> Column:
    """A choice by cumulative shares of a uniform number; the last takes the rest."""
    *first, rest = mix
    out, total = F, 0.0
    for name in first:
        total += mix[name]
        out = out.when(unit < total, name)
    return out.otherwise(rest)


def chosen(options: Column, key: Column, seed: str) -> Column:
    """One element of an array, by hash."""
    return F.element_at(options, (F.pmod(F.floor(hash_unit(key, seed) * 4294967296.0).cast("long"), F.size(options)) + 1).cast("int"))


def distractors(rows: DataFrame, key: str, gold: str, options: DataFrame, option: str, n: int, seed: str) -> DataFrame:
    """The right option and n others of a small table, in hashed order; more than MOST_OPTIONS rows are an error."""
    if options.limit(MOST_OPTIONS + 1).count() > MOST_OPTIONS:
        raise ValueError(f"options must have at most {MOST_OPTIONS} rows")
    every = options.agg(F.collect_set(option).alias("_all"))
    with_all = rows.join(F.broadcast(every))
    draw = lambda o, s: F.struct(F.md5(F.concat_ws(":", F.lit(s), F.col(key).cast("string"), o)).alias("h"), o.alias("o"))
    others = F.slice(F.array_sort(F.transform(F.filter("_all", lambda o: o != F.col(gold)), lambda o: draw(o, seed))), 1, n)
    mixed = F.array_sort(F.transform(F.concat(F.transform(others, lambda x: x["o"]), F.array(gold)), lambda o: draw(o, f"{seed}!")))
    return with_all.withColumn("options", F.transform(mixed, lambda x: x["o"])).drop("_all")
