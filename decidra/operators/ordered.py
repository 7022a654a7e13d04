"""Places in an order and values at places, for groups of any size.

Row numbers come from a sort by range: a group may lie on many parts, and a row's number is its place in the part plus the rows
of the group in the parts before. Values at places are found by radix selection: a histogram of BUCKETS between the
smallest and the largest value that is still possible, the bucket that holds the place, and so on, so that nothing
is sorted and equal values never meet in one task but as a count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.sources.scratch import stored

BUCKETS = 4096


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with _g, a key of the group that nulls don't part."""
    return rows.withColumn("_g", F.struct(F.lit(0), *by))


def numbered(rows: DataFrame, by: list[str], order: str | list[str], name: str) -> DataFrame:
    """Places of the rows of each group in an order (nulls first), from 0 on; equal rows in the order of a hash, then as they are read."""
    keyed = rows.withColumns({"_tie": F.xxhash64(*rows.columns), "_read": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in (*by, *([order] if isinstance(order, str) else order), "_tie", "_read")]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_read").withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumns({"_group": F.struct(F.lit(0), *by), "_part": F.shiftright("_at", 33)}))
    parts = ranged.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(parts.select("_group", "_part", (before - F.col("_first")).alias("_shift")), ["_group", "_part"])
    return placed.select(*[c for c in rows.columns if c != name], (F.col("_at") + F.col("_shift")).alias(name))


def _bucket(v: Column, low: Column, high: Column, kind: str, skip: Column) -> Column:
    """A number that grows with v from low (0) to high (BUCKETS - 1), which are alone in theirs but for equal values."""
    last = BUCKETS - 2
    if kind == "string":  # the six bytes behind what low and high have in common
        number = lambda c: F.conv(F.rpad(F.substring(F.hex(F.encode(F.substring(c, skip + 1, F.lit(6)), "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("decimal(20,0)")
    else:
        number = lambda c: c.cast("decimal(20,0)")
    if kind in ("double", "float"):
        share = F.try_divide(v / 2 - low / 2, high / 2 - low / 2)
        inner = F.floor(F.when(share.between(0, 1), share).otherwise(0.0) * last).cast("long")
    else:
        inner = F.call_function("div", (number(v) - number(low)) * F.lit(last).cast("decimal(5,0)"), number(high) - number(low) + 1)
    return F.when(v == low, 0).when(v == high, BUCKETS - 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(last), inner))).cast("int")


def _common(low: Column, high: Column) -> Column:
    """Characters that both begin with."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high)))), lambda k: (F.length(low) >= k) & (F.length(high) >= k) & (F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k))))


def selected(rows: DataFrame, wanted: DataFrame, keys: list[str], sums: list[str], settled: Callable[[], Column] | None = None) -> DataFrame:
    """The bucket of equal keys that holds the k-th row of each group, for rows (_g, keys, _n, sums) of weight _n.

    wanted has _g, _name and _k, from 1 on. Returned are _name, _k (the place inside the bucket), _n, the keys, the sums of the
    bucket and, as _before_..., those of all before it. A place that is settled (a condition on these columns) is not looked
    for any further, and its keys may be null. Each pass reads the rows once and shuffles BUCKETS counts for each place at most.
    """
    kinds, out = dict(rows.dtypes), ["_g", "_name", "_k", "_n", *keys, *sums, *[f"_before_{s}" for s in sums]]
    now = wanted.select("_g", "_name", "_k", *[F.lit(0).cast(kinds[s]).alias(f"_before_{s}") for s in sums], *[F.lit(None).cast(kinds[c]).alias(c) for c in keys])
    done = now.where("false").withColumns({c: F.lit(0).cast(kinds[c]) for c in ("_n", *sums)}).select(*out)
    settled = settled or (lambda: F.lit(False))
    for number, key in enumerate(keys):
        same = lambda c: F.col(f"r.{c}") == F.col(f"w.{c}")
        held = [same(c) for c in keys[:number]]
        ends = rows.alias("r").join(now.alias("w"), [same("_g"), *held]).groupBy("w._g", "w._name").agg(F.min(f"r.{key}").alias("_low"), F.max(f"r.{key}").alias("_high"))
        skip = _common(F.col("_low"), F.col("_high")) if kinds[key] == "string" else F.lit(0)
        now = stored(now.join(ends, ["_g", "_name"]).withColumn("_skip", skip))
        rest = None
        while now.limit(1).count():
            v = F.col(f"r.{key}")
            inside = rows.alias("r").join(now.alias("w"), [same("_g"), *held]).where(v.between(F.col("w._low"), F.col("w._high")))
            bucket = _bucket(v, F.col("w._low"), F.col("w._high"), kinds[key], F.col("w._skip"))
            counts = inside.groupBy("w._g", "w._name", bucket.alias("_b")).agg(F.min(v).alias("_min"), F.max(v).alias("_max"), F.sum("r._n").alias("_n"), *[F.sum(f"r.{s}").alias(s) for s in sums])
            upto = Window.partitionBy("_g", "_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            ahead = counts.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_up_{c}") for c in ("_n", *sums)])
            found = ahead.join(now.drop("_low", "_high", "_skip", "_n", *sums), ["_g", "_name"]).where("_up__n < _k and _k <= _up__n + _n")
            found = found.withColumns({"_k": F.col("_k") - F.col("_up__n"), **{f"_before_{s}": F.col(f"_before_{s}") + F.col(f"_up_{s}") for s in sums}, key: F.when(F.col("_min") == F.col("_max"), F.col("_min"))})
            found = stored(found.withColumn("_over", F.col(key).isNotNull()).withColumn("_settled", settled()))
            over = found.where("_over or _settled").select(*out, "_settled")
            rest = over if rest is None else rest.union(over)
            now = found.where("not _over and not _settled").select(*[c for c in now.columns if c not in ("_low", "_high", "_skip", "_n", *sums)], F.col("_min").alias("_low"), F.col("_max").alias("_high")).withColumn("_skip", skip)
        if rest is None:
            return done
        if number == len(keys) - 1:
            return done.union(rest.select(*out))
        done = done.union(rest.where("_settled").select(*out))
        now = rest.where("not _settled").select("_g", "_name", "_k", *[f"_before_{s}" for s in sums], *keys)
    return done


def nth_values(rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at places (0-based, of the number of rows) of each group's sorted values, as columns of these names."""
    counts = stored(grouped(rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n")), by))
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("_all"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("_all")).cast("long").alias("k")) for k, f in places.items()]))
    wanted = sizes.select("_g", asked.alias("x")).select("_g", F.col("x.name").alias("_name"), (F.col("x.k") + 1).alias("_k"))
    found = selected(counts.select("_g", "_v", "_n"), wanted, ["_v"], [])
    out = found.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in places])
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in by], *places)


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of each group, the mean of the two middle values where their number is even; null where there is no value."""
    found = nth_values(rows, by, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"x.{c}")) for c in by]
    joined = rows.select(*by).distinct().alias("o").join(found.alias("x"), keys or F.lit(True), "left")
    return joined.select(*[F.col(f"o.{c}") for c in by], ((F.col("x._low") + F.col("x._high")) / 2).alias(value))
