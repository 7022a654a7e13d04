"""Joins of the engine that are more than an equality: fan-out, ranges, hard negatives, priors and resumption."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.sources.scratch import stored

from .ordered import grouped, numbered


def resumed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def fan_out(big: DataFrame, small: DataFrame, key: str, per_key: int, order: str) -> DataFrame:
    """Up to per_key rows of small for each row of big. Small is cut first, so adaptive execution may broadcast it."""
    cut = small.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= per_key).drop("_r")
    return big.join(cut, key)


def near(left: DataFrame, right: DataFrame, keys: list[str], value: str, reach: float) -> DataFrame:
    """Pairs with equal keys and values less than reach apart: each left row looks into three cells of a grid."""
    cell = lambda c: F.floor(F.col(c) / reach)
    looked = left.withColumn("_cell", F.explode(F.array(cell(value) - 1, cell(value), cell(value) + 1)))
    placed = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], cell(value).alias("_cell"))
    return looked.join(placed, [*keys, "_cell"]).where(F.abs(F.col(value) - F.col(f"r_{value}")) < reach).drop("_cell")


def nearest(rows: DataFrame, keys: list[str], key: str, coordinates: dict[str, float], k: int, jitter: Column | None = None, others: tuple[str, DataFrame] | None = None, most: float = 1.0) -> DataFrame:
    """The k nearest other rows of each row with equal keys: key, other, distance and rank; key must be unique.

    The distance is the sum of weighted differences of the coordinates, ties by the other's key. Rows look into the cells around
    their own in a grid with about one row to a cell, and those that don't find k rows nearer than any cell left out look
    again with cells twice as wide, until a cell is as wide as the group. Of rows at one place only the first k + 1 can be
    among anyone's nearest, so no more are looked at. jitter (from 0 to less than most, of `a` and `b`, the keys of a pair) is added to
    the distance; then all rows at a place are looked at, but pairs go on only within a reach that should hold a few more than k
    (if it doesn't, it is doubled with the cells). With others, a column and the rows that ask, only rows with another value there count.
    """
    xs = [f"_x{i}" for i in range(len(coordinates))]
    scaled = [(F.col(c) * w).cast("double").alias(x) for x, (c, w) in zip(xs, coordinates.items(), strict=True)]
    part = F.col(others[0]).alias("_part") if others else F.lit(None).cast("int").alias("_part")
    points = stored(grouped(rows, keys).select("_g", F.col(key).alias("a"), part, *scaled))
    if jitter is None:
        place = Window.partitionBy("_g", "_part", *xs).orderBy("a")
        known = stored(points.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r"))
    else:
        known = points
    spread = known.groupBy("_g").agg(F.count("*").alias("_n"), F.greatest(F.lit(0.0), *[F.max(x) - F.min(x) for x in xs]).alias("_range"))
    side = F.when(F.col("_range") > 0, F.col("_range") / F.ceil(F.pow(F.col("_n"), F.lit(1 / len(xs))))).otherwise(1.0)
    if jitter is None:
        spread = stored(spread.select("_g", "_range", side.alias("_side")))
    else:
        spread, points = _reaches(points, known, spread, xs, k, most, others is not None)
    cells = [f"_c{i}" for i in range(len(xs))]
    around = F.explode(F.array(*[F.struct(*[F.lit(o).alias(c) for o, c in zip(offset, cells, strict=True)]) for offset in product((-1, 0, 1), repeat=len(xs))]))
    rest, step, found = points.join(others[1].select(F.col(key).alias("a")), "a", "left_semi") if others else points, 0, []
    extra = [] if jitter is None else ["_own"]
    while True:
        width = F.col("_side") * 2.0**step
        cell = [F.floor(F.col(x) / width) for x in xs]
        reach = width if jitter is None else F.least("_own", "_side") * 2.0**step
        whole = width >= F.col("_range") if jitter is None else (width >= F.col("_range")) & (reach >= F.col("_range") + most)
        looked = rest.join(spread, "_g").select("_g", "a", "_part", *xs, F.when(~whole, reach).alias("_reach"), *[c.alias(f"_o{n}") for n, c in zip(cells, cell, strict=True)], around.alias("_x"))
        looked = looked.select("_g", "a", "_part", *xs, "_reach", *[(F.col(f"_o{c}") + F.col(f"_x.{c}")).alias(c) for c in cells])
        placed = known.join(spread, "_g").select("_g", F.col("a").alias("b"), F.col("_part").alias("_other"), *[F.col(x).alias(f"_b{x}") for x in xs], *[c.alias(n) for n, c in zip(cells, cell, strict=True)])
        pairs = looked.join(placed, ["_g", *cells]).where("a <> b")
        if others:
            pairs = pairs.where(~F.col("_part").eqNullSafe(F.col("_other")))
        apart = sum((F.abs(F.col(x) - F.col(f"_b{x}")) for x in xs[1:]), F.abs(F.col(xs[0]) - F.col(f"_b{xs[0]}")))
        if jitter is None:
            pairs = pairs.select("a", "b", apart.alias("distance"))
        else:
            pairs = pairs.where(F.col("_reach").isNull() | (apart < F.col("_reach"))).select("a", "b", "_reach", (apart + jitter).alias("distance"))
            pairs = pairs.where(F.col("_reach").isNull() | (F.col("distance") < F.col("_reach")))
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= k)
        best = stored(best)
        last = best.groupBy("a").agg(F.count("*").alias("_k"), F.max("distance").alias("_last"))
        over = whole | ((F.col("_k") == k) & (F.col("_last") < reach * (1 - 1e-9)))
        judged = stored(rest.join(spread, "_g").join(last, "a", "left").select("_g", "a", "_part", *xs, *extra, F.coalesce(over, F.lit(False)).alias("_over")))
        found.append(best.join(judged.where("_over").select("a"), "a", "left_semi"))
        rest, step = judged.where("not _over").drop("_over"), step + 1
        if not rest.limit(1).count():
            break
    out = reduce(DataFrame.union, found)
    return out.select(F.col("a").alias(key), F.col("b").alias("other"), "distance", "rank")


def _reaches(points: DataFrame, known: DataFrame, spread: DataFrame, xs: list[str], k: int, most: float, others: bool) -> tuple[DataFrame, DataFrame]:
    """For distances with a jitter: width of each group's cells (_side), and of each row the reach into its own place (_own).

    A pair at one place is nearer than r with a chance of r / most, and about r * r / most rows of a density of 1 are. Both
    numbers are such that a few more than k rows are expected within them; what is found does not depend on them.
    """
    wanted = float((2 * k + 6) * most)
    parts = known.groupBy("_g", "_part").agg(F.count("*").alias("_rows")).groupBy("_g").agg(F.max("_rows").alias("_largest"))
    n = F.greatest(F.lit(1), F.col("_n") - F.col("_largest")) if others else F.col("_n")
    dense = F.when(F.col("_range") > 0, F.pow(F.pow(F.col("_range"), F.lit(len(xs))) * 2 * wanted / n, F.lit(1 / (len(xs) + 1))))
    spread = stored(spread.join(parts, "_g").select("_g", "_range", F.least(dense, wanted / n + F.col("_range")).alias("_side")))
    places = known.groupBy("_g", "_part", *xs).agg(F.count("*").alias("_rows"))
    beside = F.sum("_rows").over(Window.partitionBy("_g", *xs)) - F.col("_rows") if others else F.col("_rows") - 1
    places = places.select(*[F.col(c).alias(f"_p{c}") for c in ("_g", "_part", *xs)], F.when(beside > 0, wanted / beside).alias("_own"))
    same = [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in ("_g", "_part", *xs)]
    return spread, stored(points.join(places, same, "left").select("_g", "a", "_part", *xs, "_own"))


def prior_adjusted(scores: DataFrame, priors: DataFrame, keys: list[str]) -> DataFrame:
    """Conditional minus prior score; each distinct prior is joined once."""
    once = priors.groupBy(*keys).agg(F.max("score").alias("prior"))
    return scores.join(once, keys).withColumn("pmi", F.col("score") - F.col("prior"))


def positional(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows at equal places of two tables ordered by a number or a time."""
    return numbered(a, [], order_a, "_i").join(numbered(b, [], order_b, "_i"), "_i").drop("_i")


def round_robin(rows: DataFrame, by: str, ordinal: str, pool: DataFrame, order: str) -> DataFrame:
    """Row number ordinal of a group takes the pool's entry at that place, counted around."""
    placed = pool.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    sizes = pool.groupBy(by).agg(F.count("*").alias("_n"))
    return rows.join(sizes, by).withColumn("_r", F.pmod(F.col(ordinal), F.col("_n")).cast("int")).join(placed, [by, "_r"]).drop("_r", "_n")
