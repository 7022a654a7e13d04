"""Scores of predictions: accuracy, calibration, ranking and selection, over any grouping columns.

Rank-based figures never sort a whole group in one task. For the area under the curve scores are first counted in buckets of
equal width; sums over the few buckets of a group give each bucket's offset, and only distinct scores inside a bucket are
ordered. Cuts and values at places come from radix selection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions import numeric as N
from decidra.sources.scratch import stored

from .ordered import grouped, nth_values, selected

BUCKETS = 4096


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the last by order; a partial aggregate before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def scored(items: DataFrame, predictions: DataFrame, inclusive: bool = False) -> DataFrame:
    """Items (id, question, type, label) with their predictions (id, p, choice, ms): p, y, conf and hit.

    A yes/no item is answered yes if p > 0.5, or p >= 0.5 where inclusive; its confidence is that of the answer. A choice is
    right if it equals the label; its confidence is p, 1 where none is given. Items without prediction stay with nulls.
    """
    own = items.join(predictions.select("id", F.col("p").alias("_p"), F.col("choice").alias("_choice"), "ms", F.lit(True).alias("_there")), "id", "left")
    noul = F.col("type") == "noul"
    yes = (F.col("_p") >= 0.5) if inclusive else (F.col("_p") > 0.5)
    hit = F.when(noul, yes == (F.col("label") == "1")).otherwise(F.coalesce("_choice", F.lit("None")) == F.col("label"))
    return own.select(
        *[c for c in items.columns],
        F.col("_there").isNotNull().alias("answered"),
        F.when(noul, F.col("_p")).otherwise(F.coalesce("_p", F.lit(1.0))).alias("p"),
        F.when(noul, (F.col("label") == "1").cast("int")).otherwise(hit.cast("int")).alias("y"),
        F.when(noul, F.when(yes, F.col("_p")).otherwise(1 - F.col("_p"))).otherwise(F.coalesce("_p", F.lit(1.0))).alias("conf"),
        F.when(F.col("_there"), hit.cast("int")).alias("hit"),
        "ms",
    )


def calibration_bin(conf: Column, bins: int = 10) -> Column:
    return F.least(F.lit(bins - 1), F.floor(conf * bins)).cast("long")


def reliability(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Per group and bin of confidence: n, mean confidence and accuracy."""
    kept = rows.where("conf is not null").withColumn("bin", calibration_bin(F.col("conf"), bins))
    return kept.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("hit").alias("acc"))


def ece(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error: the mean gap of confidence and accuracy, weighted by the bins' rows."""
    return reliability(rows, by, bins).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def auroc(rows: DataFrame, by: list[str], score: str = "p", label: str = "y", name: str = "auroc") -> DataFrame:
    """P(score of a positive > score of a negative), ties half; null where a class is empty.

    Equal scores are one row after a partial aggregate, so the windows run over distinct scores of one bucket.
    """
    kept = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = kept.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = counts.withColumn("b", F.floor(F.col("s") * BUCKETS))
    totals = counts.groupBy(*by, "b").agg(F.sum("neg").alias("n"))
    offsets = totals.withColumn("below", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2)
    ranked = counts.withColumn("inside", inside).join(offsets, [*by, "b"])
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(won), F.sum("pos") * F.sum("neg")).alias(name))


def selective(rows: DataFrame, by: list[str], coverages: dict[str, float], order: str = "id") -> DataFrame:
    """Accuracy of the most confident share of rows; of equal confidences the first by order (a number or a text) count.

    The last row that counts is found by radix selection, first by confidence, then by order inside one confidence. A bucket
    whose rows all hit, or none, or that counts as a whole is not split any further. Rows equal in both count with their hits first.
    """
    kept = grouped(rows.where("conf is not null and hit is not null"), by).select("_g", (-F.col("conf")).alias("_v"), F.col(order).alias("_o"), F.col("hit").cast("long").alias("hit"), F.lit(1).cast("long").alias("_n"))
    kept = stored(kept)
    shares = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("share")) for k, v in coverages.items()]))
    sizes = kept.groupBy("_g").agg(F.count("*").alias("_all")).select("_g", "_all", shares.alias("x"))
    wanted = stored(sizes.select("_g", F.col("x.name").alias("_name"), F.greatest(F.lit(1), F.bround(F.col("_all") * F.col("x.share"), 0)).cast("long").alias("_k")))
    found = selected(kept, wanted, ["_v", "_o"], ["hit"], lambda: (F.col("_k") == F.col("_n")) | (F.col("hit") == 0) | (F.col("hit") == F.col("_n")))
    won = found.select("_g", "_name", (F.col("_before_hit") + F.least("_k", "hit")).alias("_won"))
    got = won.join(wanted, ["_g", "_name"]).select("_g", "_name", (F.col("_won") / F.col("_k")).alias("acc"))
    out = got.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == k, F.col("acc"))).alias(k) for k in coverages])
    return out.select(*[F.col(f"_g.{c}").alias(c) for c in by], *coverages)


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """One pass: n, missing, acc, acc of either class (0 where it has no rows), n_pos, Brier, NLL and mean ms."""
    gold = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return rows.groupBy(*by).agg(
        F.count_if("answered").alias("n"),
        F.count_if(~F.col("answered")).alias("missing"),
        F.avg("hit").alias("acc"),
        F.coalesce(F.avg(F.when(F.col("y") == 1, F.col("hit"))), F.lit(0.0)).alias("acc_pos"),
        F.coalesce(F.avg(F.when(F.col("y") == 0, F.col("hit"))), F.lit(0.0)).alias("acc_neg"),
        F.count_if(F.col("answered") & (F.col("y") == 1)).alias("n_pos"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.avg(N.nll(gold)).alias("nll"),
        F.avg("ms").alias("ms"),
        F.count_if((F.col("hit") == 0) & (F.col("conf") >= 0.99)).alias("err_at_99"),
    )


def report(rows: DataFrame, by: list[str], order: str = "id") -> DataFrame:
    """All figures of a submission per group."""
    out = accuracy(rows, by)
    for part in (ece(rows, by), auroc(rows, by), selective(rows, by, {"sel80": 0.8, "sel90": 0.9}, order)):
        keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"x.{c}")) for c in by]
        out = out.alias("o").join(part.alias("x"), keys, "left").select("o.*", *[F.col(f"x.{c}") for c in part.columns if c not in by])
    return out


def rules(items: DataFrame) -> DataFrame:
    """The baseline without a model: effect is likely where the address or the elements changed, all else is not."""
    changed = ~F.col("url_before").eqNullSafe(F.col("url_after")) | ~F.col("elements_before").eqNullSafe(F.col("elements_after"))
    return items.where(F.col("type") == "noul").select("id", F.when((F.col("question") == "effect") & changed, 0.9).otherwise(0.1).alias("p"))


def agreement(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows that both systems answered, and the share of equal answers (column answer)."""
    both = a.select(key, F.col("answer").alias("a")).join(b.select(key, F.col("answer").alias("b")), key)
    return both.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"))


def audit(answers: DataFrame) -> DataFrame:
    """Human audit: agreement over yes and no, and the unsure ones."""
    sure = F.col("answer").isin("yes", "no")
    return answers.agg(F.count_if(sure).alias("n"), F.avg(F.when(sure, (F.col("answer") == F.col("expected")).cast("int"))).alias("agreement"), F.count_if(~sure).alias("unsure"))


def with_nth_values(report: DataFrame, rows: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """report, of a row for each group, with columns of nth_values."""
    keys = [F.col(f"o.{c}").eqNullSafe(F.col(f"x.{c}")) for c in by]
    return report.alias("o").join(nth_values(rows, by, value, places).alias("x"), keys, "left").select("o.*", *[F.col(f"x.{c}") for c in places])


def upper_middle(n: Column) -> Column:
    """The place in the middle, of an even number the upper one."""
    return F.floor(n / 2)


def lower_middle(n: Column) -> Column:
    return F.floor((n - 1) / 2)


def percentile_place(share: float) -> Callable[[Column], Column]:
    """The place int(share * n) - 1, the first at least."""
    return lambda n: F.greatest(F.lit(0), F.floor(n * share) - 1)


def vote_shares(votes: DataFrame, by: list[str], vote: str, keys: list[str]) -> DataFrame:
    """Share of each key among a group's votes, 0 for keys without one; other votes count in none."""
    valid = votes.where(F.col(vote).isin(keys))
    counts = valid.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(vote) == k).alias(f"_{i}") for i, k in enumerate(keys)])
    return counts.select(*by, "n", *[(F.col(f"_{i}") / F.col("n")).alias(k) for i, k in enumerate(keys)])


def crosstab(rows: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    """A row for each value of row, a column for each of the given values of column, 0 where there is none."""
    return rows.groupBy(row).pivot(column, values).agg(value).na.fill(0)


def ordered_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups in order of their keys, with size and place; there are as many rows as groups, so the sort is of a report."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(*[F.col(c).asc_nulls_first() for c in by]))).orderBy("place")
