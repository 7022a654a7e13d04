"""Temperatures: sweeps, fits over a grid, and curves of escalation to a second system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.functions import numeric as N

from . import metrics as M

#: The grid i / 20 for yes/no answers, and the thresholds of the escalation curve.
NOUL_GRID = [i / 20 for i in range(1, 400)]
CHOICE_GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0]
TAUS = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]


def grid(values: list[float]) -> Column:
    """The values as rows; they are few and fixed, so no join is needed."""
    return F.explode(F.array(*[F.lit(float(v)) for v in values]))


def fit_noul(rows: DataFrame, by: list[str], values: list[float] = NOUL_GRID) -> DataFrame:
    """The temperature with the least mean NLL of yes/no answers (p, y); of equal ones the smallest.

    Answers of equal p and y are counted first, so the grid multiplies distinct answers.
    """
    counted = rows.where("p is not null and y is not null").groupBy(*by, "p", "y").agg(F.count("*").alias("n"))
    tried = counted.withColumn("z", N.logit(F.col("p"))).select(*by, "y", "n", "z", grid(values).alias("t"))
    share = N.sigmoid(F.col("z") / F.col("t"))
    loss = F.when(F.col("y") == 1, N.nll(share)).otherwise(N.nll(1 - share))
    losses = tried.groupBy(*by, "t").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("nll"))
    return losses.groupBy(*by).agg(F.min_by("t", F.struct(F.round("nll", 9).alias("l"), "t")).alias("temperature"), F.min("nll").alias("nll"))


def fit_choice(rows: DataFrame, values: list[float] = CHOICE_GRID) -> DataFrame:
    """The temperature at which the mean largest share comes closest to the accuracy (logits, gold)."""
    tried = rows.select("logits", "gold", grid(values).alias("t"))
    hit = (N.arg_max(F.col("logits")) == F.col("gold")).cast("int")
    gaps = tried.groupBy("t").agg(F.abs(F.avg(F.array_max(N.softmax(F.col("logits"), F.col("t")))) - F.avg(hit)).alias("gap"))
    return gaps.agg(F.min_by("t", F.struct(F.round("gap", 9).alias("g"), "t")).alias("temperature"), F.min("gap").alias("gap"))


def sweep(rows: DataFrame, values: list[float]) -> DataFrame:
    """Accuracy, NLL, mean largest share, ECE and Brier of choices (id, logits, gold) at each temperature."""
    tried = rows.select("id", "gold", "logits", grid(values).alias("t")).withColumn("p", N.softmax(F.col("logits"), F.col("t")))
    top = tried.select("t", "gold", F.array_max("p").alias("conf"), (N.arg_max(F.col("p")) == F.col("gold")).cast("int").alias("hit"), F.element_at("p", F.col("gold").cast("int") + 1).alias("gp"), N.brier(F.col("p"), F.col("gold")).alias("brier"))
    means = top.groupBy("t").agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg(N.nll(F.col("gp"))).alias("nll"), F.avg("conf").alias("mean_top_p"), F.avg("brier").alias("brier"))
    return means.join(M.ece(top, ["t"]), "t")


def escalation(student: DataFrame, teacher: DataFrame, student_ms: float, teacher_ms: float, student_cost: float, teacher_cost: float, taus: list[float] = TAUS) -> DataFrame:
    """Per threshold: the share sent on (conf below it), combined accuracy, mean time and cost; tau null sends on errors.

    student: id, conf, hit; teacher: id, hit.
    """
    both = student.join(teacher.select("id", F.col("hit").alias("t_hit")), "id")
    rows = both.select("*", F.explode(F.array(*[F.lit(x) for x in taus], F.lit(None).cast("double"))).alias("tau"))
    sent = F.when(F.col("tau").isNull(), F.col("hit") == 0).otherwise(F.col("conf") < F.col("tau"))
    out = rows.groupBy("tau").agg(F.avg(sent.cast("int")).alias("escalated"), F.avg(F.when(sent, F.col("t_hit")).otherwise(F.col("hit"))).alias("acc"))
    return out.select("*", (F.lit(student_ms) + F.col("escalated") * teacher_ms).alias("ms"), (F.lit(student_cost) + F.col("escalated") * teacher_cost).alias("cost"))


def calibrated(rows: DataFrame, fitted: DataFrame, by: list[str]) -> DataFrame:
    """rows (p, y) with p, conf and hit at the fitted temperature of their group; yes from 0.5 on."""
    hot = rows.join(fitted.select(*by, "temperature"), by)  # adaptive execution broadcasts it where it is small
    p = N.sigmoid(N.logit(F.col("p")) / F.col("temperature"))
    return hot.withColumn("p", p).withColumn("conf", N.top_confidence(F.col("p"))).withColumn("hit", ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))
