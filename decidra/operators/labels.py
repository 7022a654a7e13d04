"""Labels of recorded steps from what the environment shows: effect, noise, done and what can be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decidra.functions import text as X

PIXELS = 0.02


def effect(url_changed: Column, dom_changed: Column, value_applied: Column, pix_change: Column) -> Column:
    return (url_changed | dom_changed | value_applied | (pix_change > PIXELS)).cast("int")


def noisy(url_changed: Column, dom_changed: Column, pix_noise: Column) -> Column:
    return ((pix_noise > PIXELS) & ~url_changed & ~dom_changed).cast("int")


def value_applied(action: Column, typed: Column, values: Column) -> Column:
    return (action == "type") & (typed != "") & F.exists(values, lambda v: F.lower(F.trim(v)) == F.lower(typed))


def pixel_difference(a: Column, b: Column, levels: int = 16) -> Column:
    """Share of places of two grey images (arrays of equal size) that differ by levels or more."""
    apart = F.zip_with(a, b, lambda x, y: (F.abs(x - y) >= levels).cast("int"))
    return F.try_divide(F.aggregate(apart, F.lit(0), lambda s, x: s + x), F.size(apart))


def find_target(boxes: Column, target: Column, near: float = 4.0) -> Column:
    """Place (from 1) of the box with the target's tag, text and position, else of the first with its tag and text."""
    same = lambda b: (b["tag"] == target["tag"]) & (b["text"] == target["text"])
    exact = F.array_position(F.transform(boxes, lambda b: same(b) & (F.abs(b["x"] - target["x"]) < near) & (F.abs(b["y"] - target["y"]) < near)), True)
    return F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(F.array_position(F.transform(boxes, same), True), F.lit(0)))


def recorded_done(steps: DataFrame, episode: list[str], step: str, done: Column) -> DataFrame:
    """The recorder's labels: once done, done in all later steps."""
    before = Window.partitionBy(*episode).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    now = steps.withColumn("_done", done.cast("int"))
    return now.withColumn("done_before", F.coalesce(F.max("_done").over(before), F.lit(0))).withColumn("done_after", F.greatest("done_before", "_done")).drop("_done")


def relabelled(steps: DataFrame) -> DataFrame:
    """done and skip of search and follow goals from the address of each step itself, not from earlier ones.

    A follow goal without a link is done at the page where its episode was first recorded as done; if there is none, and for
    click goals, recorded labels stay. Steps come as in schemas.STEP; column flipped tells where done changed.
    """
    episode = F.regexp_replace("id", "_[^_]*$", "")
    steps = steps.withColumn("_episode", episode)
    known = steps.where((F.col("goal_kind") == "follow") & (F.coalesce("target_href", F.lit("")) == "") & (F.col("labels.done_after") == 1))
    targets = known.groupBy("site", "_episode").agg(F.min_by("after_url", "step").alias("_target"))
    rows = steps.join(targets, ["site", "_episode"], "left")

    def done(url: str) -> Column:
        follow = F.when(F.coalesce("target_href", F.lit("")) != "", X.follow_done(F.col(url), F.col("target_href"), F.col("start_url"))).when(F.col("_target").isNotNull(), X.normalised(F.col(url)) == X.normalised(F.col("_target")))
        return F.when(F.col("goal_kind") == "search", X.search_done(F.col(url), F.col("goal_value"))).when(F.col("goal_kind") == "follow", follow).cast("int")

    rows = rows.withColumn("_before", done("before_url")).withColumn("_after", done("after_url"))
    fixed = F.col("_before").isNotNull()

    def skipped(s: Column) -> Column:
        text = X.first(F.filter("candidates", lambda c: c["k"] == s["k"]))["text"]
        holds = (F.col("goal_kind") == "search") & F.coalesce(F.col("target_idx") == s["k"].cast("string"), F.lit(False)) & (F.lower(F.trim(X.field_value(text))) == F.lower("goal_value"))
        return F.struct(s["k"].alias("k"), F.when(fixed, (F.coalesce(holds, F.lit(False)) | (F.col("_before") == 1)).cast("int")).otherwise(s["v"]).alias("v"))

    labels = F.struct(F.transform("labels.skip", skipped).alias("skip"), F.col("labels.effect").alias("effect"), F.coalesce("_before", "labels.done_before").alias("done_before"), F.coalesce("_after", "labels.done_after").alias("done_after"), F.col("labels.noisy").alias("noisy"))
    flipped = fixed & ((F.col("_before") != F.col("labels.done_before")) | (F.col("_after") != F.col("labels.done_after")))
    return rows.withColumn("flipped", flipped).withColumn("labels", labels).drop("_episode", "_target", "_before", "_after")


def goals(elements: DataFrame) -> DataFrame:
    """Kinds of goal an element can be: a link to follow, a field to search, a button to click."""
    href = F.coalesce("href", F.lit(""))
    link = (F.col("tag") == "a") & (F.length("text").between(3, 40)) & (href != "") & ~href.rlike("^(?:#|javascript|mailto)")
    field = F.col("tag").isin("input", "textarea") & F.coalesce("type", F.lit("")).isin("", "text", "search")
    button = (F.col("tag") == "button") & (F.length("text") >= 2)
    return elements.withColumn("goal_kind", F.when(link, "follow").when(field, "search").when(button, "click")).where("goal_kind is not null")
