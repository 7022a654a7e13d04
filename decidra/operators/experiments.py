"""Summaries of experiments: latency, log-odds, tokenizers, runs of the verifier, throughput and tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.functions.numeric import log_odds

from .metrics import lower_middle, percentile_place, upper_middle, with_nth_values
from .ordered import medians


def latency_slopes(trials: DataFrame) -> DataFrame:
    """Per family: milliseconds per 1000 tokens fitted to the medians of each size, by two token counts.

    trials: family, target, billed_tokens, qwen_tokens, server_ms, status.
    """
    ok = trials.where("status = 200 and server_ms is not null")
    points = None
    for c in ("billed_tokens", "qwen_tokens", "server_ms"):
        part = medians(ok, ["family", "target"], c)
        points = part if points is None else points.alias("o").join(part.alias("x"), F.expr("o.family <=> x.family and o.target <=> x.target")).select("o.*", f"x.{c}")
    return points.groupBy("family").agg(
        F.count("*").alias("sizes"),
        (F.regr_slope("server_ms", "billed_tokens") * 1000).alias("ms_per_1k_billed"),
        (F.regr_slope("server_ms", "qwen_tokens") * 1000).alias("ms_per_1k_qwen"),
        F.regr_intercept("server_ms", "billed_tokens").alias("intercept"),
        F.try_divide(F.sum("billed_tokens"), F.sum("qwen_tokens")).alias("billed_per_qwen"),
    )


def paired_slopes(pairs: DataFrame) -> DataFrame:
    """Per family: median, mean and standard error of (long - short) milliseconds per 1000 billed tokens."""
    d = pairs.where("long.status = 200 and short.status = 200").select("family", (F.col("long.server_ms") - F.col("short.server_ms")).alias("ms"), (F.col("long.billed") - F.col("short.billed")).alias("billed"), (F.col("long.qwen") - F.col("short.qwen")).alias("qwen"))
    d = d.withColumn("slope", F.try_divide(F.col("ms") * 1000.0, F.col("billed")))
    middle = medians(d, ["family"], "slope").withColumnRenamed("slope", "median")
    sums = d.groupBy("family").agg(F.count("slope").alias("n"), F.avg("slope").alias("mean"), (F.stddev_samp("slope") / F.sqrt(F.count("slope"))).alias("se"), F.avg(F.try_divide("billed", "qwen")).alias("billed_per_qwen"))
    return sums.alias("o").join(middle.alias("x"), F.expr("o.family <=> x.family")).select("o.family", "o.n", "x.median", "o.mean", "o.se", "o.billed_per_qwen")


def pooled_log_odds(trials: DataFrame, pairs: list[tuple[str, str]], within: list[str], by: list[str]) -> DataFrame:
    """Mean log-odds of option pairs: first over the repeats of a block, then over blocks (columns hold the options' p)."""
    odds = trials.select(*dict.fromkeys([*within, *by]), *[log_odds(F.col(a), F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    blocks = odds.groupBy(*dict.fromkeys([*within, *by])).agg(*[F.avg(f"{a}_{b}").alias(f"{a}_{b}") for a, b in pairs])
    return blocks.groupBy(*by).agg(F.count("*").alias("blocks"), *[F.avg(f"{a}_{b}").alias(f"{a}_{b}") for a, b in pairs])


def ratios(rows: DataFrame, base: dict[str, object], columns: list[str], least: float = 0.15) -> DataFrame:
    """Columns over their value in the base row; null where that is within least of zero. More than one base row is an error."""
    condition = None
    for k, v in base.items():
        condition = (F.col(k) == v) if condition is None else condition & (F.col(k) == v)
    one = rows.where(condition).select(*[F.col(c).alias(f"_{c}") for c in columns])
    if one.limit(2).count() > 1:
        raise ValueError("base must name one row")
    out = rows.where(~condition).join(F.broadcast(one))
    return out.select(*[c for c in rows.columns if c not in columns], *[F.when(F.abs(f"_{c}") > least, F.col(c) / F.col(f"_{c}")).alias(c) for c in columns])


def tokenizer_agreement(counts: DataFrame) -> DataFrame:
    """Hits of candidate tokenizers per family and in all, with direction of the nearest misses.

    counts: tokenizer, family, text_id, expected, candidates (array of counts).
    """
    hit = F.array_contains("candidates", F.col("expected"))
    nearest = F.array_min(F.transform("candidates", lambda c: F.struct(F.abs(c - F.col("expected")).alias("d"), c.alias("c"))))["c"]
    rows = counts.select("tokenizer", "family", hit.cast("int").alias("hit"), F.signum(nearest - F.col("expected")).cast("int").alias("side"))
    agg = rows.rollup("tokenizer", "family").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.count_if(F.col("side") > 0).alias("over"), F.count_if(F.col("side") < 0).alias("under"))
    return agg.where("tokenizer is not null").withColumn("family", F.coalesce("family", F.lit("all")))


def run_summary(steps: DataFrame, run: str) -> DataFrame:
    """Runs of the verifier: steps, flags, first step that looks done, and agreement of effect with the page's change."""
    judged = F.col("effect_p").isNotNull()
    return steps.groupBy(run).agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("skip_p") > 0.5).alias("skip_flags"),
        F.count_if(judged & (F.col("effect_p") < 0.5)).alias("no_effect_flags"),
        F.min(F.when(F.col("done_p") > 0.5, F.col("step"))).alias("first_done_step"),
        F.avg(F.when(judged, ((F.col("effect_p") > 0.5) == F.coalesce("page_changed", F.lit(False))).cast("int"))).alias("agreement"),
    )


def loop_summary(runs: DataFrame) -> DataFrame:
    """Live loops: success at the end, after the first action, and mean time of the model."""
    return runs.groupBy("tag").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("success"), F.avg(F.col("first_success").cast("int")).alias("first_action_success"), F.avg("model_ms").alias("model_ms"))


def throughput(requests: DataFrame) -> DataFrame:
    """Per concurrency: requests, requests per second, and the median and 90th percentile of the time of one."""
    sums = requests.groupBy("concurrency").agg(F.count("*").alias("n"), (F.count("*") / F.max("wall_s")).alias("req_s"))
    out = with_nth_values(sums, requests, ["concurrency"], "ms", {"low": lower_middle, "high": upper_middle, "p90": percentile_place(0.9)})
    return out.select("concurrency", "n", "req_s", ((F.col("low") + F.col("high")) / 2).alias("p50"), "p90")


def tiers(rows: DataFrame) -> DataFrame:
    """Accuracy and upper median time of each tier and of each type in it; type null is the whole tier."""
    sums = rows.groupingSets([("tier", "type"), ("tier",)], "tier", "type").agg(F.count("*").alias("n"), F.avg("hit").alias("acc"))
    both = rows.select("tier", F.explode(F.array("type", F.lit(None))).alias("type"), "ms")
    return with_nth_values(sums, both, ["tier", "type"], "ms", {"p50": upper_middle})


def forms(rows: DataFrame) -> DataFrame:
    """Overlapping groups of form items: all, each action, and each kind."""
    grouped = rows.select(F.explode(F.array_distinct(F.array(F.lit("all"), "action", "kind"))).alias("group"), "hit", "conf", "ms")
    return with_nth_values(grouped.groupBy("group").agg(F.count("*").alias("n"), F.avg("hit").alias("acc")), grouped, ["group"], "ms", {"p50": upper_middle})


def capability(rows: DataFrame, split: str, at: int) -> DataFrame:
    """Accuracy, mean top share and mean share of the right answer by family; one family also by position before and from at on."""
    variant = F.when(F.col("position") < at, f"{split} 0-{at - 1}").otherwise(f"{split} {at}-{2 * at - 1}")
    named = rows.select(F.explode(F.when(F.col("family") == split, F.array("family", variant)).otherwise(F.array("family"))).alias("family"), "hit", "top", "right")
    return named.groupBy("family").agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("top").alias("top"), F.avg("right").alias("right"))


def confidence_buckets(rows: DataFrame, edges: list[float]) -> DataFrame:
    """Counts by bucket of confidence and by whether the row was meant to be ambiguous."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("conf") >= e).cast("int")
    return rows.where("conf is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"), F.count_if(~F.col("ambiguous")).alias("plain"))


def paired_effects(rows: DataFrame) -> DataFrame:
    """Mean change and its standard error over blocks: first the mean of (after - before) within a block."""
    blocks = rows.groupBy("condition", "block").agg(F.avg(F.col("after") - F.col("before")).alias("change"))
    return blocks.groupBy("condition").agg(F.count("*").alias("blocks"), F.avg("change").alias("mean"), (F.stddev_samp("change") / F.sqrt(F.count("*"))).alias("se"))


def largest_gap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The largest difference of two sets of probabilities, for checks that questions don't see each other."""
    return a.select(*key, F.col("p").alias("pa")).join(b.select(*key, F.col("p").alias("pb")), key).agg(F.count("*").alias("n"), F.max(F.abs(F.col("pa") - F.col("pb"))).alias("gap"))


def usage_cost(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), ((F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1e6).alias("cost"))
