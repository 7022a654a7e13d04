"""Queries on experiments, aggregates and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.operators import experiments as E
from decidra.operators import metrics as M
from decidra.operators.ordered import nth_values
from decidra.sources import readers as R
from decidra.sources.logsource import registered
from decidra.sources.scratch import folder
from decidra.streaming import logs
from decidra.streaming.episodes import closed, state_store

from .registry import query
from .scoring import rounded, scored
from .standins import SCORED_SQL, episodes, table

_TRIALS = """t AS (SELECT event_type AS family, (user_id % 8) AS target, (user_id % 8) * 100 + event_id % 13 AS billed, (user_id % 8) * 90 + event_id % 7 AS qwen, ((user_id % 8) * 3 + value)::DOUBLE AS ms, CASE WHEN event_id % 29 = 0 THEN 500 ELSE 200 END AS status FROM events)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, size = table(spark, sf_dir, "events"), F.col("user_id") % 8
    return e.select(
        F.col("event_type").alias("family"),
        size.alias("target"),
        (size * 100 + F.col("event_id") % 13).alias("billed_tokens"),
        (size * 90 + F.col("event_id") % 7).alias("qwen_tokens"),
        (size * 3 + F.col("value")).alias("server_ms"),
        F.when(F.col("event_id") % 29 == 0, 500).otherwise(200).alias("status"),
    )


@query(f"""WITH {_TRIALS}, p AS (SELECT family, target, median(billed) AS b, median(qwen) AS q, median(ms) AS m FROM t WHERE status = 200 AND ms IS NOT NULL GROUP BY ALL)
SELECT family, count(*) AS sizes, round(regr_slope(m, b) * 1000, 4) AS ms_per_1k_billed, round(regr_slope(m, q) * 1000, 4) AS ms_per_1k_qwen, round(regr_intercept(m, b), 4) AS intercept, round(sum(b) / sum(q), 6) AS billed_per_qwen FROM p GROUP BY family""")
def latency_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(E.latency_slopes(trials(spark, sf_dir)), "ms_per_1k_billed", "ms_per_1k_qwen", "intercept", places=4)
    return rounded(out, "billed_per_qwen")


@query("""WITH e AS (SELECT user_id AS pair, event_type AS family, max(value) AS l, min(value) AS s, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT family, (l - s) * 1000 / (n * 10) AS slope, n * 10 / (n * 8)::DOUBLE AS r FROM e)
SELECT family, count(*) AS n, round(median(slope), 4) AS median, round(avg(slope), 4) AS mean, round(stddev_samp(slope) / sqrt(count(*)), 4) AS se, round(avg(r), 6) AS billed_per_qwen FROM d GROUP BY family""")
def paired_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pair"), F.col("event_type").alias("family")).agg(F.max("value").alias("l"), F.min("value").alias("s"), F.count("*").alias("n"))
    arm = lambda ms, k: F.struct(F.lit(200).alias("status"), F.col(ms).alias("server_ms"), (F.col("n") * 10 * k).alias("billed"), (F.col("n") * 8 * k).alias("qwen"))
    pairs = e.select("family", "pair", arm("l", 2).alias("long"), arm("s", 1).alias("short"))
    return rounded(rounded(E.paired_slopes(pairs), "median", "mean", "se", places=4), "billed_per_qwen")


@query("""WITH t AS (SELECT user_id % 5 AS block, event_type AS content, (event_id % 3) * 4 + 4 AS k, event_id % 11 / 11.0::DOUBLE AS a, event_id % 7 / 7.0::DOUBLE AS b FROM events),
o AS (SELECT block, content, k, avg(ln(greatest(a, 0.005) / greatest(b, 0.005))) AS o FROM t GROUP BY ALL), r AS (SELECT k, content, count(*) AS blocks, avg(o) AS o FROM o GROUP BY ALL)
SELECT k, content, blocks, round(o, 6) AS a_b FROM r""")
def two_level_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.pooled_log_odds(_sweep(spark, sf_dir), [("a", "b")], ["block"], ["k", "content"]), "a_b")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 5).alias("block"), F.col("event_type").alias("content"), (F.col("event_id") % 3 * 4 + 4).alias("k"), (F.col("event_id") % 11 / F.lit(11.0)).alias("a"), (F.col("event_id") % 7 / F.lit(7.0)).alias("b"))


@query("""WITH t AS (SELECT user_id % 5 AS block, event_type AS content, (event_id % 3) * 4 + 4 AS k, event_id % 11 / 11.0::DOUBLE AS a, event_id % 7 / 7.0::DOUBLE AS b FROM events WHERE event_type = 'click'),
o AS (SELECT block, content, k, avg(ln(greatest(a, 0.005) / greatest(b, 0.005))) AS o FROM t GROUP BY ALL), r AS (SELECT k, content, count(*) AS blocks, avg(o) AS o FROM o GROUP BY ALL)
SELECT r.k, r.content, r.blocks, round(CASE WHEN abs(z.o) > 0.001 THEN r.o / z.o END, 4) AS a_b FROM r, r z WHERE z.k = 4 AND r.k <> 4""")
def ratio_to_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = E.pooled_log_odds(_sweep(spark, sf_dir).where("content = 'click'"), [("a", "b")], ["block"], ["k", "content"])
    return rounded(E.ratios(pooled, {"k": 4}, ["a_b"], least=0.001), "a_b", places=4)


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(*)::BIGINT AS n, median(value) AS m FROM events GROUP BY event_type)
SELECT event_type, round(m, 6) AS median, round(v[n // 2 + 1], 6) AS upper_median, round(v[greatest(0, floor(n * 0.9)::BIGINT - 1) + 1], 6) AS p90 FROM v""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nth_values(table(spark, sf_dir, "events"), ["event_type"], "value", {"low": M.lower_middle, "upper_median": M.upper_middle, "p90": M.percentile_place(0.9)})
    return rounded(e.select("event_type", ((F.col("low") + F.col("upper_median")) / 2).alias("median"), "upper_median", "p90"), "median", "upper_median", "p90")


@query("""WITH c AS (SELECT event_type AS tokenizer, 'f' || (user_id % 3) AS family, (event_id % 10)::INT AS expected, [(event_id % 9)::INT, (event_id % 8)::INT] AS cand FROM events),
r AS (SELECT tokenizer, family, list_contains(cand, expected)::INT AS hit, sign((list_sort(list_transform(cand, lambda x: {'d': abs(x - expected), 'c': x})))[1].c - expected) AS side FROM c)
SELECT tokenizer, coalesce(family, 'all') AS family, count(*) AS n, sum(hit)::BIGINT AS hits, count_if(side > 0)::BIGINT AS over, count_if(side < 0)::BIGINT AS under FROM r GROUP BY GROUPING SETS ((tokenizer, family), (tokenizer))""")
def tokenizer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.col("event_type").alias("tokenizer"), F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("family"), (i % 10).cast("int").alias("expected"), F.array((i % 9).cast("int"), (i % 8).cast("int")).alias("candidates"))
    return E.tokenizer_agreement(rows)


_RUN = """s AS (SELECT user_id AS run, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS step, event_id % 10 / 10.0::DOUBLE AS skip_p, CASE WHEN event_id % 4 > 0 THEN event_id % 7 / 7.0::DOUBLE END AS effect_p, event_id % 13 / 13.0::DOUBLE AS done_p, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS changed FROM events)"""


@query(f"""WITH {_RUN} SELECT run, count(*) AS steps, count_if(skip_p > 0.5)::BIGINT AS skip_flags, count_if(effect_p < 0.5)::BIGINT AS no_effect_flags, min(step) FILTER (done_p > 0.5) AS first_done_step, round(avg(((effect_p > 0.5) = coalesce(changed, false))::INT) FILTER (effect_p IS NOT NULL), 6) AS agreement FROM s GROUP BY run""")
def verifier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = episodes(spark, sf_dir).select(F.col("episode").alias("run"), "step", (i % 10 / F.lit(10.0)).alias("skip_p"), F.when(i % 4 > 0, i % 7 / F.lit(7.0)).alias("effect_p"), (i % 13 / F.lit(13.0)).alias("done_p"), F.when(i % 5 > 0, i % 2 == 0).alias("page_changed"))
    return rounded(E.run_summary(s, "run"), "agreement")


@query("""WITH r AS (SELECT o_orderpriority AS tag, o_orderstatus = 'F' AS ok, o_orderkey % 3 = 0 AS first, o_totalprice AS ms FROM orders) SELECT tag, count(*) AS n, round(avg(ok::INT), 6) AS success, round(avg(first::INT), 6) AS first_action_success, round(avg(ms), 3) AS model_ms FROM r GROUP BY tag""")
def loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tag"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderkey") % 3 == 0).alias("first_success"), F.col("o_totalprice").alias("model_ms"))
    return rounded(rounded(E.loop_summary(o), "success", "first_action_success"), "model_ms", places=3)


@query("""WITH r AS (SELECT c_nationkey AS concurrency, list_sort(list(c_acctbal)) AS v, count(*) AS n, median(c_acctbal) AS p50, max(c_custkey + 1) AS wall FROM customer GROUP BY 1) SELECT concurrency, n, round(n / wall, 6) AS req_s, round(p50, 4) AS p50, round(v[greatest(0, floor(n * 0.9)::BIGINT - 1) + 1], 4) AS p90 FROM r""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("concurrency"), F.col("c_acctbal").alias("ms"), (F.col("c_custkey") + 1).alias("wall_s"))
    return rounded(rounded(E.throughput(c), "req_s"), "p50", "p90", places=4)


@query(f"""WITH {SCORED_SQL}, s AS (SELECT question AS tier, site AS type, hit, ms FROM scored WHERE answered) SELECT tier, type, count(*) AS n, round(avg(hit), 6) AS acc, (list_sort(list(ms)))[count(*) // 2 + 1] AS p50 FROM s GROUP BY GROUPING SETS ((tier, type), (tier))""")
def tiered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("answered").select(F.col("question").alias("tier"), F.col("site").alias("type"), "hit", "ms")
    return rounded(E.tiers(rows), "acc")


@query(f"""WITH {SCORED_SQL}, x AS (SELECT unnest(list_distinct(['all', question, CASE WHEN id % 2 = 0 THEN 'noop' ELSE question END])) AS g, hit, ms FROM scored WHERE answered) SELECT g AS "group", count(*) AS n, round(avg(hit), 6) AS acc, (list_sort(list(ms)))[count(*) // 2 + 1] AS p50 FROM x GROUP BY g""")
def forms_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("answered").select(F.col("question").alias("action"), F.when(F.col("id") % 2 == 0, "noop").otherwise(F.col("question")).alias("kind"), "hit", "conf", "ms")
    return rounded(E.forms(rows), "acc")


@query("""WITH b AS (SELECT event_type AS condition, user_id AS block, avg(event_id % 17 - value) AS c FROM events GROUP BY ALL) SELECT condition, count(*) AS blocks, round(avg(c), 4) AS mean, round(stddev_samp(c) / sqrt(count(*)), 4) AS se FROM b GROUP BY condition""")
def paired_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("user_id").alias("block"), F.col("value").alias("before"), (F.col("event_id") % 17).alias("after"))
    return rounded(E.paired_effects(e), "mean", "se", places=4)


@query("""SELECT count(*) AS n, round(max(abs((doc_id * 7919 + 31) % 50 / 50.0::DOUBLE - (doc_id * 104729 + 31) % 50 / 50.0::DOUBLE)), 6) AS gap FROM labels""")
def isolation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .standins import predictions

    return rounded(E.largest_gap(predictions(spark, sf_dir), predictions(spark, sf_dir, 104729), ["id"]), "gap")


@query("""SELECT o_orderpriority AS model, count(*) AS calls, sum(o_orderkey)::BIGINT AS tokens_in, sum(o_custkey)::BIGINT AS tokens_out, round((sum(o_orderkey) * 3.0::DOUBLE + sum(o_custkey) * 15.0::DOUBLE) / 1e6, 6) AS cost FROM orders GROUP BY 1""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("tokens_in"), F.col("o_custkey").alias("tokens_out"))
    return rounded(E.usage_cost(o, 3.0, 15.0), "cost")


@query("""WITH l AS (SELECT '[' || event_id || '/9] block=' || (user_id % 5) || ' K= ' || (event_id % 16) || ' A server=' || (event_id % 300) || 'ms unk=' || CASE WHEN event_id % 4 = 0 THEN 'None' ELSE '0.5' END AS v, event_id, user_id FROM events)
SELECT event_id::INT AS i, (user_id % 5)::INT AS block, (event_id % 16)::INT AS k, CASE WHEN event_id % 4 <> 0 THEN 0.5::DOUBLE END AS unk FROM l""")
def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("event_id"), lambda c: c.cast("string")
    line = F.concat(F.lit("["), text(i), F.lit("/9] block="), text(F.col("user_id") % 5), F.lit(" K= "), text(i % 16), F.lit(" A server="), text(i % 300), F.lit("ms unk="), F.when(i % 4 == 0, "None").otherwise("0.5"))
    lines = table(spark, sf_dir, "events").select(line.alias("value"))
    return R.log_fields(lines, r"^\[(\d+)/\d+\] block=(\d+) K=\s*(\d+) .*unk=(\S+)$", {"i": "int", "block": "int", "k": "int", "unk": "double"})


@query("""SELECT event_id::VARCHAR AS id, event_type AS gold, round(value, 6) AS p FROM events""")
def keyed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that map ids to objects, one per user."""
    e = table(spark, sf_dir, "events")
    entry = F.struct(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct(F.col("event_type").alias("gold"), F.col("value").alias("p"))).alias("value"))
    docs = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    js = docs.select(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])), ","), F.lit("}")).alias("js"))
    return rounded(R.keyed_objects(js, "js", "gold STRING, p DOUBLE"), "p")


@query("""SELECT event_type, count(*) AS n, date_trunc('hour', ts) AS start FROM events GROUP BY ALL""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows, here as the batch form of the streaming operator."""
    return logs.counted_by_window(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "10 days")


@query("""WITH t AS (SELECT event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(v, 2) AS total FROM t""")
def log_tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream: drained into a table once, then summed."""
    path = folder(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    logs.drained(stream.select("event_type", "value"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH s AS (SELECT *, ts - lag(ts) OVER w >= INTERVAL 12 HOURS AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(coalesce(new, FALSE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s),
e AS (SELECT user_id AS episode, min(ts) AS first, max(ts) AS last, count(*) AS n, bool_or(event_type = 'purchase') AS reached, list(event_type ORDER BY ts) AS kinds FROM g GROUP BY user_id, g)
SELECT episode, first, last, n, reached, array_to_string(kinds[-10:], ',') AS recent FROM e WHERE last + INTERVAL 12 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def closed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: episodes that a gap of twelve hours has ended, as far as the watermark has come."""
    path, schema = folder(spark), table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    steps = stream.select(F.col("user_id").alias("episode"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("entry"), (F.col("event_type") == "purchase").alias("done"))
    with state_store(spark):
        logs.drained(closed(steps, 12 * 3600, "1 day"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").withColumns({"first": F.col("first").cast("timestamp_ntz"), "last": F.col("last").cast("timestamp_ntz"), "recent": F.array_join("recent", ",")})


_LINE = """'[' || event_id || '] k=' || CASE WHEN event_id % 4 = 0 THEN 'None' ELSE event_type END || ' p=' || value"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log, every eleventh one with a line of another kind behind it."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("] k="), F.when(F.col("event_id") % 4 == 0, "None").otherwise(F.col("event_type")), F.lit(" p="), F.col("value").cast("string"))
    return e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.concat(line, F.lit("\nnoise"))).otherwise(line).alias("value"))


_OPTIONS = {"pattern": r"^\[(\d+)\] k=(\S*) p=(\S+)$", "fields": "i bigint, k string, p double"}


@query("SELECT event_id AS i, event_type AS k, round(value, 6) AS p FROM events WHERE event_id % 4 <> 0 AND event_type = 'click' AND event_id >= 100")
def log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as logs and read by the format of its own, which checks the conditions."""
    path = folder(spark)
    event_log(spark, sf_dir).select("value").write.text(path)
    logs_of = registered(spark).read.format("decision_log").options(**_OPTIONS).load(path)
    return rounded(logs_of.where("k = 'click' and i >= 100"), "p")


@query("SELECT event_id AS i, CASE WHEN event_id % 4 <> 0 THEN event_type END AS k, round(value, 6) AS p FROM events")
def log_source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that ends, and goes on when the other half of the files has come."""
    path, out = folder(spark), folder(spark)
    for half in (0, 1):
        event_log(spark, sf_dir).where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(path)
        stream = registered(spark).readStream.format("decision_log").options(**_OPTIONS).load(path)
        logs.drained(stream, f"{out}/rows", f"{out}/state")
    return rounded(spark.read.parquet(f"{out}/rows"), "p")
