"""Queries on scores, calibration and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import numeric as N
from decidra.operators import calibration as C
from decidra.operators import experiments as E
from decidra.operators import metrics as M
from decidra.operators.resampling import bootstrap
from decidra.sources import writers as W

from .registry import query
from .standins import CHOICES_SQL, SCORED_SQL, SECOND_SQL, choices, items, predictions, table


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def scored(spark: SparkSession, sf_dir: str, factor: int = 7919) -> DataFrame:
    return M.scored(items(spark, sf_dir), predictions(spark, sf_dir, factor))


REPORT_SQL = """
base AS (SELECT question, count_if(answered)::BIGINT AS n, count_if(NOT answered)::BIGINT AS missing, avg(hit) AS acc,
                coalesce(avg(hit) FILTER (y = 1), 0) AS acc_pos, coalesce(avg(hit) FILTER (y = 0), 0) AS acc_neg, count_if(y = 1)::BIGINT AS n_pos,
                avg((p - y) ** 2) AS brier, avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-9))) AS nll, count_if(hit = 0 AND conf >= 0.99)::BIGINT AS err_at_99
         FROM {scored} GROUP BY question),
bins AS (SELECT question, least(9, floor(conf * 10)::BIGINT) AS b, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM {scored} WHERE answered GROUP BY ALL),
cal AS (SELECT question, sum(n * abs(h - c)) / sum(n) AS ece FROM bins GROUP BY question),
roc AS (SELECT a.question, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auroc
        FROM {scored} a JOIN {scored} b ON a.question = b.question AND a.y = 1 AND b.y = 0 GROUP BY a.question),
ranked AS (SELECT question, hit, row_number() OVER (PARTITION BY question ORDER BY conf DESC, id) AS r, count(*) OVER (PARTITION BY question) AS n FROM {scored} WHERE answered),
sel AS (SELECT question, avg(hit) FILTER (r <= greatest(1, round_even(n * 0.8::DOUBLE, 0))) AS sel80, avg(hit) FILTER (r <= greatest(1, round_even(n * 0.9::DOUBLE, 0))) AS sel90 FROM ranked GROUP BY question)
"""
REPORT_COLUMNS = "question, n, missing, round(acc, 6) AS acc, round(acc_pos, 6) AS acc_pos, round(acc_neg, 6) AS acc_neg, n_pos, round(brier, 6) AS brier, round(nll, 6) AS nll, err_at_99, round(ece, 6) AS ece, round(auroc, 6) AS auroc, round(sel80, 6) AS sel80, round(sel90, 6) AS sel90"
REPORT_FROM = "base LEFT JOIN cal USING (question) LEFT JOIN roc USING (question) LEFT JOIN sel USING (question)"


def _report(rows: DataFrame, by: list[str]) -> DataFrame:
    return rounded(M.report(rows, by).drop("ms"), "acc", "acc_pos", "acc_neg", "brier", "nll", "ece", "auroc", "sel80", "sel90")


@query(f"WITH {SCORED_SQL}, {REPORT_SQL.format(scored='scored')} SELECT {REPORT_COLUMNS} FROM {REPORT_FROM}")
def score_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(scored(spark, sf_dir), ["question"])


@query(f"WITH {SCORED_SQL} SELECT question, least(9, floor(conf * 10)::BIGINT) AS bin, count(*) AS n, round(avg(conf), 6) AS conf, round(avg(hit), 6) AS acc FROM scored WHERE answered GROUP BY ALL")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.reliability(scored(spark, sf_dir), ["question"]), "conf", "acc")


@query(f"""WITH {SCORED_SQL}, c AS (SELECT a.question, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS v FROM scored a JOIN scored b ON a.question = b.question AND a.y = 1 AND b.y = 0 GROUP BY 1),
s AS (SELECT a.question, sum(CASE WHEN a.conf > b.conf THEN 1.0 WHEN a.conf = b.conf THEN 0.5 ELSE 0 END) / count(*) AS v FROM scored a JOIN scored b ON a.question = b.question AND a.hit = 1 AND b.hit = 0 GROUP BY 1)
SELECT question, round(c.v, 6) AS auroc, round(s.v, 6) AS sel_auroc FROM (SELECT DISTINCT question FROM scored WHERE answered) LEFT JOIN c USING (question) LEFT JOIN s USING (question)""")
def auroc_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    both = M.auroc(rows, ["question"]).join(M.auroc(rows, ["question"], "conf", "hit", "sel_auroc"), "question", "full")
    return rounded(both, "auroc", "sel_auroc")


@query(f"""WITH {SCORED_SQL}, r AS (SELECT site, hit, row_number() OVER (PARTITION BY site ORDER BY conf DESC, id) AS r, count(*) OVER (PARTITION BY site) AS n FROM scored WHERE answered)
SELECT site, round(avg(hit) FILTER (r <= greatest(1, round_even(n * 0.5::DOUBLE, 0))), 6) AS sel50, round(avg(hit) FILTER (r <= greatest(1, round_even(n * 0.95::DOUBLE, 0))), 6) AS sel95 FROM r GROUP BY site""")
def selective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.selective(scored(spark, sf_dir), ["site"], {"sel50": 0.5, "sel95": 0.95}), "sel50", "sel95")


_ALL = f"""{SCORED_SQL}, {SECOND_SQL},
rules AS (SELECT id, question, label, answered, label AS y, ms, CASE WHEN answered AND question = 'en' THEN 0.9 WHEN answered THEN 0.1 END::DOUBLE AS p FROM items),
rules_scored AS (SELECT 'rules' AS system, id, question, answered, y, p, CASE WHEN p > 0.5 THEN p ELSE 1 - p END AS conf, CASE WHEN answered THEN ((p > 0.5) = (y = 1))::INT END AS hit FROM rules),
every AS (SELECT 'one' AS system, id, question, answered, y, p, conf, hit FROM scored UNION ALL SELECT 'two', id, question, answered, y, p, conf, hit FROM scored2 UNION ALL SELECT * FROM rules_scored)"""


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems and the rules, which find every English document changed."""
    own = items(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    pages = own.join(labelled, "id", "left_semi").select("id", F.lit("effect").alias("question"), "type", F.lit("a").alias("url_before"), F.when(F.col("question") == "en", "b").otherwise("a").alias("url_after"), F.lit("").alias("elements_before"), F.lit("").alias("elements_after"))
    ruled = M.rules(pages).select("id", "p", F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("ms"))
    out = None
    for name, p in (("one", predictions(spark, sf_dir)), ("two", predictions(spark, sf_dir, 104729)), ("rules", ruled)):
        part = M.scored(own, p).withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_ALL}, bins AS (SELECT system, question, least(9, floor(conf * 10)::BIGINT) AS b, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM every WHERE answered GROUP BY ALL),
cal AS (SELECT system, question, sum(n * abs(h - c)) / sum(n) AS ece FROM bins GROUP BY ALL)
SELECT system, question, count_if(answered)::BIGINT AS n, round(avg(hit), 6) AS acc, round(any_value(ece), 6) AS ece FROM every LEFT JOIN cal USING (system, question) GROUP BY ALL""")
def leaderboard_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = systems(spark, sf_dir), ["system", "question"]
    out = M.accuracy(rows, by).select(*by, "n", "acc").join(M.ece(rows, by), by, "left")
    return rounded(out, "acc", "ece")


@query(f"""WITH {_ALL}, a AS (SELECT system, question, count_if(answered) AS n, avg(hit) AS acc, avg(hit) FILTER (y = 1) AS pos, avg(hit) FILTER (y = 0) AS neg FROM every GROUP BY ALL),
q AS (SELECT DISTINCT question FROM a), s AS (SELECT DISTINCT system FROM a)
SELECT s.system, string_agg(q.question || ': ' || CASE WHEN acc IS NULL THEN '-' ELSE printf('%.2f', acc) || ' n=' || n END, ' | ' ORDER BY q.question) AS line FROM s CROSS JOIN q LEFT JOIN a ON a.system = s.system AND a.question = q.question GROUP BY s.system""")
def leaderboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = M.accuracy(systems(spark, sf_dir), ["system", "question"])
    cell = F.when(F.col("acc").isNull(), "-").otherwise(F.concat(F.format_string("%.2f", "acc"), F.lit(" n="), F.col("n").cast("string")))
    lines = acc.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("question", cell.alias("c")))).alias("cells"))
    return lines.select("system", F.array_join(F.transform("cells", lambda c: F.concat(c["question"], F.lit(": "), c["c"])), " | ").alias("line"))


@query("SELECT system, question, CASE WHEN acc IS NULL THEN '-' ELSE printf('%.3f', acc) || ' (' || printf('%.3f', pos) || '/' || printf('%.3f', neg) || ') n=' || n END AS cell FROM (WITH " + _ALL + " SELECT system, question, count_if(answered) AS n, avg(hit) AS acc, coalesce(avg(hit) FILTER (y = 1), 0) AS pos, coalesce(avg(hit) FILTER (y = 0), 0) AS neg FROM every GROUP BY ALL)")
def leaderboard_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = M.accuracy(systems(spark, sf_dir), ["system", "question"])
    return acc.select("system", "question", W.cell(F.col("acc"), F.col("acc_pos"), F.col("acc_neg"), F.col("n")).alias("cell"))


@query("""WITH d AS (SELECT lower(text) AS t, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT first_id, last_id, n FROM d""")
def duplicate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return d.groupBy("t").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).where("n > 1").drop("t")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY user_id""")
def last_and_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("o"))
    last = M.last_wins(e, ["user_id"], "o").select("user_id", F.col("event_type").alias("last_type"))
    return last.join(M.first_wins(e, ["user_id"], "o").select("user_id", F.col("event_type").alias("first_type")), "user_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decidra.operators.joins import resumed

    return resumed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


# ---- Choices


_SOFT = """, m AS (SELECT id, max(z) AS m FROM long GROUP BY id), e AS (SELECT id, gold, k, z, exp((z - m) / {t}) AS e FROM long JOIN m USING (id)),
p AS (SELECT id, gold, k, z, e / sum(e) OVER (PARTITION BY id) AS p FROM e)"""


@query(f"WITH {CHOICES_SQL}{_SOFT.format(t='0.5')} SELECT id, round(max(p), 6) AS top, arg_max(k, (z, -k))::INT AS pred, round(sum(p), 6) AS mass FROM p GROUP BY id")
def softmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = choices(spark, sf_dir).withColumn("p", N.softmax(F.col("logits"), 0.5))
    return p.select("id", F.round(F.array_max("p"), 6).alias("top"), N.arg_max(F.col("logits")).cast("int").alias("pred"), F.round(N.total(F.col("p")), 6).alias("mass"))


@query(f"WITH {CHOICES_SQL}{_SOFT.format(t='1.0')} SELECT id, round((max(p) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)), 6) AS conf, round(sum(p * k), 6) AS expected, round(abs(sum(p * k) - any_value(gold)), 6) AS error FROM p GROUP BY id")
def confidence_and_expected_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = choices(spark, sf_dir).withColumn("p", N.softmax(F.col("logits")))
    level = N.expected_level(F.col("p"))
    return p.select("id", F.round(N.choice_confidence(F.col("p")), 6).alias("conf"), F.round(level, 6).alias("expected"), F.round(F.abs(level - F.col("gold")), 6).alias("error"))


@query(f"WITH {CHOICES_SQL}{_SOFT.format(t='1.0')} SELECT gold AS label, count(DISTINCT id) AS n, round(sum((p - (k = gold)::INT) ** 2) / count(DISTINCT id), 6) AS brier, round(avg(-ln(greatest(p, 1e-9))) FILTER (k = gold), 6) AS nll FROM p GROUP BY gold")
def brier_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = choices(spark, sf_dir).withColumn("p", N.softmax(F.col("logits")))
    return rounded(p.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("n"), F.avg(N.brier(F.col("p"), F.col("gold"))).alias("brier"), F.avg(N.nll(F.element_at("p", F.col("gold") + 1))).alias("nll")), "brier", "nll")


_TS = "0.25, 0.5, 1.0, 2.0"


@query(f"""WITH {CHOICES_SQL}, t AS (SELECT unnest([{_TS}])::DOUBLE AS t), m AS (SELECT id, max(z) AS m FROM long GROUP BY id),
e AS (SELECT t, id, gold, k, exp((z - m) / t) AS e FROM long JOIN m USING (id) CROSS JOIN t), p AS (SELECT t, id, gold, k, e / sum(e) OVER (PARTITION BY t, id) AS p FROM e),
r AS (SELECT t, id, max(p) AS conf, max(p) FILTER (k = gold) AS gp, (arg_max(k, (p, -k)) = any_value(gold))::INT AS hit, sum((p - (k = gold)::INT) ** 2) AS brier FROM p GROUP BY ALL),
b AS (SELECT t, least(9, floor(conf * 10)::BIGINT) AS b, count(*) AS n, avg(conf) AS c, avg(hit) AS h FROM r GROUP BY ALL), c AS (SELECT t, sum(n * abs(h - c)) / sum(n) AS ece FROM b GROUP BY t)
SELECT t, count(*) AS n, round(avg(hit), 6) AS acc, round(avg(-ln(greatest(gp, 1e-9))), 6) AS nll, round(avg(conf), 6) AS mean_top_p, round(avg(brier), 6) AS brier, round(any_value(ece), 6) AS ece FROM r JOIN c USING (t) GROUP BY t""")
def temperature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.sweep(choices(spark, sf_dir), [0.25, 0.5, 1.0, 2.0]), "acc", "nll", "mean_top_p", "brier", "ece")


@query(f"""WITH {SCORED_SQL}, t AS (SELECT i / 20.0::DOUBLE AS t FROM range(1, 400) r(i)), c AS (SELECT question, p, y, count(*) AS n FROM scored WHERE answered GROUP BY ALL),
z AS (SELECT question, y, n, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS z FROM c),
s AS (SELECT question, t, n, y, greatest(least(1 / (1 + exp(-greatest(least(z / t, 30), -30))), 1 - 1e-9), 1e-9) AS s FROM z CROSS JOIN t),
l AS (SELECT question, t, sum(n * -ln(greatest(CASE WHEN y = 1 THEN s ELSE 1 - s END, 1e-9))) / sum(n) AS nll FROM s GROUP BY ALL)
SELECT question, arg_min(t, (round(nll, 9), t)) AS temperature, round(min(nll), 6) AS nll FROM l GROUP BY question""")
def fit_noul_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fit_noul(scored(spark, sf_dir), ["question"]), "nll")


@query(f"""WITH {CHOICES_SQL}, t AS (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0])::DOUBLE AS t), m AS (SELECT id, max(z) AS m FROM long GROUP BY id),
p AS (SELECT t, id, 1 / sum(exp((z - m) / t)) AS top FROM long JOIN m USING (id) CROSS JOIN t GROUP BY t, id), h AS (SELECT avg(h) AS acc FROM (SELECT (arg_max(k, (z, -k)) = any_value(gold))::INT AS h FROM long GROUP BY id)),
g AS (SELECT t, abs(avg(top) - any_value(acc)) AS gap FROM p CROSS JOIN h GROUP BY t)
SELECT arg_min(t, (round(gap, 9), t)) AS temperature, round(min(gap), 6) AS gap FROM g""")
def fit_choice_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fit_choice(choices(spark, sf_dir)), "gap")


@query(f"""WITH {SCORED_SQL}, {SECOND_SQL}, x AS (SELECT a.conf, a.hit, b.hit AS t_hit, unnest([0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01, NULL])::DOUBLE AS tau FROM scored a JOIN scored2 b USING (id) WHERE a.answered),
y AS (SELECT *, CASE WHEN tau IS NULL THEN hit = 0 ELSE conf < tau END AS sent FROM x)
SELECT tau, round(avg(sent::INT), 6) AS escalated, round(avg(CASE WHEN sent THEN t_hit ELSE hit END), 6) AS acc, round(153 + avg(sent::INT) * 1200, 6) AS ms, round(0.0002 + avg(sent::INT) * 0.01, 6) AS cost FROM y GROUP BY tau""")
def escalation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda f: scored(spark, sf_dir, f).where("answered").select("id", "conf", "hit")
    return rounded(C.escalation(own(7919), own(104729), 153.0, 1200.0, 0.0002, 0.01), "escalated", "acc", "ms", "cost")


@query(f"""WITH {SCORED_SQL}, {SECOND_SQL} SELECT count(*) AS n, round(avg(((a.p > 0.5) = (b.p > 0.5))::INT), 6) AS agreement FROM scored a JOIN scored2 b USING (id) WHERE a.answered""")
def agreement_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda f: scored(spark, sf_dir, f).where("answered").select("id", (F.col("p") > 0.5).alias("answer"))
    return rounded(M.agreement(own(7919), own(104729)), "agreement")


@query(f"""WITH {SCORED_SQL} SELECT ((conf >= 0.6)::INT + (conf >= 0.7)::INT + (conf >= 0.8)::INT + (conf >= 0.9)::INT)::INT AS bucket, count(*) AS n, count_if(id % 3 = 0)::BIGINT AS ambiguous, count_if(id % 3 <> 0)::BIGINT AS plain FROM scored WHERE answered GROUP BY 1""")
def contingency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confidence_buckets(scored(spark, sf_dir).withColumn("ambiguous", F.col("id") % 3 == 0), [0.6, 0.7, 0.8, 0.9])


@query(f"""WITH {SCORED_SQL}, g AS (SELECT question, count(*) AS n, avg((hit = 0)::INT) AS p, min(hit) AS same FROM scored WHERE answered GROUP BY question),
f AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS f FROM range((SELECT max(n) + 1 FROM g)) r(i)),
c AS (SELECT question, n, k.i AS k, sum(exp(a.f - k.f - o.f + k.i * ln(p) + (n - k.i) * ln(1 - p))) OVER (PARTITION BY question ORDER BY k.i) AS upto FROM g JOIN f a ON a.i = n JOIN f k ON k.i <= n JOIN f o ON o.i = n - k.i WHERE p > 0 AND p < 1),
l AS (SELECT question, n, list(upto ORDER BY k) AS upto FROM c GROUP BY ALL),
m AS (SELECT question, 1 - len(list_filter(upto, lambda x: x < ('0x' || substr(md5('7:' || question || ':' || b), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) / n AS m FROM l CROSS JOIN range(2000) r(b) UNION ALL SELECT question, same FROM g CROSS JOIN range(2000) r(b) WHERE p IN (0, 1)),
s AS (SELECT question, list_sort(list(m)) AS m FROM m GROUP BY question)
SELECT question, round(m[51], 6) AS low, round(m[1951], 6) AS high FROM s""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 resamples. The SQL draws the wrong answers of a round from the binomial distribution, as the first split of two values does."""
    return rounded(bootstrap(scored(spark, sf_dir).where("answered"), ["question"], "hit", 2000, "7"), "low", "high")


@query(f"""WITH {SCORED_SQL}, a AS (SELECT site, avg(hit) AS acc, count(*) AS n FROM scored WHERE answered GROUP BY site) SELECT count(*) AS sources, round(avg(acc), 6) AS macro, round(sum(acc * n) / sum(n), 6) AS micro FROM a""")
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = scored(spark, sf_dir).where("answered").groupBy("site").agg(F.avg("hit").alias("acc"), F.count("*").alias("n"))
    return rounded(by.agg(F.count("*").alias("sources"), F.avg("acc").alias("macro"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("micro")), "macro", "micro")


@query(f"""WITH {SCORED_SQL}, f AS (SELECT question, CASE WHEN question = 'en' THEN 2.0 ELSE 0.5 END AS t FROM (SELECT DISTINCT question FROM scored)),
c AS (SELECT id, question, y, 1 / (1 + exp(-greatest(least(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) / t, 30), -30))) AS s FROM scored JOIN f USING (question) WHERE answered),
d AS (SELECT question, y, greatest(least(s, 1 - 1e-9), 1e-9) AS p FROM c)
SELECT question, round(avg((((p >= 0.5)::INT) = y)::INT), 6) AS acc, round(avg(greatest(p, 1 - p)), 6) AS conf, count_if((p >= 0.5)::INT <> y AND greatest(p, 1 - p) >= 0.99)::BIGINT AS err_at_99 FROM d GROUP BY question""")
def calibration_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("answered")
    fitted = items(spark, sf_dir).select("question").distinct().withColumn("temperature", F.when(F.col("question") == "en", 2.0).otherwise(0.5))
    hot = C.calibrated(rows, fitted, ["question"])
    return rounded(hot.groupBy("question").agg(F.avg("hit").alias("acc"), F.avg("conf").alias("conf"), F.count_if((F.col("hit") == 0) & (F.col("conf") >= 0.99)).alias("err_at_99")), "acc", "conf")


@query("""WITH p AS (SELECT vec_id AS id, len(embedding) // 2 AS n, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT id, round(list_sum(list_transform(range(1, n + 1), lambda i: v[i] * v[n + i])) / sqrt(n), 6) AS score FROM p""")
def pointer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a vector as the question, the second as the option."""
    e, n = table(spark, sf_dir, "embeddings"), F.floor(F.size("embedding") / 2).cast("int")
    return e.select(F.col("vec_id").alias("id"), F.round(N.pointer_score(F.slice("embedding", 1, n), F.slice("embedding", n + 1, n)), 6).alias("score"))


@query(f"""WITH {CHOICES_SQL}, m AS (SELECT id, gold, max(z) AS m, list(z ORDER BY k) AS z FROM long GROUP BY ALL), l AS (SELECT id, gold, z, m + ln(list_sum(list_transform(z, lambda x: exp(x - m)))) AS l FROM m)
SELECT id, round(l, 6) AS log_sum, round(l - z[gold + 1], 6) AS loss, round(greatest(z[1], 0) - z[1] * (gold = 0)::INT + ln(1 + exp(-abs(z[1]))), 6) AS bce FROM l""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = choices(spark, sf_dir)
    onehot = F.transform("logits", lambda _, i: F.when(i == F.col("gold"), 1.0).otherwise(0.0))
    first = F.element_at("logits", 1)
    return c.select("id", F.round(N.log_sum_exp(F.col("logits")), 6).alias("log_sum"), F.round(N.choice_loss(F.col("logits"), onehot), 6).alias("loss"), F.round(N.binary_loss(first, (F.col("gold") == 0).cast("int")), 6).alias("bce"))


@query("""WITH s AS (SELECT DISTINCT (event_id % 50)::BIGINT AS step FROM events) SELECT step, round(least(1, (step + 1) / 10.0) * 0.5 * (1 + cos(pi() * least(step, 40) / 40.0)), 6) AS lr FROM s""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("step")).distinct()
    return s.select("step", F.round(N.learning_rate(F.col("step"), 10, 40), 6).alias("lr"))
