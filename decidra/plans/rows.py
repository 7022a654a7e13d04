"""Queries on episodes, labels, row builders and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import numeric as N
from decidra.functions import text as X
from decidra.operators import builders as B
from decidra.operators import joins as J
from decidra.operators import labels as L
from decidra.operators import sampling as S
from decidra.operators import sequences as Q
from decidra.operators.ordered import numbered
from decidra.sources import dom

from .registry import query
from .standins import STEPS_SQL, episodes, table

_UNIT = "(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"WITH {STEPS_SQL} SELECT event_id, count(*) OVER w AS before, array_to_string(coalesce(list(kind) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []), ',') AS recent, array_to_string(coalesce(list(kind) OVER w, []), ',') AS history FROM steps WINDOW w AS (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def episode_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's whole history, its length and the ten entries that a row shows."""
    rows = Q.histories(episodes(spark, sf_dir), ["episode"], "step", "kind")
    recent = F.slice("history", F.greatest(F.size("history") - 9, F.lit(1)), 10)
    return rows.select("event_id", "before", F.array_join(recent, ",").alias("recent"), F.array_join("history", ",").alias("history"))


@query(f"WITH {STEPS_SQL} SELECT episode, step // 4096 AS chunk, string_agg(kind, ',' ORDER BY step) AS entries FROM steps GROUP BY ALL")
def history_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.history_chunks(episodes(spark, sf_dir), ["episode"], "step", "kind")
    return rows.select("episode", "chunk", F.array_join("entries", ",").alias("entries"))


@query(f"WITH {STEPS_SQL} SELECT episode, kind, max(step) AS last FROM steps GROUP BY ALL")
def last_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.last_seen(episodes(spark, sf_dir), ["episode"], "step", "kind")


@query(f"""WITH {STEPS_SQL}, f AS (SELECT *, (kind = 'purchase')::INT AS done FROM steps)
SELECT event_id, max(done) OVER (PARTITION BY episode ORDER BY step) AS done_after, coalesce(max(done) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done_before, done AS done_now FROM f""")
def sticky_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("kind") == "purchase"
    rows = L.recorded_done(episodes(spark, sf_dir), ["episode"], "step", done)
    return rows.select("event_id", "done_after", "done_before", done.cast("int").alias("done_now"))


@query(f"WITH {STEPS_SQL} SELECT episode, min(step) FILTER (kind = 'purchase') AS first_step FROM steps GROUP BY episode")
def first_done_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_step(episodes(spark, sf_dir), ["episode"], "step", F.col("kind") == "purchase")


@query(f"WITH {STEPS_SQL}, s AS (SELECT event_id, episode, step + step // 6 AS step, kind, value FROM steps) SELECT a.event_id, b.kind AS prev_kind, round(b.value, 6) AS prev_value FROM s a LEFT JOIN s b ON a.episode = b.episode AND b.step = a.step - 1")
def previous_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh number of a step is left out, so there are gaps."""
    steps = episodes(spark, sf_dir).withColumn("step", F.col("step") + F.floor(F.col("step") / 6))
    rows = Q.previous(steps, ["episode"], "step", ["kind", "value"])
    return rows.select("event_id", "prev_kind", F.round("prev_value", 6).alias("prev_value"))


@query(f"WITH {STEPS_SQL} SELECT event_id, array_to_string(list_sort(list_distinct(coalesce(list(kind) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []))), ',') AS later FROM steps")
def later_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.later_values(episodes(spark, sf_dir), ["episode"], "step", "kind", "later")
    return rows.select("event_id", F.array_join("later", ",").alias("later"))


@query(f"WITH {STEPS_SQL} SELECT event_id, round(avg(event_id % 97) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS running_mean FROM steps")
def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.running_mean(episodes(spark, sf_dir).withColumn("loss", F.col("event_id") % 97), ["episode"], "step", "loss", 10)
    return rows.select("event_id", F.round("running_mean", 4).alias("running_mean"))


_NORM = "rtrim(split_part(lower(url_decode(replace(url, '+', ' '))), '#', 1), '/')"


@query(f"SELECT page_id, {_NORM} AS url, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.normalised(F.col("url")).alias("url"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("""WITH p AS (SELECT page_id, lower(url_decode(replace(url, '+', ' '))) AS u, CASE page_id % 3 WHEN 0 THEN '2' WHEN 1 THEN 'feed' ELSE 'en' END AS q FROM pages)
SELECT page_id, (regexp_matches(u, '[?&#](?:q|query|search|search_query|s|k|keyword|keywords|term|text|p|wd|find|searchterm)=[^&#]*' || q) OR regexp_matches(u, '/search[^?]*/' || q || '(?:[/?&#]|$)')
 OR replace(regexp_extract(rtrim(split_part(split_part(u, '?', 1), '#', 1), '/'), '[^/]*$'), '_', ' ') = q) AS done FROM p""")
def search_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("page_id") % 3 == 0, "2").when(F.col("page_id") % 3 == 1, "feed").otherwise("en")
    return table(spark, sf_dir, "pages").select("page_id", X.search_done(F.col("url"), q).alias("done"))


@query(f"""WITH p AS (SELECT page_id, {_NORM} AS u, CASE WHEN page_id % 2 = 0 THEN {_NORM} ELSE '/en/' END AS h, CASE WHEN page_id % 5 = 0 THEN {_NORM} ELSE 'x' END AS s FROM pages)
SELECT page_id, (u <> s AND (contains(u, rtrim(h, '/')) OR ends_with(u, rtrim(h, '/')))) AS done FROM p""")
def follow_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    href = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("/en/")
    start = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise("x")
    return p.select("page_id", X.follow_done(F.col("url"), href, start).alias("done"))


# ---- Steps as recorded, from the pages: two a day of a site, with candidates and labels by arithmetic.


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps (schemas.STEP, the columns that the builders read) with the pages' addresses."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    texts = F.array(F.concat(F.lit("element 1: input text 'Search' value='w"), (k % 3).cast("string"), F.lit("'")), F.concat(F.lit("element 2: a 'Link "), k.cast("string"), F.lit("'")), F.lit("element 3: button 'Go'"), F.lit("odd text"))
    candidates = F.transform(texts, lambda t, i: F.struct((i + 1).alias("k"), t.alias("text")))
    done = (k % 4 == 0).cast("int")
    labels = F.struct(F.transform(candidates, lambda c: F.struct(c["k"].alias("k"), F.greatest(done, (c["k"] == k % 5).cast("int")).alias("v"))).alias("skip"), (k % 2).cast("int").alias("effect"), done.alias("done_before"), (k % 3 == 0).cast("int").alias("done_after"), (k % 7 == 0).cast("int").alias("noisy"))
    return p.select(
        F.format_string("%03d_%d_%d", k % 20, F.floor(k / 20) % 3, F.floor(k / 60)).alias("id"),
        F.concat(F.lit("site"), (k % 20).cast("string")).alias("site"),
        F.concat(F.lit("goal "), k.cast("string")).alias("goal"),
        F.when(k % 3 == 0, "search").when(k % 3 == 1, "follow").otherwise("click").alias("goal_kind"),
        F.concat(F.lit("w"), (k % 2).cast("string")).alias("goal_value"),
        F.when(k % 6 == 1, F.lit("/en/")).otherwise("").alias("target_href"),
        F.lit("http://start").alias("start_url"),
        F.floor(k / 60).cast("int").alias("step"),
        F.when(k % 2 == 0, F.array()).otherwise(F.array(F.lit("click on Link"), F.lit("type on Search typed 'x'"))).alias("history"),
        F.when(k % 2 == 0, "click").otherwise("type").alias("action"),
        F.when(k % 2 == 0, "").otherwise("w1").alias("typed"),
        (k % 5 + 1).cast("string").alias("chosen"),
        F.when(k % 5 != 4, (k % 4 + 1).cast("string")).alias("target_idx"),
        F.concat(F.lit("img/"), k.cast("string"), F.lit("_b.png")).alias("before_img"),
        F.concat(F.lit("img/"), k.cast("string"), F.lit("_a.png")).alias("after_img"),
        F.col("url").alias("before_url"),
        F.concat("url", F.lit("#x")).alias("after_url"),
        candidates.alias("candidates"),
        labels.alias("labels"),
        F.when(k % 11 == 0, "timeout").alias("error"),
    )


STEP_SQL = f"""
p AS (SELECT page_id AS k, url, format('{{:03d}}_{{:d}}_{{:d}}', page_id % 20, (page_id // 20) % 3, page_id // 60) AS id, 'site' || (page_id % 20) AS site, page_id // 60 AS step,
  CASE page_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'follow' ELSE 'click' END AS goal_kind, 'w' || (page_id % 2) AS goal_value, {_NORM} AS u,
  (page_id % 4 = 0)::INT AS db, (page_id % 3 = 0)::INT AS da, page_id % 11 = 0 AS bad, page_id % 7 = 0 AS noisy, page_id % 2 AS effect, CASE WHEN page_id % 5 <> 4 THEN page_id % 4 + 1 END AS tgt FROM pages)"""


@query(f"""WITH {STEP_SQL}, e AS (SELECT *, regexp_replace(id, '_[^_]*$', '') AS ep FROM p),
t AS (SELECT site, ep, arg_min(u, step) AS target FROM e WHERE goal_kind = 'follow' AND k % 6 <> 1 AND da = 1 GROUP BY ALL),
r AS (SELECT e.*, CASE WHEN goal_kind = 'search' THEN (regexp_matches(lower(url), '[?&#](?:q|query|search|search_query|s|k|keyword|keywords|term|text|p|wd|find|searchterm)=[^&#]*' || goal_value) OR regexp_extract(split_part(u, '?', 1), '[^/]*$') = goal_value)::INT
  WHEN goal_kind = 'follow' AND k % 6 = 1 THEN contains(u, '/en')::INT WHEN goal_kind = 'follow' AND target IS NOT NULL THEN (u = target)::INT END AS now FROM e LEFT JOIN t USING (site, ep))
SELECT id, k AS page_id, coalesce(now, db) AS done_before, coalesce(now, da) AS done_after, now IS NOT NULL AND (now <> db OR now <> da) AS flipped,
  (CASE WHEN now IS NOT NULL THEN CASE WHEN now = 1 THEN 4 ELSE coalesce(goal_kind = 'search' AND tgt = 1 AND 'w' || (k % 3) = goal_value, FALSE)::INT END
        WHEN db = 1 THEN 4 ELSE (k % 5 BETWEEN 1 AND 4)::INT END)::INT AS skips FROM r""")
def relabel_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.relabelled(recorded(spark, sf_dir).withColumn("page_id", F.regexp_extract("before_img", r"(\d+)", 1).cast("long")))
    return rows.select("id", "page_id", "labels.done_before", "labels.done_after", "flipped", F.size(F.filter("labels.skip", lambda s: s["v"] == 1)).alias("skips"))


@query(f"""WITH {STEP_SQL}, g AS (SELECT *, site IN (SELECT site FROM (SELECT site, min(id) AS f FROM p WHERE NOT bad GROUP BY site ORDER BY f DESC LIMIT 5)) AS held FROM p WHERE NOT bad),
s AS (SELECT id, k, held, c, greatest(db, (c = k % 5)::INT) AS v, md5('0:' || id || ':' || c) AS h FROM g CROSS JOIN range(1, 5) r(c)),
n AS (SELECT id, k, held, v, row_number() OVER (PARTITION BY id, k, v ORDER BY h, c) AS r FROM s),
rows AS (SELECT held, 'effect' AS question, effect::VARCHAR AS target FROM g WHERE NOT noisy UNION ALL SELECT held, 'done', db::VARCHAR FROM g UNION ALL SELECT held, 'done', da::VARCHAR FROM g
 UNION ALL SELECT held, 'skip', v::VARCHAR FROM n WHERE r <= 2 UNION ALL SELECT held, 'ground', tgt::VARCHAR FROM g WHERE tgt IS NOT NULL AND db = 0 AND {_UNIT.format(seed='0/ground', key='id')} < 0.5)
SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, question, target, count(*) AS n FROM rows GROUP BY ALL""")
def explode_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.state_rows(recorded(spark, sf_dir), validation_sites=5)
    return rows.groupBy("split", F.col("question.qid").alias("question"), "target").agg(F.count("*").alias("n"))


@query(f"""WITH {STEP_SQL} SELECT k AS page_id, 'Task: goal ' || k || chr(10) || 'Actions already taken:' || chr(10) || CASE WHEN k % 2 = 0 THEN '  (none)' ELSE '  - click on Link' || chr(10) || '  - type on Search typed ''x''' END || chr(10) AS state,
 id || ':skip:' || (k % 3) || ':' AS item_id FROM p""")
def render_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recorded(spark, sf_dir).withColumn("page_id", F.regexp_extract("before_img", r"(\d+)", 1).cast("long"))
    return s.select("page_id", X.rendered_state(F.col("goal"), F.col("history")).alias("state"), X.item_id(F.col("id"), F.lit("skip"), (F.col("page_id") % 3).cast("string"), F.lit(None).cast("string")).alias("item_id"))


@query(r"""WITH c AS (SELECT page_id, unnest([1, 2, 3, 4]) AS k, unnest(['element 1: input text ''Search'' value=''w' || (page_id % 3) || '''', 'element 2: a ''Link ' || page_id || '''', 'element 3: button ''Go''', 'odd text']) AS t FROM pages)
SELECT page_id, k, CASE k WHEN 1 THEN 'input' WHEN 2 THEN 'a' WHEN 3 THEN 'button' END AS tag, CASE WHEN k = 1 THEN 'text' END AS type, CASE k WHEN 1 THEN 'Search' WHEN 2 THEN 'Link ' || page_id WHEN 3 THEN 'Go' ELSE t END AS label, CASE WHEN k = 1 THEN 'w' || (page_id % 3) END AS value, k = 1 AS typeable FROM c""")
def candidate_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = recorded(spark, sf_dir).select(F.regexp_extract("before_img", r"(\d+)", 1).cast("long").alias("page_id"), F.explode("candidates").alias("c"))
    e = s.select("page_id", "c.k", X.candidate(F.col("c.text")).alias("e"))
    return e.select("page_id", "k", "e.tag", "e.type", "e.label", "e.value", "e.typeable")


@query(r"SELECT conv_id, turn, regexp_replace('Last action: ' || role || ' on ' || text || chr(10) || 'end', 'Last action: (\w+) on [^\n]*', 'Last action: \1 at the red marker') AS state FROM conversations")
def state_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    state = F.concat(F.lit("Last action: "), "role", F.lit(" on "), "text", F.lit("\nend"))
    return c.select("conv_id", "turn", X.marked_state(state).alias("state"))


@query(f"""WITH {STEP_SQL} SELECT k AS page_id, TRUE AS has_typeable, CASE WHEN db = 1 THEN 'DONE' WHEN tgt IS NULL THEN 'BLOCKED' WHEN goal_kind = 'search' AND tgt = 1 THEN 'TYPE_TEXT' ELSE 'CLICK' END AS gold, CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END AS recent FROM p WHERE NOT bad""")
def operation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = recorded(spark, sf_dir).withColumn("id", F.regexp_extract("before_img", r"(\d+)", 1))
    return B.operations(steps).select(F.col("id").cast("long").alias("page_id"), "has_typeable", "gold", F.json_array_length(F.get_json_object("state", "$.recent_actions")).alias("recent"))


# ---- Samples and splits


@query("SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 100 rows is the operator's result."""
    return S.pick(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, "3")


@query(f"SELECT doc_id FROM documents WHERE {_UNIT.format(seed='4', key='doc_id')} < 0.3")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bernoulli(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.3, "4")


@query("""WITH r AS (SELECT lang, toxic, doc_id, row_number() OVER (PARTITION BY lang, toxic ORDER BY md5('5:' || doc_id), doc_id) AS r FROM labels JOIN documents USING (doc_id)),
k AS (SELECT lang, least(count_if(toxic = 1 AND r <= 20), 10) AS kp FROM r GROUP BY lang)
SELECT lang, doc_id, toxic FROM r JOIN k USING (lang) WHERE r <= 20 AND CASE WHEN toxic = 1 THEN r <= kp ELSE r <= 20 - kp END""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return S.half_positive(rows.select("lang", "doc_id", "toxic"), ["lang"], "doc_id", "toxic", 20, "5")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY md5('6:' || l_linenumber), l_linenumber) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_returnflag FROM r WHERE r <= 2""")
def balanced_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return S.pick_per_group(rows, ["l_orderkey", "l_returnflag"], "l_linenumber", 2, "6")


@query("""WITH g AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source), h AS (SELECT source FROM g ORDER BY f DESC LIMIT 4)
SELECT source, CASE WHEN source IN (SELECT source FROM h) THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL""")
def site_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.group_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4)
    return rows.groupBy("source", "split").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT greatest(1, 100 // count(DISTINCT source)) AS k FROM documents), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('8:' || doc_id), doc_id) AS r FROM documents) SELECT source, doc_id FROM r, n WHERE r <= k""")
def subcase_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 100, "8")


@query(f"""SELECT doc_id, CASE WHEN u < 0.5 THEN 'oracle' WHEN u < 0.75 THEN 'random' WHEN u < 0.9 THEN 'repeat' ELSE 'unrelated' END AS policy, ['a', 'b', 'c'][(floor(u2 * 4294967296)::BIGINT % 3) + 1] AS phrase
FROM (SELECT doc_id, {_UNIT.format(seed='9', key='doc_id')} AS u, {_UNIT.format(seed='10', key='doc_id')} AS u2 FROM documents)""")
def policy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mix = {"oracle": 0.5, "random": 0.25, "repeat": 0.15, "unrelated": 0.1}
    return d.select("doc_id", S.policy(N.hash_unit(F.col("doc_id"), "9"), mix).alias("policy"), S.chosen(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("doc_id"), "10").alias("phrase"))


@query("""WITH o AS (SELECT DISTINCT n_name AS o FROM nation), r AS (SELECT s_suppkey, n_name AS gold, o, row_number() OVER (PARTITION BY s_suppkey ORDER BY md5('11:' || s_suppkey || ':' || o), o) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN o ON o.o <> n_name),
k AS (SELECT s_suppkey, gold, o FROM r WHERE r <= 3 UNION ALL SELECT s_suppkey, n_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, gold, string_agg(o, '|' ORDER BY md5('11!:' || s_suppkey || ':' || o), o) AS options FROM k GROUP BY ALL""")
def distractor_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("gold"))
    rows = S.distractors(s, "s_suppkey", "gold", n, "n_name", 3, "11")
    return rows.select("s_suppkey", "gold", F.array_join("options", "|").alias("options"))


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.oversampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang") == "fr")


# ---- Joins


@query("""WITH r AS (SELECT n_nationkey, n_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM nation JOIN supplier ON n_nationkey = s_nationkey)
SELECT c_custkey, s_suppkey FROM customer JOIN r ON c_nationkey = n_nationkey WHERE r <= 2""")
def broadcast_fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return J.fan_out(c, s, "nation", 2, "s_suppkey").select("c_custkey", "s_suppkey")


@query("SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND abs(a.s_acctbal - b.s_acctbal) < 500 AND a.s_suppkey < b.s_suppkey")
def range_target_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return J.near(s, s, ["s_nationkey"], "s_acctbal", 500.0).where("s_suppkey < r_s_suppkey").select("s_suppkey", F.col("r_s_suppkey").alias("other"))


@query("""WITH d AS (SELECT a.p_partkey AS part, b.p_partkey AS other, abs(a.p_size - b.p_size) * 2 + abs(a.p_retailprice - b.p_retailprice) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY distance, other) AS rank FROM d) SELECT part, other, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 3""")
def hard_negatives_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part")
    return J.nearest(p, ["p_brand", "p_type"], "part", {"p_size": 2.0, "p_retailprice": 1.0}, 3).withColumn("distance", F.round("distance", 6))


@query("""WITH pr AS (SELECT lang, source, avg(n_chars) AS prior FROM documents GROUP BY ALL) SELECT doc_id, round(n_chars - prior, 4) AS pmi FROM documents JOIN pr USING (lang, source)""")
def pmi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    priors = d.groupBy("lang", "source").agg(F.avg("score").alias("score"))
    return J.prior_adjusted(d, priors, ["lang", "source"]).select("doc_id", F.round("pmi", 4).alias("pmi"))


@query("""WITH s AS (SELECT n_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier)
SELECT c_custkey, s_suppkey FROM customer JOIN s ON c_nationkey = n_nationkey JOIN r ON r.s_nationkey = c_nationkey AND r.r = c_custkey % n""")
def round_robin_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return J.round_robin(c, "nation", "c_custkey", s, "s_suppkey").select("c_custkey", "s_suppkey")


# ---- Targets, generated items and layouts


@query("""WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: exp(x::DOUBLE * 2)) AS w FROM embeddings), p AS (SELECT id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM e)
SELECT id, round(p[1], 6) AS p0, round(list_max(p), 6) AS top, list_max(p) < 0.8 OR ('0x' || substr(md5('12:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 AS hard FROM p""")
def soft_targets_and_hard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    teacher = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda _, i: i.cast("string")).alias("keys"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    soft = B.soft_labels(e.select(F.col("vec_id").alias("id")), teacher, 0.5).withColumn("tops", F.array("top"))
    hard = B.hard_rows(soft, "id", "tops", 0.8, 0.1, "12").select("id", F.lit(True).alias("hard"))
    return soft.join(hard, "id", "left").select("id", F.round(F.element_at("soft", 1)["p"], 6).alias("p0"), F.round("top", 6).alias("top"), F.coalesce("hard", F.lit(False)).alias("hard"))


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS n, max(len(text)) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, m >= 20 AND n BETWEEN 1 AND 4 AND n BETWEEN 2 AND 64 AND conv_id % 5 <> 0 AS valid FROM c""")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a generated item: its turns are choice questions with the turns as options; every fifth repeats an id."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("t")))).alias("ts"), F.max_by("text", F.length("text")).alias("state"))
    options = F.transform("ts", lambda t: F.struct(t["turn"].cast("string").alias("key"), t["t"].alias("descr")))
    qid = lambda t: F.when(F.col("conv_id") % 5 == 0, F.lit("same")).otherwise(t["turn"].cast("string"))
    asked = F.transform("ts", lambda t: F.struct(qid(t).alias("qid"), F.lit("choice").alias("qtype"), t["role"].alias("instructions"), options.alias("criteria")))
    many = F.when((F.col("conv_id") % 5 == 0) & (F.size("ts") == 1), F.concat(asked, asked)).otherwise(asked)
    return B.valid_generated(g.select("conv_id", "state", many.alias("questions"))).select("conv_id", "valid")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, len(string_split(text, ' ')) AS n FROM conversations),
s AS (SELECT conv_id, max(n) FILTER (r = 0) AS state, count(*) - 1 AS questions, coalesce(sum(n + 2 + 2 * (1 + 2)) FILTER (r > 0), 0) AS tokens FROM t GROUP BY conv_id)
SELECT conv_id, (state + tokens)::BIGINT AS length, questions::INT AS reads, (state + tokens - 1)::BIGINT AS last_read FROM s""")
def pack_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn is the state, the others are questions with two options of one word."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("n"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("ts"))
    rows = g.select("conv_id", F.element_at("ts", 1)["n"].alias("state"), F.transform(F.slice("ts", F.lit(2), F.size("ts")), lambda t: F.struct(t["n"].alias("tokens"), F.array(F.lit(1), F.lit(1)).alias("options"))).alias("qs"))
    out = Q.packed(rows, "state", "qs")
    last = F.when(F.size("reads") > 0, F.element_at("reads", -1)).otherwise(F.col("state") - 1)
    return out.select("conv_id", F.size("segments").cast("long").alias("length"), F.size("reads").alias("reads"), last.cast("long").alias("last_read"))


@query("""WITH s AS (SELECT l_orderkey AS k, list(seg ORDER BY l_linenumber) AS s FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 0 ELSE (l_linenumber - 1) // 2 END AS seg FROM lineitem) GROUP BY 1),
a AS (SELECT k, unnest(s) AS si, generate_subscripts(s, 1) - 1 AS i FROM s) SELECT x.k, count(*) AS allowed FROM a x JOIN a y ON x.k = y.k AND y.i <= x.i AND (x.si = y.si OR y.si = 0) GROUP BY x.k""")
def tree_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's sequences are orders, their places the lines."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    seg = F.when(F.col("line") <= 2, 0).otherwise(F.floor((F.col("line") - 1) / 2)).cast("int")
    places = numbered(line.select("k", "line", seg.alias("segment")), ["k"], "line", "i")
    return Q.allowed(Q.segment_ranges(places, ["k"], "i", "segment"), ["k"])


@query("""WITH m AS (SELECT event_id AS id, (event_id % 6)::INT AS step_index, 6 AS n_steps, list_transform(range(event_id % 7), lambda x: 'h') AS h, CASE WHEN event_id % 3 = 0 THEN 'TYPE' ELSE 'CLICK' END AS op FROM events)
SELECT id, step_index = 5 AS final, CASE WHEN step_index = 5 THEN 4 ELSE least(3, floor((step_index + 1) / 6.0 * 4)) END::INT AS progress, CASE WHEN len(h) <= 2 THEN len(h) WHEN len(h) <= 4 THEN 3 ELSE 4 END::INT AS history_len, op = 'TYPE' AS needs_text, 'button' AS tag FROM m""")
def schema_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = (F.col("event_id") % 7).cast("int")
    rows = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 6).cast("int").alias("step_index"), F.lit(6).alias("n_steps"), F.array_repeat(F.lit("h"), n).alias("history"), F.when(F.col("event_id") % 3 == 0, "TYPE").otherwise("CLICK").alias("op"), F.lit(None).cast("string").alias("target_tag"), F.lit("[BUTTON] x").alias("target_repr"))
    return B.schema_targets(rows)


@query("SELECT 'a_' || doc_id AS id, 'a' AS source, text AS state, quality::VARCHAR AS target FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'b_' || conv_id || '.' || turn, 'b', text, role FROM conversations WHERE role <> ''")
def converters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    c = table(spark, sf_dir, "conversations")
    a = B.converted(d, "a", F.col("doc_id"), F.col("text"), B.question("q", "noul", F.lit("Good?")), F.col("quality"))
    b = B.converted(c, "b", F.concat_ws(".", "conv_id", "turn"), F.col("text"), B.question("r", "choice", F.lit("Who?")), F.col("role"))
    return B.mixed([(a, None, 1), (b, None, 1)], "13").select("id", "source", "state", "target")


def _text_sql(x: str) -> str:
    """Text without the entities that the sample pages hold, blanks collapsed."""
    for entity, text in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{entity}', '{text}')"
    return x


_ANCHOR = r"""(?is)<a\s+href="([^"]*)"[^>]*>(.*?)(?:</a\s*>|\z)"""


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<head\b.*?(?:</head\s*>|\z)', '', 'g') AS h FROM pages),
a AS (SELECT page_id, i, {_text_sql("regexp_extract_all(h, '" + _ANCHOR + "', 1)[i]")} AS href, left(trim(regexp_replace({_text_sql("regexp_replace(regexp_extract_all(h, '" + _ANCHOR + "', 2)[i], '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')), 60) AS text
 FROM p, unnest(range(1, len(regexp_extract_all(h, '{_ANCHOR}', 1)) + 1)) AS r(i)),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS idx FROM a WHERE text <> '') SELECT page_id, idx, 'a' AS tag, '' AS type, text, href, '' AS value FROM n WHERE idx <= 120""")
def dom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample pages hold links only, which is what the SQL looks for."""
    return dom.candidates(table(spark, sf_dir, "pages"))


@query("""WITH RECURSIVE d AS (SELECT source, lang, doc_id, toxic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents JOIN labels USING (doc_id)),
g AS (SELECT source, NULL::VARCHAR AS lang, NULL::BIGINT AS doc_id, NULL::BIGINT AS toxic, 0::BIGINT AS r, FALSE AS kept, 0 AS c0, 0 AS c1, []::VARCHAR[] AS taken FROM d GROUP BY source
 UNION ALL SELECT source, lang, doc_id, toxic, r, ok, c0 + (ok AND toxic = 0)::INT, c1 + (ok AND toxic = 1)::INT, CASE WHEN ok THEN list_append(taken, lang) ELSE taken END
 FROM (SELECT d.*, c0, c1, taken, CASE toxic WHEN 0 THEN c0 <= c1 + 5 ELSE c1 <= c0 + 5 END AND len(list_filter(taken, lambda x: x = d.lang)) < 50 AS ok FROM (SELECT source, r, c0, c1, taken FROM g) g JOIN d ON d.source = g.source AND d.r = g.r + 1))
SELECT source, lang, doc_id, toxic FROM g WHERE kept""")
def balance_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a shard of its own."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "lang", "doc_id", "toxic")
    return Q.balanced(d, "source", "lang", "doc_id", "toxic", 50, 5)


@query(f"""WITH RECURSIVE s AS (SELECT floor({_UNIT.format(seed='15', key='doc_id')} * 64)::BIGINT AS shard, doc_id, n_chars FROM documents), d AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n_chars, doc_id) AS r FROM s),
g AS (SELECT shard, NULL::BIGINT AS doc_id, NULL::BIGINT AS n_chars, 0::BIGINT AS r, 0::BIGINT AS batch, 0::BIGINT AS size, 0::BIGINT AS longest FROM d GROUP BY shard
 UNION ALL SELECT shard, doc_id, n_chars, r, batch + full::INT, CASE WHEN full THEN 1 ELSE size + 1 END, CASE WHEN full THEN n_chars ELSE greatest(longest, n_chars) END
 FROM (SELECT d.shard, d.doc_id, d.n_chars, d.r, batch, size, longest, size > 0 AND (size >= 32 OR greatest(longest, d.n_chars) * (size + 1) > 200000) AS "full" FROM g JOIN d ON d.shard = g.shard AND d.r = g.r + 1))
SELECT shard, doc_id, n_chars, batch FROM g WHERE r > 0""".replace("batch + full::INT", 'batch + "full"::INT').replace("WHEN full THEN", 'WHEN "full" THEN'))
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of documents by hash, so that they are even."""
    d = table(spark, sf_dir, "documents").select(F.floor(N.hash_unit(F.col("doc_id"), "15") * 64).alias("shard"), "doc_id", "n_chars")
    return Q.length_batches(d, "shard", "doc_id", "n_chars", 200_000, 32)


@query(f"""WITH n AS (SELECT greatest(1, ceil(count(*) / 100000.0)) AS shards FROM documents), s AS (SELECT doc_id, lang, floor({_UNIT.format(seed='14/s', key='doc_id')} * shards) AS s FROM documents, n),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('14:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY s) AS n FROM s)
SELECT a.doc_id, a.lang, b.doc_id AS b_doc_id, b.lang AS b_lang FROM r a JOIN r b ON a.s = b.s AND b.r = a.r % a.n + 1""")
def partner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_partner(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "14")
