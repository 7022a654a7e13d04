"""Queries on items in other shapes, options, answers and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decidra.functions import numeric as N
from decidra.functions import text as X
from decidra.operators import builders as B
from decidra.operators import items as I
from decidra.operators import joins as J
from decidra.operators import sampling as S
from decidra.sources import writers as W

from .registry import query
from .standins import CHOICES_SQL, choices, table


@query("SELECT conv_id || '.' || turn || ':said:' || ':' || role AS id, 'said' AS question, text AS state, role AS label, 'f' || turn || '.png' AS image FROM conversations")
def items_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to items, to rows and to items again."""
    c = table(spark, sf_dir, "conversations")
    step = F.concat_ws(".", "conv_id", "turn")
    meta = F.struct(step.alias("step_id"), F.lit("s").alias("site"), F.lit(None).cast("string").alias("candidate"), F.col("role").alias("which"))
    target = F.array(F.struct(F.lit("said").alias("qid"), F.col("role").alias("hard"), F.lit(None).cast("double").alias("p_yes")))
    rows = c.select(F.col("text").alias("state"), F.array(F.concat(F.lit("/a/b/f"), F.col("turn").cast("string"), F.lit(".png"))).alias("images"), F.array(B.question("said", "choice", F.lit("Who?"))).alias("questions"), target.alias("targets"), meta.alias("meta"))
    again = I.to_rows(B.to_items(rows), "/img").withColumn("targets", F.transform("targets", lambda t: F.struct(t["qid"].alias("qid"), t["hard"].alias("hard"), F.lit(None).cast("double").alias("p_yes"))))
    return B.to_items(again).select("id", "question", "state", "label", F.element_at("images", 1).alias("image"))


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN 'doc' || doc_id ELSE 'item' || doc_id END AS id, round(doc_id % 10 / 10.0::DOUBLE, 6) AS p FROM labels WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0")
def submission_by_id_or_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"))
    outputs = d.select("i", F.when(F.col("i") % 3 == 0, F.concat(F.lit("doc"), F.col("i").cast("string"))).alias("id"), (F.col("i") % 10 / F.lit(10.0)).alias("p"), F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("ms"))
    items = d.where("i % 5 <> 0").select("i", F.concat(F.lit("item"), F.col("i").cast("string")).alias("id"))
    return I.to_submission(outputs, items).select("id", F.round("p", 6).alias("p"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'noul' WHEN 1 THEN 'score' ELSE 'choice' END AS qtype, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN ' Yes' ELSE 'no' END WHEN 1 THEN (event_id % 4)::VARCHAR ELSE event_type END AS a FROM events)
SELECT event_id, qtype, CASE qtype WHEN 'noul' THEN (lower(trim(a)) = 'yes')::INT::VARCHAR WHEN 'score' THEN round(a::DOUBLE)::INT::VARCHAR ELSE a END AS target FROM e""".replace("a::DOUBLE", "try_cast(a AS DOUBLE)"))
def external_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    qtype = F.when(i % 3 == 0, "noul").when(i % 3 == 1, "score").otherwise("choice")
    answer = F.when(i % 3 == 0, F.when(i % 2 == 0, " Yes").otherwise("no")).when(i % 3 == 1, (i % 4).cast("string")).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", qtype.alias("qtype"), I.typed_target(qtype, answer).alias("target"))


@query("""SELECT p_partkey, 'part' || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' name="' || left(p_name, 40) || '"' END || ' brand="' || left(p_brand, 40) || '"' AS descr FROM part""")
def element_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", I.described(F.lit("part"), {"name": F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")), "brand": F.col("p_brand")}).alias("descr"))


@query("""WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'effect' ELSE 'done' END AS q, CASE WHEN doc_id % 2 = 0 THEN 'after' ELSE 'before' END AS w, text AS b, lang || text AS a FROM documents)
SELECT doc_id, 's' || 'Elements:' || chr(10) || CASE WHEN q = 'effect' THEN 'Before:' || chr(10) || b || chr(10) || 'After:' || chr(10) || a WHEN w = 'after' THEN a ELSE b END AS view FROM v""")
def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 3 == 0, "effect").otherwise("done")
    w = F.when(F.col("doc_id") % 2 == 0, "after").otherwise("before")
    return d.select("doc_id", I.text_view(q, w, F.lit("s"), F.col("text"), F.concat("lang", "text")).alias("view"))


_NEAR = """d AS (SELECT a.p_partkey AS part, b.p_partkey AS other, abs(a.p_size - b.p_size) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey),
n AS (SELECT part, other, row_number() OVER (PARTITION BY part ORDER BY distance, other) AS r FROM d)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("part"), "p_size", "p_name", (F.col("p_size") % 3).alias("role"))


@query(f"""WITH {_NEAR}, o AS (SELECT part, other AS o FROM n WHERE r < 5 UNION ALL SELECT DISTINCT part, part FROM n WHERE (('0x' || substr(md5('21/none:' || part), 1, 8))::BIGINT / 4294967296.0::DOUBLE) >= 0.2),
g AS (SELECT part, list(o ORDER BY md5('21:' || part || ':' || o), o) AS l FROM o GROUP BY part) SELECT part, array_to_string(l, ',') AS options, CASE WHEN list_contains(l, part) THEN list_position(l, part)::VARCHAR ELSE 'none' END AS gold FROM g""")
def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = J.nearest(_parts(spark, sf_dir), ["p_brand", "p_type"], "part", {"p_size": 1.0}, 4)
    out = I.choice_items(near, "part", "21", 0.2)
    return out.select("part", F.array_join(F.col("options").cast("array<string>"), ",").alias("options"), "gold")


@query("""WITH d AS (SELECT a.p_partkey AS part, b.p_partkey AS other, a.p_size % 3 <> b.p_size % 3 AS role, abs(len(a.p_name) - len(b.p_name)) + ('0x' || substr(md5('22:' || a.p_partkey || ':' || b.p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 3 AS gap
 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY role, gap, other) AS rank FROM d)
SELECT part, other, rank::INT AS rank FROM r WHERE rank <= 4""")
def confusable_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.confusable(_parts(spark, sf_dir), ["p_brand", "p_type"], "part", "role", "p_name", 4, "22").select("part", "other", "rank")


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, lower(trim(role)) IN ('user', 'assistant') AS ok, role FROM conversations WHERE lower(trim(role)) IN ('user', 'assistant'))
SELECT page_id, turn, (role = 'user')::INT AS y FROM pages JOIN c ON c.conv_id = page_id WHERE r <= 2""")
def images_with_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no questions, two for an image at most; pages stand for images and turns for questions."""
    q = table(spark, sf_dir, "conversations").where(F.lower(F.trim("role")).isin("user", "assistant"))
    q = q.select(F.col("conv_id").alias("page_id"), "turn", (F.col("role") == "user").cast("int").alias("y"))
    return J.fan_out(table(spark, sf_dir, "pages").select("page_id"), q, "page_id", 2, "turn").select("page_id", "turn", "y")


@query("""WITH s AS (SELECT s_suppkey AS k, n_name AS gold FROM supplier JOIN nation ON s_nationkey = n_nationkey), o AS (SELECT k, gold, unnest(['A', 'B', 'C']) AS o FROM s),
r AS (SELECT k, gold, o, row_number() OVER (PARTITION BY k ORDER BY md5('23:' || k || ':' || o), o) AS r FROM o),
p AS (SELECT k, gold, r_name AS o, row_number() OVER (PARTITION BY k ORDER BY md5('23+:' || k || ':' || r_name), r_name) AS r FROM s CROSS JOIN region),
u AS (SELECT k, o FROM r WHERE r <= 5 UNION ALL SELECT k, o FROM p WHERE r <= 2 UNION ALL SELECT k, gold FROM s) SELECT k, string_agg(o, '|' ORDER BY md5('23!:' || k || ':' || o), o) AS options FROM u GROUP BY k""")
def augmented_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    names = table(spark, sf_dir, "region").select("r_name").distinct()
    if names.limit(S.MOST_OPTIONS + 1).count() > S.MOST_OPTIONS:
        raise ValueError("too many names for a pool")
    pool = names.agg(F.collect_set("r_name").alias("pool"))
    criteria = F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.col("n_name"))
    out = s.join(F.broadcast(pool)).select(F.col("s_suppkey").alias("k"), I.augmented(criteria, F.col("n_name"), F.col("s_suppkey"), F.col("pool"), 6, "23").alias("options"))
    return out.select("k", F.array_join("options", "|").alias("options"))


@query(f"""WITH {CHOICES_SQL}, m AS (SELECT id, max(z) AS m, max(z) FILTER (k = 0) AS z0 FROM long GROUP BY id), e AS (SELECT id, z0, k, z, exp((z - m) / 0.5) AS e FROM long JOIN m USING (id)), p AS (SELECT id, z0, k, z, e / sum(e) OVER (PARTITION BY id) AS p FROM e),
g AS (SELECT id, any_value(z0) AS z0, max(p) AS top, count(*)::DOUBLE AS n, arg_max(k, (z, -k)) AS pred, sum(p * k) AS level FROM p GROUP BY id), t AS (SELECT *, CASE id % 3 WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' ELSE 'score' END AS qtype, 1 / (1 + exp(-z0 / 2.0)) AS y FROM g)
SELECT id, qtype, CASE WHEN qtype = 'noul' THEN CASE WHEN y > 0.5 THEN 'yes' ELSE 'no' END ELSE pred::VARCHAR END AS choice, round(CASE WHEN qtype = 'noul' THEN abs(y - 0.5) * 2 ELSE (top - 1 / n) / (1 - 1 / n) END, 6) AS conf, round(CASE WHEN qtype = 'score' THEN level END, 6) AS level FROM t""")
def server_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    qtype = F.when(F.col("id") % 3 == 0, "noul").when(F.col("id") % 3 == 1, "choice").otherwise("score")
    rows = choices(spark, sf_dir).select("id", qtype.alias("qtype"), F.col("logits").alias("z"), F.transform("logits", lambda _, i: i.cast("string")).alias("keys"))
    return I.answers(rows, 2.0, 0.5).select("id", "qtype", "choice", F.round("conf", 6).alias("conf"), F.round("level", 6).alias("level"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 40 > 32 THEN 'error' WHEN o_orderkey % 40 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 AND o_orderkey % 40 > 1 THEN 'error' WHEN o_custkey % 10 / 10.0 < 0.4 THEN 'abstain' WHEN o_orderkey % 40 < o_custkey % 20 + 1 THEN 'reobserve' ELSE 'act' END AS action,
CASE WHEN o_orderkey % 40 > 32 THEN 'too many options' WHEN o_orderkey % 40 = 0 THEN 'no options' WHEN o_orderkey % 7 = 0 AND o_orderkey % 40 > 1 THEN 'ids are not unique' END AS error FROM orders""")
def chooser_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 40).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((F.col("o_orderkey") % 7 == 0) & (n > 1), F.least(i, n - 1)).otherwise(i).cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"), (F.col("o_custkey") % 10 / F.lit(10.0)).alias("conf"), (F.col("o_custkey") % 20 + 1).cast("string").alias("choice"))
    return I.chosen_actions(rows, 0.4).select("o_orderkey", "action", "error")


@query(f"""WITH {CHOICES_SQL}, m AS (SELECT id, max(z) AS m FROM long GROUP BY id), e AS (SELECT id, gold, k, exp(z - m) AS e, exp((z - m) / 2) AS f FROM long JOIN m USING (id)), p AS (SELECT id, gold, k, e / sum(e) OVER (PARTITION BY id) AS p, f / sum(f) OVER (PARTITION BY id) AS q FROM e)
SELECT count(*) AS n, round(avg(abs(p - q)), 6) AS sensitivity FROM p WHERE k = gold""")
def permutation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reversed run is one at another temperature."""
    c = choices(spark, sf_dir)
    plain = c.select("id", "gold", N.softmax(F.col("logits")).alias("p"))
    turned = c.select("id", F.reverse(N.softmax(F.col("logits"), 2.0)).alias("p"))
    return I.permutation_sensitivity(plain, turned).withColumn("sensitivity", F.round("sensitivity", 6))


@query("""SELECT page_id, contains(html, '<nav>') AS nav, len(html) > 500 AS long, starts_with(url, 'https') AS secure, contains(html, '<nav>') AND len(html) > 500 AND starts_with(url, 'https') AS ok FROM pages""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return I.page_checks(p, {"nav": F.col("html").contains("<nav>"), "long": F.length("html") > 500, "secure": F.col("url").startswith("https")}).select("page_id", "nav", "long", "secure", "ok")


@query("""SELECT page_id, url || '/' || t || '__' || v || '.html' AS url, t AS template, v AS variant FROM pages CROSS JOIN (SELECT unnest(['booking', 'catalog', 'help', 'index', 'search', 'settings', 'signup']) AS t) CROSS JOIN (SELECT unnest(['base', 'checked1', 'disabled1', 'done1', 'filled1', 'overlay1', 'wrong1']) AS v)""")
def synthetic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of a site with all templates and states."""
    return I.synthetic_pages(table(spark, sf_dir, "pages"), F.concat("url", F.lit("/"))).select("page_id", "url", "template", "variant")


@query("""SELECT o_orderkey, strftime(o_orderdate::DATE + 21, '%A, %B %-d') AS spelt FROM orders""")
def stay_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", I.stay_dates(F.col("o_orderdate").cast("date"), 21).alias("spelt"))


@query(r"""SELECT conv_id, turn, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40) AS squeezed, coalesce(nullif(regexp_extract(lower(role || ' 12 x'), '\b(none|\d+)\b', 1), ''), '') AS vote, 0.25::DOUBLE AS number, replace(replace(replace('<' || role || '&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
rtrim(role || '??', '?') AS stripped, split_part(text, ' ', 1) AS word, lpad(turn::VARCHAR, 4, ' ') || ' ' || rpad(role, 10, ' ') AS line FROM conversations""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        X.squeezed(F.col("text"), 40).alias("squeezed"),
        F.coalesce(X.vote(F.concat("role", F.lit(" 12 x"))), F.lit("")).alias("vote"),
        X.first_number(F.lit("p: 0.25 or so")).alias("number"),
        W.escaped_html(F.concat(F.lit("<"), "role", F.lit("&"))).alias("html"),
        X.without_suffix(F.concat("role", F.lit("??")), "?").alias("stripped"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("word"),
        W.fixed_width({"turn": 4, "role": -10}).alias("line"),
    )


@query("""WITH e AS (SELECT vec_id, list_transform(range(0, len(embedding)), lambda k: CASE WHEN k % 2 = label % 2 THEN embedding[k + 1]::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM embeddings) SELECT vec_id, round(list_sum(v), 6) AS mass, round(v[4], 6) AS fourth, len(v)::INT AS n FROM e""")
def soft_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in the order of the keys; every second key is missing."""
    e = table(spark, sf_dir, "embeddings")
    soft = F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("string").alias("key"), x.cast("double").alias("p"))), lambda s: s["key"].cast("int") % 2 == F.col("label") % 2)
    v = X.soft_vector(F.transform("embedding", lambda _, i: i.cast("string")), soft)
    return e.select("vec_id", v.alias("v")).select("vec_id", F.round(N.total(F.col("v")), 6).alias("mass"), F.round(F.element_at("v", 4), 6).alias("fourth"), F.size("v").alias("n"))


@query("""WITH e AS (SELECT event_id // 10 AS step, value AS loss, event_id % 10 = 0 AS is_eval, event_id FROM events) SELECT step, count_if(NOT is_eval)::BIGINT AS n, round(avg(loss) FILTER (NOT is_eval), 4) AS loss, round(max(loss) FILTER (is_eval), 4) AS eval FROM e GROUP BY step""")
def training_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss every ten steps and the evaluation between, from the two kinds of record."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 10 == 0
    return e.groupBy(F.floor(F.col("event_id") / 10).alias("step")).agg(F.count_if(~kind).alias("n"), F.round(F.avg(F.when(~kind, F.col("value"))), 4).alias("loss"), F.round(F.max(F.when(kind, F.col("value"))), 4).alias("eval"))


@query("""SELECT 'img/' || source || '/' || lang || '.png' AS dst, 'img/' || min(doc_id) || '.png' AS src FROM documents GROUP BY source, lang""".replace("'img/' || min(doc_id) || '.png'", "min('img/' || doc_id || '.png')"))
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("src"), F.concat(F.lit("img/"), "source", F.lit("/"), "lang", F.lit(".png")).alias("dst"))
    return W.manifest(d, "src", "dst").select("dst", "src")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/new/' || c_mktsegment ELSE '/other/' || c_mktsegment END AS path FROM customer""")
def path_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    images = F.array(F.concat(F.when(F.col("c_custkey") % 2 == 0, "/old/").otherwise("/other/"), "c_mktsegment"))
    return c.select("c_custkey", F.element_at(W.moved(images, "/old/", "/new/"), 1).alias("path"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE r > 3""")
def pruned_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the newest three of each run."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return o.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))).where("r > 3").drop("r")
