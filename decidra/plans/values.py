"""Queries on votes, tables for display, codes of texts, numbers, payloads and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions import numeric as N
from decidra.functions import text as X
from decidra.operators import builders as B
from decidra.operators import experiments as E
from decidra.operators import items as I
from decidra.operators import joins as J
from decidra.operators import labels as L
from decidra.operators import metrics as M
from decidra.sources import commits
from decidra.sources import readers as R
from decidra.sources import writers as W
from decidra.sources.scratch import folder

from .registry import query
from .rows import recorded
from .scoring import rounded
from .standins import CHOICES_SQL, choices, table


@query("""SELECT conv_id, count(*) AS n, round(avg((role = 'user')::INT), 6) AS p_user, round(avg((role = 'assistant')::INT), 6) AS p_assistant, round(avg((role = 'none')::INT), 6) AS p_none
FROM conversations WHERE role IN ('user', 'assistant', 'none') GROUP BY conv_id""")
def vote_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of turns as votes; nobody votes for none."""
    keys = ["user", "assistant", "none"]
    shares = M.vote_shares(table(spark, sf_dir, "conversations").select("conv_id", "role"), ["conv_id"], "role", keys)
    return shares.select("conv_id", "n", *[F.round(k, 6).alias(f"p_{k}") for k in keys])


@query("SELECT event_type AS family, count_if(user_id % 4 = 0) AS t0, count_if(user_id % 4 = 1) AS t1, count_if(user_id % 4 = 9) AS t9 FROM events GROUP BY 1")
def family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), (F.col("user_id") % 4).alias("target"))
    return M.crosstab(e, "family", "target", [0, 1, 9], F.count(F.lit(1))).toDF("family", "t0", "t1", "t9")


@query("SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, source NULLS FIRST)::INT AS place FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ordered_groups(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT event_type, user_id % 3 AS block, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("block"), "value")
    return e.cube("event_type", "block").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(r"SELECT page_id, (len(regexp_extract_all(url, '\d')) + len(regexp_extract_all(url, '\D+')))::INT AS pieces FROM pages")
def digit_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.digit_pieces(F.col("url")).alias("pieces"))


@query("""WITH h AS (SELECT doc_id, rpad(left(hex(encode(left(coalesce(text, ''), 24))), 48), 48, '0') AS h FROM documents)
SELECT doc_id, array_to_string([('0x' || substr(h, 2 * i + 1, 2))::INT for i in range(24)], ',') AS codes FROM h""")
def byte_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator cuts or pads to 24 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.byte_codes(F.col("text"), 24).cast("array<string>"), ",").alias("codes"))


@query("SELECT event_id, (list_reduce([(event_id % 50 + 2)::BIGINT for i in range(event_id % 12 + 1)], lambda x, y: x * y % (97 + event_id % 5)) % (97 + event_id % 5))::BIGINT AS answer FROM events")
def power_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", N.power_mod(i % 50 + 2, i % 12 + 1, 97 + i % 5).alias("answer"))


@query(f"""WITH {CHOICES_SQL}, e AS (SELECT id, gold, k, exp(z - max(z) OVER (PARTITION BY id)) AS e, z FROM long), p AS (SELECT id, gold, k, z, e / sum(e) OVER (PARTITION BY id) AS p FROM e),
g AS (SELECT id, any_value(gold) AS gold, max(p) AS top, arg_max(k, (z, -k)) AS pred, max(p) FILTER (k = gold) AS "right" FROM p GROUP BY id),
f AS (SELECT *, CASE id % 3 WHEN 0 THEN 'alice' WHEN 1 THEN 'bob' ELSE 'carol' END AS family, id % 20 AS position FROM g),
u AS (SELECT family, pred, gold, top, "right" FROM f UNION ALL SELECT CASE WHEN position < 10 THEN 'bob 0-9' ELSE 'bob 10-19' END, pred, gold, top, "right" FROM f WHERE family = 'bob')
SELECT family, count(*) AS n, round(avg((pred = gold)::INT), 6) AS acc, round(avg(top), 6) AS top, round(avg("right"), 6) AS "right" FROM u GROUP BY family""")
def capability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = choices(spark, sf_dir).withColumn("p", N.softmax(F.col("logits")))
    family = F.when(F.col("id") % 3 == 0, "alice").when(F.col("id") % 3 == 1, "bob").otherwise("carol")
    rows = c.select(family.alias("family"), (F.col("id") % 20).alias("position"), (N.arg_max(F.col("logits")) == F.col("gold")).cast("int").alias("hit"), F.array_max("p").alias("top"), F.get("p", F.col("gold")).alias("right"))
    return rounded(E.capability(rows, "bob", 10), "acc", "top", "right")


@query("""SELECT doc_id, array_to_string(list_sort(CASE WHEN doc_id % 4 = 0 THEN ['kind=a', 'lang=' || lang, 'source=' || source] ELSE ['kind=a', 'lang=' || lang, 'n=' || n_chars, 'source=x' || doc_id % 3] END), ';') AS meta FROM documents""")
def merged_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meta data of a row with newer ones, which every fourth row doesn't have."""
    text = lambda c: c.cast("string")
    old = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("kind"), F.lit("a"))
    new = F.when(F.col("doc_id") % 4 != 0, F.create_map(F.lit("source"), F.concat(F.lit("x"), text(F.col("doc_id") % 3)), F.lit("n"), text(F.col("n_chars"))))
    entries = F.transform(F.map_entries(B.merged_maps(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(entries), ";").alias("meta"))


@query("""SELECT conv_id, turn, '{"said":{"type":"choice","instructions":' || to_json(role) || ',"criteria":[{"key":"A","descr":' || to_json(role || ' it') || '},{"key":"B","descr":"x"}]}}' AS payload FROM conversations""")
def api_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(F.struct(F.lit("A").alias("key"), F.concat("role", F.lit(" it")).alias("descr")), F.struct(F.lit("B").alias("key"), F.lit("x").alias("descr")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", I.payload(F.array(B.question("said", "choice", F.col("role"), options))).alias("payload"))


@query("SELECT p_partkey, left(p_name || ' ' || p_type || repeat('.', 80), 80) AS text, round(p_retailprice) AS x, round(p_size / 4.0::DOUBLE) AS y FROM part")
def trimmed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit("." * 80))
    size = (F.col("p_size") / 4).cast("double")
    box = F.struct(F.lit("a").alias("tag"), F.lit("").alias("type"), text.alias("text"), F.col("p_retailprice").alias("x"), size.alias("y"), size.alias("w"), size.alias("h"))
    b = F.element_at(I.trimmed_boxes(F.array(box)), 1)
    return table(spark, sf_dir, "part").select("p_partkey", b["text"].alias("text"), b["x"].alias("x"), b["y"].alias("y"))


@query("""WITH c AS (SELECT page_id, unnest(['1', '2', '3', '4']) AS key, unnest(['Search', 'Link ' || page_id, 'Go', 'odd text']) AS label, unnest(['w' || (page_id % 3), '', '', '']) AS v FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '1', 'Search', 'w' || (page_id % 3) FROM pages WHERE page_id % 2 = 1)
SELECT page_id, key, '{"element":"[' || key || '] ' || label || '","current_value":"' || v || '"}' AS descr FROM c""")
def target_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of odd pages only the elements that take typing."""
    s = recorded(spark, sf_dir).select(F.regexp_extract("before_img", r"(\d+)", 1).cast("long").alias("page_id"), "candidates")
    every, typeable = (I.target_options(F.col("candidates"), only) for only in (False, True))
    o = s.select("page_id", F.explode(F.when(F.col("page_id") % 2 == 0, every).otherwise(typeable)).alias("o"))
    return o.select("page_id", "o.key", "o.descr")


_ELEMENTS = "CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'input' WHEN 2 THEN 'button' ELSE 'textarea' END"


@query(f"""WITH e AS (SELECT p_partkey, {_ELEMENTS} AS tag, p_brand AS text, CASE p_partkey % 5 WHEN 0 THEN '#top' WHEN 1 THEN 'mailto:x' WHEN 2 THEN NULL ELSE '/x' END AS href, CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'password' END AS type FROM part)
SELECT p_partkey, CASE WHEN tag = 'a' THEN 'follow' WHEN tag = 'button' THEN 'click' ELSE 'search' END AS goal_kind FROM e
WHERE (tag = 'a' AND len(text) BETWEEN 3 AND 40 AND href = '/x') OR (tag IN ('input', 'textarea') AND coalesce(type, '') <> 'password') OR (tag = 'button' AND len(text) >= 2)""")
def goal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") % 4
    tag = F.when(size == 0, "a").when(size == 1, "input").when(size == 2, "button").otherwise("textarea")
    href = F.when(k % 5 == 0, "#top").when(k % 5 == 1, "mailto:x").when(k % 5 != 2, "/x")
    e = table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"), F.col("p_brand").alias("text"), href.alias("href"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "password").alias("type"))
    return L.goals(e).select("p_partkey", "goal_kind")


@query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) SELECT c_custkey, s_suppkey FROM c JOIN s USING (r)""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    return J.positional(c, s, "c_custkey", "s_suppkey")


# ---- Sinks, read back


@query("SELECT doc_id, lang, n_chars FROM documents")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in a folder for each language, read back."""
    path = folder(spark)
    W.json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, by="lang")
    return spark.read.schema("doc_id long, n_chars long, lang string").json(path).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, count(*) AS times FROM documents GROUP BY doc_id")
def resumed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped half way and is repeated, and an empty result that must not replace it."""
    path, rows = folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    for part in (rows.where("doc_id % 2 = 0"), rows):
        commits.append_new(part, path, "doc_id", "doc_id long, lang string")
    commits.overwrite_unless_empty(rows.where("false"), path)
    return commits.read(spark, path, "doc_id long, lang string").groupBy("doc_id").agg(F.count("*").alias("times"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 3) AS mean FROM documents GROUP BY lang")
def report_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as one JSON object, stored and read back."""
    path = folder(spark)
    report = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("mean"))
    W.report_json(report).write.text(path)
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<lang:string,n:long,mean:double>>")).alias("r"))
    return rows.select("r.*")


# ---- Files, written and scanned


@query("SELECT doc_id, sha256(text) AS text_sha256, lang, 'part-' AS file FROM documents")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines in many files, found by a pattern of names, with blank lines between them."""
    path, d = folder(spark), table(spark, sf_dir, "documents")
    d.select(F.concat(F.to_json(F.struct("doc_id", "text", "lang")), F.when(F.col("doc_id") % 3 == 0, "\n\n  ").otherwise("")).alias("value")).write.text(path)
    rows = R.json_lines(spark, f"{path}/part-*", "doc_id long, text string, lang string")
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", F.left("file_name", F.lit(5)).alias("file"))


@query("SELECT lang, count_if(doc_id % 7 <> 0)::BIGINT AS good, count_if(doc_id % 7 = 0)::BIGINT AS bad, sum(CASE WHEN doc_id % 7 <> 0 THEN doc_id END)::BIGINT AS ids FROM documents GROUP BY lang")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is cut off: counted as bad, and left out of the rows."""
    path, d = folder(spark), table(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "n_chars"))
    d.select("lang", F.when(F.col("doc_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.partitionBy("lang").text(path)
    schema, out = "doc_id long, n_chars long", None
    for lang in [r.lang for r in d.select("lang").distinct().orderBy("lang").limit(100).collect()]:
        of = f"{path}/lang={lang}"
        counts = R.bad_lines(spark, of, schema).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        part = counts.join(R.json_lines(spark, of, schema, tolerant=True).agg(F.sum("doc_id").alias("ids"))).select(F.lit(lang).alias("lang"), "good", "bad", "ids")
        out = part if out is None else out.union(part)
    return out


@query("SELECT s_suppkey, s_name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, which is one array of its suppliers over several lines."""
    path, s = folder(spark), table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entry = F.to_json(F.struct("s_suppkey", "s_name", F.col("n_name").alias("nation")))
    docs = s.groupBy("n_name").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("\n]")).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return R.json_document(spark, path, "s_suppkey long, s_name string, nation string")


@query("SELECT 'page' || page_id AS name, url || '=x' AS value FROM pages WHERE page_id % 5 <> 0")
def text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of assignments in which every fifth line is a comment; blank lines are none."""
    path, p = folder(spark), table(spark, sf_dir, "pages")
    line = F.concat(F.lit(" page"), F.col("page_id").cast("string"), F.lit("= "), F.col("url"), F.lit("=x \n"))
    p.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("value")).write.text(path)
    return R.assignments(R.text_list(spark, path))
