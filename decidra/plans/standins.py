"""Tables of the row model derived from the given ones by integer arithmetic, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    label = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    rows = d.select("doc_id", F.col("lang").alias("question"), F.col("source").alias("site")).join(label, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("id"), "question", F.lit("noul").alias("type"), "label", "site")


def predictions(spark: SparkSession, sf_dir: str, factor: int = 7919, steps: int = 50) -> DataFrame:
    """p in steps, so that scores tie; only labelled documents have one."""
    rows = table(spark, sf_dir, "labels")
    return rows.select(F.col("doc_id").alias("id"), (F.pmod(F.col("doc_id") * factor + 31, F.lit(steps)) / F.lit(float(steps))).alias("p"), F.lit(None).cast("string").alias("choice"), F.pmod("doc_id", F.lit(97)).cast("double").alias("ms"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of options, one for each entry of a vector, and the right one."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.col("label").cast("int").alias("gold"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of the users' episodes, numbered from 0."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select("event_id", F.col("user_id").alias("episode"), step.cast("long").alias("step"), F.col("event_type").alias("kind"), "value")


# The same in SQL, as common table expressions.
SCORED_SQL = """
items AS (SELECT d.doc_id AS id, d.lang AS question, d.source AS site, l.quality AS label, l.doc_id IS NOT NULL AS answered,
                 CASE WHEN l.doc_id IS NOT NULL THEN ((d.doc_id * 7919 + 31) % 50) / 50.0::DOUBLE END AS p, (d.doc_id % 97)::DOUBLE AS ms
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
scored AS (SELECT *, label AS y, CASE WHEN p > 0.5 THEN p ELSE 1 - p END AS conf, CASE WHEN answered THEN ((p > 0.5) = (label = 1))::INT END AS hit FROM items)"""
SECOND_SQL = SCORED_SQL.replace("items AS", "items2 AS").replace("scored AS", "scored2 AS").replace("FROM items)", "FROM items2)").replace("* 7919", "* 104729")
CHOICES_SQL = """
choices AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS z, label::INT AS gold FROM embeddings),
long AS (SELECT id, gold, unnest(z) AS z, generate_subscripts(z, 1) - 1 AS k FROM choices)"""
STEPS_SQL = """
steps AS (SELECT event_id, user_id AS episode, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS step, event_type AS kind, value FROM events)"""
