"""From documents to token sequences: five stages, each one operator on all rows that the stage before kept.

toxicity drops documents that score the threshold or more, exact_dedup all but the largest doc_id of equal texts (as the
operator's query keeps it), simhash all but the smallest of each group of near copies (the name of its group),
decontamination documents that hold a benchmark window; sentencepiece encodes what is left. All but the last return the
columns of documents. Each stage is written as Parquet and read again; then its scratch tables and its input go.

Defined cases: empty tables give empty tables; null and repeated ids are rows of their own; a null text counts as empty,
and of empty texts one stays; without labels of both classes nothing is toxic but where most labels are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from decidra.llm import decontaminate, exact_dedup, pieces, simhash, toxicity
from decidra.llm.common import discard_path, kept_until_exit, scope, scratch_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_copies(docs, shingle=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash", near), ("decontamination", benchmark), ("sentencepiece", encode)]

#: SQL can't express the learnt scores, the fingerprints and the sampled pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, before = table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    kept_until_exit(spark, base)
    for name, stage in STAGES:
        with scope():
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{name}")
        if before:
            discard_path(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
