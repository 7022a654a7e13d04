"""Scans of the files that the engine takes: JSON lines, documents, text lists and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt"


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One row per JSON line, with the file's name; blank lines are no rows. tolerant drops lines that don't parse."""
    mode = "DROPMALFORMED" if tolerant else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Counts of good and bad lines per file."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file_name"))
    parsed = F.from_json("value", f"{schema}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.withColumn("bad", parsed[CORRUPT].isNotNull()).groupBy("file_name").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole document per file; a top-level array gives a row per element."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def keyed_objects(docs: DataFrame, column: str, schema: str, key: str = "id") -> DataFrame:
    """Rows (key, fields...) from a JSON text that maps keys to objects."""
    pairs = docs.select(F.explode(F.from_json(column, "map<string,string>")).alias(key, "_object"))
    return pairs.select(key, F.from_json("_object", schema).alias("_row")).select(key, "_row.*")


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    value = F.trim("value")
    return spark.read.text(path).select(value.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def assignments(lines: DataFrame, column: str = "value") -> DataFrame:
    """name and value of `name=value` lines; only the first sign separates."""
    part = F.split(F.trim(column), "=", 2)
    kept = lines.where(F.col(column).contains("=") & ~F.trim(column).startswith("#"))
    return kept.select(F.trim(part[0]).alias("name"), F.trim(part[1]).alias("value"))


def log_fields(lines: DataFrame, pattern: str, names: dict[str, str], column: str = "value") -> DataFrame:
    """Typed fields of lines that match a pattern, one per group; `None` and empty groups are null."""

    def field(k: int, kind: str) -> Column:
        text = F.nullif(F.regexp_extract(column, pattern, k), F.lit(""))
        return F.when(text != "None", text).try_cast(kind)

    return lines.where(F.col(column).rlike(pattern)).select(*[field(k, kind).alias(name) for k, (name, kind) in enumerate(names.items(), 1)])


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """The file of a row of a stored table and its place in it, for first-wins and last-wins rules.

    They are the same however the files are split and however many cores read them.
    """
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Files of pictures with their bytes, kind and size; the size of a PNG is in its header, of others it is null."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").when(head == "47494638", "gif")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "content", kind.alias("kind"), F.when(kind == "png", number(17)).alias("width"), F.when(kind == "png", number(21)).alias("height"))


def inline_image(text: Column) -> Column:
    """Bytes of a picture sent as base64, with or without a data prefix."""
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*,", ""))


def split_rows(parquet: DataFrame, columns: list[str], key: str, n: int | None, seed: str, skip: int = 0) -> DataFrame:
    """Some columns of a stored dataset: n rows in hashed order after the first skip; all of them without n."""
    from decidra.functions.numeric import hash_order

    rows = parquet.select(*columns)
    return rows if n is None else rows.orderBy(hash_order(F.col(key), seed), key).offset(skip).limit(n)
