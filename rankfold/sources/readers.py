"""Readers: corpora, question sets, replies; and what a source is."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_NAMES = ("text", "abstract", "content")


def text_column(columns: list[str], part_of_name: bool) -> str:
    """The first column named text, abstract or content; for CSV a part of the name is enough."""
    for c in columns:
        if any(n in c.lower() if part_of_name else n == c.lower() for n in TEXT_NAMES):
            return c
    raise ValueError(f"no text column among {columns}; name one")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumnRenamed(text, "text").filter("text is not null and trim(text) <> ''")


def read_csv_corpus(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """All columns as strings, the text column as ``text``; blank texts are skipped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return _with_text(df, text or text_column(df.columns, part_of_name=True))


def read_parquet_corpus(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return _with_text(df, text or text_column(df.columns, part_of_name=False))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    return df.filter("trim(text) <> ''")


def read_splits(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """The union of a dataset's splits, with columns that only some have."""
    parts = [spark.read.parquet(f"{folder}/{s}").withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_questions(spark: SparkSession, path: str, first: int = -1) -> DataFrame:
    """A question a line, as JSON; malformed lines are dropped; ``first`` lines of the file, or all."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    lines = lines if first < 0 else lines.orderBy("line").limit(first)
    ok = lines.withColumn("question", F.get_json_object("value", "$.question"))
    return ok.filter(F.col("question").isNotNull()).select("line", "question", F.col("value").alias("entry"))


def read_replies(spark: SparkSession, *paths: str) -> DataFrame:
    """(custom_id, json) of reply files; the key is custom_id, key or id; empty lines go, lines without a key too."""
    lines = spark.read.text(list(paths)).filter("trim(value) <> ''")
    key = F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in ("custom_id", "key", "id")))
    return lines.select(key.alias("custom_id"), F.col("value").alias("json")).filter("custom_id is not null")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def parse_source(path: str) -> tuple[str, str]:
    """(url, hf or local; name)."""
    if path.startswith(("http://", "https://")):
        return "url", path.rstrip("/").rsplit("/", 1)[-1]
    if ":" in path:
        return "hf", path.replace(":", "_")
    return "local", path.rstrip("/").rsplit("/", 1)[-1]


def read_meta(df: DataFrame) -> dict[str, str]:
    """A run's small key-value table; a few keys by design."""
    row = df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("m")).first()
    return json.loads(row["m"]) if row and row["m"] else {}


def is_true(value: str | None) -> bool:
    return (value or "").strip().lower() in ("1", "true", "yes")
