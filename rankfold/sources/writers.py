"""Writers: artifacts, request files, logged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.parsing import truncated


def write_artifact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)


def write_per_query(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("query_idx").csv(path, header=True)


def write_parts(df: DataFrame, path: str, rows: int = 50_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).csv(path, header=True)


def write_requests(requests: DataFrame, path: str) -> None:
    """(custom_id, prompt) as JSON lines."""
    body = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    requests.select(F.to_json(F.struct("custom_id", body.alias("body"))).alias("value")).write.mode("overwrite").text(path)


def log_results(rows: DataFrame, path: str, most: int = 500) -> None:
    """JSON lines, texts cut to ``most`` characters."""
    cut = [truncated(F.col(c), most).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*cut).write.mode("append").json(path)
