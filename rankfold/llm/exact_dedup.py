"""Exact dedup by 128-bit content hash, with the bytes compared inside groups. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import ascii_lower, carried, stored

KEY = ["h1", "h2", "sha"]


def content_keys(text: Column) -> list[Column]:
    """128 bits of XXH64 under two seeds to group by, and SHA-256."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.sha2(text, 256).alias("sha")]


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Mark the copies among ``docs``: texts equal after lower-casing A-Z; a null text counts as empty.

    Adds keep_id (the smallest or largest id of the equal texts), group_size, kept and text_sha256; columns of
    these names are replaced. Null ids are passed over when keep_id is chosen; it is null, and the rows are
    kept, only if all ids of a group are null. Rows that repeat both the id and the text of the row that stays
    are all marked kept. An empty table gives an empty table.

    The groups are formed by hash and bytes together, after map-side aggregation, so one copy of a text leaves
    each task however large the group is, and two texts that share a hash are two groups. The decision then
    returns to the rows by hash and SHA-256; if two different texts ever shared both, the job would stop with
    an error instead of merging them.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}; give smallest or largest")
    own = carried(docs)
    norm = ascii_lower(F.coalesce(own.at("text"), F.lit("")))
    pick = F.min if keep == "smallest" else F.max
    texts = (
        own.df.select(F.col(own.at("doc_id")).alias("id"), norm.alias("norm"))
        .select("id", "norm", *content_keys(F.col("norm"))[:2])
        .groupBy("h1", "h2", "norm")
        .agg(F.count("*").alias("n"), pick("id").alias("keep"))
    )
    groups = texts.select("h1", "h2", F.sha2("norm", 256).alias("sha"), "n", "keep").groupBy(*KEY)
    groups = groups.agg(F.count("*").alias("texts"), F.sum("n").alias("n"), pick("keep").alias("keep"))
    collided = F.raise_error(F.lit("two different texts share a 128-bit hash and a SHA-256"))
    groups = groups.select(*KEY, F.when(F.col("texts") == 1, F.col("n")).otherwise(collided.cast("long")).alias("n"), "keep")
    groups = stored(groups, "exact-groups")  # read back, the join deals both sides itself and AQE can split a large group
    rows = own.df.select("*", norm.alias("norm")).select(*own.df.columns, *content_keys(F.col("norm")))
    return own.back(
        rows.join(groups, KEY),
        keep_id=F.col("keep"),
        group_size=F.col("n"),
        kept=F.col(own.at("doc_id")).eqNullSafe(F.col("keep")),
        text_sha256=F.col("sha"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep="largest")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op6_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, count(*) AS n, max(doc_id) AS m FROM d GROUP BY t)
SELECT d.doc_id, g.m AS keep_id, g.n AS group_size, d.doc_id IS NOT DISTINCT FROM g.m AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
}
