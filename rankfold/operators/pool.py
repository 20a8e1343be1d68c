"""Candidate pools: neighbours, interleaving with first occurrence, stages, request batches, resume sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.ordered import places


def first_ranked(rows: DataFrame, by: str, order: list, most: int, name: str = "r") -> DataFrame:
    """The first ``most`` rows of each group, numbered; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= most)


def interleaved(near_truth: DataFrame, near_query: DataFrame) -> DataFrame:
    """(query_idx, doc_id, pos): gt1, q1, gt2, q2, ... of two ranked lists (query_idx, doc_id, r); a document keeps its first place and places close up."""
    raw = near_truth.select("query_idx", "doc_id", (2 * (F.col("r") - 1)).alias("o")).unionAll(near_query.select("query_idx", "doc_id", (2 * (F.col("r") - 1) + 1).alias("o")))
    first = raw.groupBy("query_idx", "doc_id").agg(F.min("o").alias("o"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_idx").orderBy("o"))).drop("o")


def global_pool(lists: DataFrame) -> DataFrame:
    """(doc_id, pool_pos): all queries' lists by place, then query; each document at its first.

    Places are unique by (pos, query_idx), as each is one document's; the whole order is cut by ranges, so that
    no task numbers all documents.
    """
    first = lists.groupBy("doc_id").agg(F.min(F.struct("pos", "query_idx")).alias("f")).select("doc_id", "f.pos", "f.query_idx")
    return places(first, [], ["pos", "query_idx"], "pool_pos").select("doc_id", "pool_pos")


def stage(pool_pos: Column, stride: int, n_queries: int) -> Column:
    return (F.floor((pool_pos - 1) / (stride * n_queries)) + 1).cast("long")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds batch: documents of a query by doc_id, ``size`` a request."""
    n = F.row_number().over(Window.partitionBy("query_idx").orderBy("doc_id"))
    return rows.withColumn("batch", (F.floor((n - 1) / size) + 1).cast("long"))


def unscored(pairs: DataFrame, results: DataFrame, zeros: bool) -> DataFrame:
    """Pairs that still need a score: missing, pending, or with ``zeros`` also 0."""
    done = F.col("llm_score").isNotNull() & ((F.col("llm_score") != 0) if zeros else F.lit(True))
    return pairs.join(results.filter(done).select("query_idx", "doc_id"), ["query_idx", "doc_id"], "left_anti")


def insert_ignore(results: DataFrame, rows: DataFrame) -> DataFrame:
    """First write wins."""
    keys = ["query_idx", "doc_id"]
    return results.unionByName(rows.dropDuplicates(keys).join(results, keys, "left_anti"), allowMissingColumns=True)


def update_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Last write wins: ``scores`` (query_idx, doc_id, new_score, seq) over ``results``; keys not there are not added."""
    last = scores.groupBy("query_idx", "doc_id").agg(F.max_by("new_score", "seq").alias("new_score"))
    return results.join(last, ["query_idx", "doc_id"], "left").withColumn("llm_score", F.coalesce("new_score", "llm_score")).drop("new_score")


def upsert(table: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    both = table.select(key, value, F.lit(0).alias("seq")).unionAll(rows.select(key, value, F.lit(1).alias("seq")))
    return both.groupBy(key).agg(F.max_by(value, "seq").alias(value))


def retry_set(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests (custom_id, query_idx, doc_ids, status) to send again: by status, or as any document has no score or 0."""
    docs = requests.select("custom_id", "query_idx", "status", F.explode_outer("doc_ids").alias("doc_id"))
    got = docs.join(results.select("query_idx", "doc_id", "llm_score"), ["query_idx", "doc_id"], "left")
    open_ = F.coalesce(F.col("status"), F.lit("missing")).isin("missing", "failed", "pending") | F.col("llm_score").isNull() | (F.col("llm_score") == 0)
    return got.groupBy("custom_id").agg(F.bool_or(open_).alias("again")).filter("again").select("custom_id")


def spec_fingerprint(*parts) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *(F.lit(str(p)) for p in parts)), 256), F.lit(16))
