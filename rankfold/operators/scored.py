"""The fact table of scored pairs, made from the embeddings: a deterministic stand-in for an external scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.operators.vector import block_cosine, query_matrix
from rankfold.storing import stored

N_QUERIES = 50
_kept: dict[tuple[str, str], DataFrame] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.filter(F.col("vec_id") >= N_QUERIES).select(F.col("vec_id").alias("d"), "embedding", "label")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the first vectors, of a fixed number."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.filter(F.col("vec_id") < N_QUERIES).select(F.col("vec_id").alias("q"), "embedding", "label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results(query_idx, doc_id, llm_score, dist_to_gt, is_gt, rag_failed), one row for each pair; written once a folder and session.

    Three passes over the corpus: the best row of each query, the best one of its label, then both similarities of
    a pair from one block. Two rows a task and query are shuffled, and no pair.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _kept:
        return _kept[key]
    docs, queries = corpus(spark, sf_dir), query_set(spark, sf_dir)
    labels = [r["label"] for r in queries.orderBy("q").collect()]  # N_QUERIES rows
    keys, m = query_matrix(queries, "q", "embedding")
    first = F.max(F.struct(F.round("s1", 6).alias("s"), (-F.col("d")).alias("d")))
    found = [block_cosine(docs, keys, m, top=1, alike=a).groupBy("q").agg(first.alias("x")).orderBy("q").collect() for a in (("label", labels), None)]
    truths, nearest = ({r["q"]: -r["x"]["d"] for r in rows} for rows in found)
    best = [(q, g, nearest[q]) for q, g in truths.items()]  # N_QUERIES rows at most
    by_query = F.broadcast(spark.createDataFrame(best, "q long, g long, t long").join(queries.select("q", F.col("label").alias("ql")), "q"))
    asked = queries.join(F.broadcast(by_query.select("q")), "q")
    truth = by_query.select("q", F.col("g").alias("d")).join(docs, "d")
    keys, m = query_matrix(asked, "q", "embedding")
    keys, m_truth = query_matrix(truth, "q", "embedding")
    level = 1 + F.floor((20 + 4 * (F.col("q") % 4)) * F.greatest(F.lit(0.0), "s")) + F.when(F.col("label") == F.col("ql"), 3).otherwise(0)
    pairs = block_cosine(docs, keys, m, m_truth, carry="label").join(by_query, "q").withColumn("s", F.round("s1", 6))
    out = pairs.select(
        (F.col("q") + 1).alias("query_idx"),
        F.col("d").cast("string").alias("doc_id"),
        (F.greatest(F.lit(1), F.least(F.lit(10), level)).cast("double") / 10.0).alias("llm_score"),
        (F.round(1 - F.col("s2"), 6) + 0.0).alias("dist_to_gt"),
        (F.col("d") == F.col("g")).cast("int").alias("is_gt"),
        (F.col("t") != F.col("g")).cast("int").alias("rag_failed"),
    )
    _kept[key] = stored(out, "facts")
    return _kept[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table as while a run goes on: some scores are pending (null), some blocked (0)."""
    m = (F.col("query_idx") * 31 + F.col("doc_id").cast("long")) % 50
    score = F.when(m == 0, None).when(m == 1, 0.0).otherwise(F.col("llm_score"))
    return scored(spark, sf_dir).withColumn("llm_score", score)


#: the same tables for DuckDB
SCORED_SQL = f"""
WITH qv AS (SELECT vec_id AS q, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < {N_QUERIES}),
dv AS (SELECT vec_id AS d, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id >= {N_QUERIES}),
sim AS (SELECT q, d, qv.label = dv.label AS same, round(greatest(-1, least(1, list_cosine_similarity(qv.e, dv.e))), 6) AS s FROM qv, dv),
gt AS (SELECT q, d AS g FROM sim WHERE same QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) = 1),
tp AS (SELECT q, d AS t FROM sim QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) = 1),
results AS (SELECT sim.q + 1 AS query_idx, CAST(sim.d AS VARCHAR) AS doc_id,
  greatest(1, least(10, 1 + floor((20 + 4 * (sim.q % 4)) * greatest(0, s)) + CASE WHEN same THEN 3 ELSE 0 END))::DOUBLE / 10.0::DOUBLE AS llm_score,
  round(1 - greatest(-1, least(1, list_cosine_similarity(x.e, y.e))), 6) + 0.0 AS dist_to_gt,
  CASE WHEN sim.d = g THEN 1 ELSE 0 END AS is_gt, CASE WHEN t <> g THEN 1 ELSE 0 END AS rag_failed
  FROM sim JOIN gt ON sim.q = gt.q JOIN tp ON sim.q = tp.q JOIN dv x ON x.d = sim.d JOIN dv y ON y.d = g),
raw AS (SELECT * REPLACE (CASE WHEN (query_idx * 31 + doc_id::BIGINT) % 50 = 0 THEN NULL
  WHEN (query_idx * 31 + doc_id::BIGINT) % 50 = 1 THEN 0.0 ELSE llm_score END AS llm_score) FROM results),
truth AS (SELECT query_idx, min(doc_id) AS gt_doc, arg_min(llm_score, doc_id) AS gt_score, arg_min(dist_to_gt, doc_id) AS gt_dist,
  max(rag_failed) AS rag_failed FROM results WHERE is_gt = 1 GROUP BY query_idx)"""
