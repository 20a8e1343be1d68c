"""Staged runs: what a stage scores, the loop that can be resumed, completion, and a run's bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.sources.readers import is_true


def stage_pairs(truths: DataFrame, pool: DataFrame, seen: DataFrame, stage: int, stride: int, skip: DataFrame | None = None) -> DataFrame:
    """(query_idx, doc_id): every query with every document new in ``stage``, without the pairs that were seen.

    ``truths`` (query_idx, doc_id) has a row a query, ``pool`` (doc_id, pool_pos) the ranked pool. A stage takes
    stride * queries of the pool, and stage 1 all truths besides. ``skip`` (query_idx) leaves queries out; they
    count in the size of a stage. The product is what a stage is: queries are a stated set, of any size here.
    """
    size = stride * truths.select("query_idx").distinct().count()
    new = pool.filter(F.col("pool_pos").between(size * (stage - 1) + 1, size * stage)).select("doc_id")
    if stage == 1:
        new = new.unionByName(truths.select("doc_id"))
    new = new.filter("doc_id <> ''").distinct()
    queries = truths.select("query_idx").distinct()
    if skip is not None:
        queries = queries.join(skip, "query_idx", "left_anti")
    return new.crossJoin(queries).select("query_idx", "doc_id").join(seen.select("query_idx", "doc_id"), ["query_idx", "doc_id"], "left_anti")


def last_stage(truths: DataFrame, pool: DataFrame, stride: int) -> int:
    size = stride * truths.select("query_idx").distinct().count()
    return max(1, -(-pool.count() // size)) if size else 0


_PAIRS = "query_idx long, doc_id string, llm_score double, stage int"


def scored_stages(spark: SparkSession, folder: str) -> DataFrame:
    """All that a run has stored; none before its first stage."""
    try:
        return spark.read.schema(_PAIRS).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PAIRS)


def run_stages(spark: SparkSession, folder: str, truths: DataFrame, pool: DataFrame, score: Callable[[DataFrame], DataFrame], stride: int, skip: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Score stage by stage into ``folder``/stage=n; ``score`` maps (query_idx, doc_id) to (query_idx, doc_id, llm_score).

    A stage is stored whole or not at all (its folder has a _SUCCESS mark), so a run that stopped goes on with the
    first stage that isn't; ``most`` stages in this call. ``folder`` must be one that all executors reach.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [n for n in range(1, last_stage(truths, pool, stride) + 1) if not files.exists(path(f"{folder}/stage={n}/_SUCCESS"))]
    for n in todo[:most]:
        done = scored_stages(spark, folder).filter(F.col("stage") < n)
        pairs = stage_pairs(truths, pool, done, n, stride, skip)
        score(pairs).select("query_idx", "doc_id", "llm_score").write.mode("overwrite").parquet(f"{folder}/stage={n}")
    return scored_stages(spark, folder)


def is_complete(results: DataFrame, skipped: DataFrame, n_queries: int, meta: dict[str, str]) -> bool:
    """The loop is done, and the queries with results and the skipped ones are as many as there are."""
    return is_true(meta.get("main_loop_completed")) and results.select("query_idx").distinct().count() + skipped.count() >= n_queries


def can_resume(old: dict, new: dict) -> bool:
    """Same k, model and number of queries asked for; actual queries and pool size too where the old run tells them."""
    asked = old.get("num_queries_requested")
    asked = old.get("num_queries") if asked is None else asked
    told = all(old.get(k) is None or int(old[k]) == new[k] for k in ("actual_num_queries", "global_pool_size"))
    same = old.get("k") == new["k"] and old.get("model") == new.get("model")
    return same and told and (None if asked is None else int(asked)) == new["num_queries_requested"]


def pipeline_summary(meta: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: loop_done, chunks_with_jobs, chunks_with_errors, n_requests, of (key, value) and requests."""
    chunk = F.col("key").startswith("chunk_")
    jobs = chunk & F.col("key").endswith("_job_id") & ~F.col("key").contains("upload_part")
    done = (F.col("key") == "main_loop_completed") & F.col("value").isin("1", "true", "yes")
    told = meta.agg(F.coalesce(F.bool_or(done), F.lit(False)).alias("loop_done"), F.count_if(jobs).alias("chunks_with_jobs"), F.count_if(chunk & F.col("key").endswith("_error")).alias("chunks_with_errors"))
    return told.crossJoin(requests.agg(F.countDistinct("custom_id").alias("n_requests")))  # two single rows


def chunk_states(queries: DataFrame, requests: DataFrame, skipped: DataFrame, meta: DataFrame, size: int = 25) -> DataFrame:
    """(chunk, n_queries, recorded, has_job, submitted) of queries (query_idx) from 1 on, in chunks of ``size``.

    A chunk is recorded if each of its queries has a request or was skipped, and submitted if it has a job too,
    under chunk_0001_job_id and so on in ``meta`` (key, value).
    """
    number = (F.floor((F.col("query_idx") - 1) / size) + 1).cast("long")
    known = requests.select("query_idx").unionByName(skipped.select("query_idx")).distinct().withColumn("known", F.lit(True))
    rows = queries.select("query_idx").distinct().join(known, "query_idx", "left")
    chunks = rows.groupBy(number.alias("chunk")).agg(F.count("*").alias("n_queries"), (F.count("known") == F.count("*")).alias("recorded"))
    jobs = meta.select("key").distinct().withColumn("has_job", F.lit(True))
    out = chunks.withColumn("key", F.format_string("chunk_%04d_job_id", "chunk")).join(jobs, "key", "left")
    has = F.coalesce("has_job", F.lit(False))
    return out.select("chunk", "n_queries", "recorded", has.alias("has_job"), (F.col("recorded") & has).alias("submitted"))


def staged_progress(results: DataFrame, pool_size: int, n_queries: int, stages: int) -> DataFrame:
    """One row: stages_done, stages, expected_pairs, stored, scored, blocked, pct_scored of a staged run's (llm_score, stage).

    A run expects every query with the pool and all truths: (pool + queries) * queries pairs at most, fewer if
    truths stand in the pool.
    """
    expected = (pool_size + n_queries) * n_queries
    s = F.col("llm_score")
    row = results.agg(F.coalesce(F.max("stage"), F.lit(0)).cast("long").alias("stages_done"), F.count("*").alias("stored"), F.count(s).alias("scored"), F.count_if(s == 0).alias("blocked"))
    pct = F.round(F.col("scored") * 100.0 / F.lit(expected), 6) if expected else F.lit(0.0)
    return row.select("stages_done", F.lit(stages).cast("long").alias("stages"), F.lit(expected).cast("long").alias("expected_pairs"), "stored", "scored", "blocked", pct.alias("pct_scored"))


def job_states(jobs: DataFrame) -> DataFrame:
    """One row of counts of (state): a state counts where its name stands anywhere in the text."""
    names = ("SUCCEEDED", "RUNNING", "PENDING", "FAILED")
    return jobs.agg(*(F.count_if(F.upper("state").contains(n)).alias(n.lower()) for n in names))


def phase(meta: dict[str, str], live: bool, n_requests: int, n_rows: int, n_synced: int, running: int = 0, pending: int = 0) -> str:
    """What a run is doing: fatal, live, live_sync, retrieval, active, waiting, sync or complete."""
    if meta.get("fatal_llm_error"):
        return "fatal"
    done, open_ = is_true(meta.get("main_loop_completed")), n_synced < n_rows
    if live:
        return "live" if not done else "live_sync" if open_ else "complete"
    if not done:
        return "retrieval" if n_requests == 0 else "active" if running or pending else "waiting"
    return "sync" if open_ else "complete"
