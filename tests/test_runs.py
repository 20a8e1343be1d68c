import pytest
from pyspark.sql import functions as F

from rankfold.operators import runs as R


@pytest.fixture
def run(spark):
    truths = spark.createDataFrame([(1, "p3"), (2, "t2")], "query_idx long, doc_id string")
    pool = spark.createDataFrame([(f"p{i}", i) for i in range(1, 12)], "doc_id string, pool_pos long")
    return truths, pool


def score(pairs):
    return pairs.withColumn("llm_score", F.col("query_idx") / 10 + F.length("doc_id"))


def test_stages_are_blocks_of_the_pool_and_the_truths_first(run, spark):
    seen = spark.createDataFrame([(1, "p2")], "query_idx long, doc_id string")
    got = {tuple(r) for r in R.stage_pairs(*run, seen, 1, 2).collect()}
    assert got == {(q, d) for q in (1, 2) for d in ("p1", "p2", "p3", "p4", "t2")} - {(1, "p2")}
    assert {r.doc_id for r in R.stage_pairs(*run, seen, 3, 2).collect()} == {"p9", "p10", "p11"}
    assert {r.query_idx for r in R.stage_pairs(*run, seen, 2, 2, spark.createDataFrame([(1,)], "query_idx long")).collect()} == {2}
    assert R.last_stage(*run, 2) == 3


def test_a_run_that_stopped_goes_on_and_equals_one_of_one_go(run, spark, tmp_path):
    once = sorted(tuple(r) for r in R.run_stages(spark, str(tmp_path / "a"), *run, score, 2).collect())
    calls = []

    def failing(pairs):
        calls.append(1)
        if len(calls) == 2:
            return score(pairs).withColumn("llm_score", F.raise_error(F.lit("lost")).cast("double"))
        return score(pairs)

    with pytest.raises(Exception, match="lost"):
        R.run_stages(spark, str(tmp_path / "b"), *run, failing, 2)
    assert {r.stage for r in R.scored_stages(spark, str(tmp_path / "b")).collect()} == {1}
    R.run_stages(spark, str(tmp_path / "b"), *run, score, 2, most=1)
    again = sorted(tuple(r) for r in R.run_stages(spark, str(tmp_path / "b"), *run, score, 2).collect())
    assert again == once and len(once) == 2 * 12
    assert len(R.run_stages(spark, str(tmp_path / "c"), *run, score, 100).collect()) == len(once)


def test_completion_and_resuming(spark):
    results, skipped = spark.createDataFrame([(1,), (1,), (2,)], "query_idx long"), spark.createDataFrame([(3,)], "query_idx long")
    assert R.is_complete(results, skipped, 3, {"main_loop_completed": "yes"})
    assert not R.is_complete(results, skipped, 4, {"main_loop_completed": "1"}) and not R.is_complete(results, skipped, 3, {})
    new = {"k": 5, "num_queries_requested": 9, "actual_num_queries": 8, "global_pool_size": 3, "model": "m"}
    assert R.can_resume(new, new) and R.can_resume({"k": 5, "num_queries": 9, "model": "m"}, new)
    assert not any(R.can_resume({**new, k: v}, new) for k, v in (("k", 4), ("model", None), ("global_pool_size", 4), ("actual_num_queries", 7), ("num_queries_requested", None)))


def test_bookkeeping(spark):
    meta = spark.createDataFrame([("chunk_1_job_id", "j"), ("chunk_1_upload_part_2_job_id", "j"), ("chunk_2_error", "e"), ("main_loop_completed", "1")], "key string, value string")
    requests = spark.createDataFrame([("a",), ("a",), ("b",)], "custom_id string")
    assert tuple(R.pipeline_summary(meta, requests).first()) == (True, 1, 1, 2)
    assert tuple(R.pipeline_summary(meta.limit(0), requests.limit(0)).first()) == (False, 0, 0, 0)
    assert tuple(R.job_states(spark.createDataFrame([("JOB_STATE_SUCCEEDED",), ("running",), (None,)], "state string")).first()) == (1, 1, 0, 0)
    done = {"main_loop_completed": "true"}
    assert [R.phase({}, False, 0, 0, 0), R.phase({}, False, 1, 5, 0, running=1), R.phase({}, False, 1, 5, 0), R.phase(done, False, 1, 5, 4), R.phase(done, False, 1, 5, 5)] == ["retrieval", "active", "waiting", "sync", "complete"]
    assert [R.phase({"fatal_llm_error": "x"}, True, 0, 0, 0), R.phase({}, True, 0, 1, 0), R.phase(done, True, 0, 1, 0), R.phase(done, True, 0, 1, 1)] == ["fatal", "live", "live_sync", "complete"]


def test_chunks_and_progress(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 8)], "query_idx long")
    requests = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (4, "d"), (7, "e")], "query_idx long, custom_id string")
    meta = spark.createDataFrame([("chunk_0001_job_id", "j"), ("chunk_0003_job_id", "j"), ("chunk_0003_error", "e")], "key string, value string")
    got = R.chunk_states(q, requests, spark.createDataFrame([(3,)], "query_idx long"), meta, 3).orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(1, 3, True, True, True), (2, 3, False, False, False), (3, 1, True, True, True)]
    results = spark.createDataFrame([(0.5, 1), (None, 2), (0.0, 2)], "llm_score double, stage int")
    assert tuple(R.staged_progress(results, 4, 2, 3).first()) == (2, 3, 12, 3, 2, 1, round(2 * 100 / 12, 6))
    assert tuple(R.staged_progress(results.limit(0), 0, 0, 0).first()) == (0, 0, 0, 0, 0, 0, 0.0)
