import json

import pytest
from pyspark.sql import functions as F

from rankfold.operators import sync as S

RESULTS = "query_idx long, doc_id string, llm_score double"
REQUESTS = "custom_id string, query_idx long, doc_ids array<string>, status string"


def run(spark, results, requests, lines, **how):
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)]
    return S.sync(spark.createDataFrame(results, RESULTS), spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(rows, "seq long, value string"), **how)


def scores(out):
    return {(r.query_idx, r.doc_id): r.llm_score for r in out.results.collect()}


def states(out):
    return {r.custom_id: r.status for r in out.requests.collect()}


def text(cid, t, key="custom_id"):
    return {key: cid, "response": {"body": {"text": t}}}


def test_states_and_scores(spark):
    results = [(1, "a", None), (1, "b", 0.3), (2, "a", 0.5), (2, "b", 0.6), (3, "a", None), (4, "a", None)]
    requests = [("x", 1, [" A", "b"], "submitted"), ("y", 2, ["a", "b"], "submitted"), ("z", 3, ["a"], "submitted"), ("w", 4, ["a"], "failed"), ("e", 5, [], "submitted"), ("n", 6, None, None)]
    lines = [text("x", "[7, 12]"), text("y", "[1, 1]", "key"), {"id": "z", "response": None}, text("e", "[1]"), text("unknown", "[1]"), "", "  ", "{not json", {"custom_id": "x"}, {"response": {}}, "[1]"]
    out = run(spark, results, requests, lines)
    assert scores(out) == {(1, "a"): 0.7, (1, "b"): 1.0, (2, "a"): 0.5, (2, "b"): 0.6, (3, "a"): 0.0, (4, "a"): None}
    assert states(out) == {"x": "succeeded", "y": "succeeded", "z": "missing", "w": "failed", "e": "missing", "n": None}
    assert out.counts.first().asDict() == {"lines": 9, "bad_lines": 4, "skipped": 1, "updated": 3}


def test_the_first_reply_stands_or_the_last(spark):
    results, requests = [(1, "a", None), (2, "a", None)], [("x", 1, ["a"], "submitted"), ("y", 2, ["a", "gone"], "submitted")]
    lines = [text("x", "[3]"), text("x", "[9]"), text("y", "[3, 3]"), text("y", "[4, 4]")]
    assert scores(run(spark, results, requests, lines)) == {(1, "a"): 0.3, (2, "a"): 0.4}
    again = run(spark, [(1, "a", 0.1), (2, "a", 0.1)], requests, lines, overwrite=True)
    assert scores(again) == {(1, "a"): 0.9, (2, "a"): 0.4}
    assert states(again) == {"x": "succeeded", "y": "succeeded"}


def test_a_reply_without_scores_makes_its_request_missing(spark):
    out = run(spark, [(1, "a", None)], [("x", 1, ["a"], "submitted")], [text("x", "none"), text("x", "[5]")])
    assert scores(out) == {(1, "a"): 0.0} and states(out) == {"x": "missing"}


def test_empty_tables(spark):
    out = run(spark, [], [], [])
    assert scores(out) == {} and states(out) == {} and out.counts.first().asDict() == {"lines": 0, "bad_lines": 0, "skipped": 0, "updated": 0}


def test_pilot_takes_the_first_document_and_overwrites(spark):
    results = spark.createDataFrame([(1, "a", 0.2), (2, "b", None)], RESULTS)
    requests = spark.createDataFrame([("x", 1, ["A", "z"], None), ("y", 2, ["b"], None), ("e", 3, [], None)], REQUESTS)
    lines = [json.dumps(x) for x in (text("x", "[6, 1]"), text("y", "so 4 it is"), text("e", "[1]"), {"response": {}})]
    table = lambda rows: spark.createDataFrame(list(enumerate(rows)), "seq long, value string")
    assert {r.doc_id: r.llm_score for r in S.sync_pilot(results, requests, table(lines)).collect()} == {"a": 0.6, "b": 0.4}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        S.sync_pilot(results, requests, table(["{no"])).collect()


def test_pilot_scores(spark):
    texts = ["[7, \"x\", 12]", "first [1] then [2]", "3 and 10 and 11", "", None, "[]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.s for r in rows.orderBy("i").select(S.pilot_scores(F.col("t"), 3).alias("s")).collect()] == [[7, 0, 10], [1, 0, 0], [3, 10, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_retry_lines(spark):
    again = spark.createDataFrame([("x",), ("y",)], "custom_id string")
    lines, none = S.retry_requests(again, spark.createDataFrame([("x", "1"), ("x", "1"), ("q", "2")], "custom_id string, json string"))
    assert [tuple(r) for r in lines.collect()] == [("x", "1")] and [r.custom_id for r in none.collect()] == ["y"]
