import json

import pytest
from pyspark.sql import functions as F

from rankfold.functions import parsing as P
from rankfold.sources.readers import is_true, parse_source, read_questions, read_replies, text_column


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("[8,2,10]", [8, 2, 10]), ('{"scores":[1,2]}', [1, 2, 0]), ("Here: [3, 4] ok", [3, 4, 0]), ("score 7", [7, 0, 0]), ("", [0, 0, 0]), ("[11,-1]", [10, 0, 0]), ('["a", 5]', [5, 0, 0])],
)
def test_parse_scores(spark, text, want):
    assert one(spark, text, lambda t: P.parse_scores(t, 3)) == want


def test_single_scores(spark):
    assert [one(spark, t, P.single_score) for t in ("it is 10", "7/10", "none", "42")] == [1.0, 0.7, 0.0, 0.0]


def test_responses(spark):
    shapes = [{"text": "a"}, {"choices": [{"message": {"content": "b"}}]}, {"candidates": [{"content": {"parts": [{"text": "c"}, {"text": "d"}]}}]}, {}]
    assert [one(spark, json.dumps({"response": {"body": b}}), P.response_text) for b in shapes] == ["a", "b", "c\nd", ""]
    assert one(spark, json.dumps({"response": {"body": {"candidates": [{"finish_reason": "safety"}]}}}), P.blocked)


def test_verdicts(spark):
    df = spark.createDataFrame([(0.8, 0.9), (0.85, 0.8505), (0.9, 0.8)], "a double, b double")
    assert [r.v for r in df.select(P.verdict(F.col("a"), F.col("b")).alias("v")).collect()] == ["Optimized", "Tie", "Original"]
    votes = [F.lit(v) for v in ("Optimized", "Original", "Optimized")]
    agreed, share = P.consensus(votes)
    assert tuple(df.select(agreed, share).first()) == ("Optimized", pytest.approx(2 / 3))


def test_ids_and_text(spark):
    assert one(spark, '{"pid": " A1 ", "id": "b"}', P.truth_id) == "a1" and one(spark, "{}", P.truth_id) == ""
    assert one(spark, " Hello,  World! ", P.norm_text) == "hello world"
    assert one(spark, "x" * 501, P.truncated) == "x" * 500 + P.SUFFIX
    assert one(spark, "Optimized is better", P.judge_text) == "Optimized"


def test_sources(spark, tmp_path):
    assert parse_source("wikipedia:20220301.en") == ("hf", "wikipedia_20220301.en") and parse_source("https://example.com/corpus.txt") == ("url", "corpus.txt")
    assert text_column(["PMID", "Abstract_en"], True) == "Abstract_en" and is_true(" Yes ") and not is_true(None)
    with pytest.raises(ValueError):
        text_column(["PMID", "Abstract_en"], False)
    (tmp_path / "q.json").write_text('{"question": "a"}\nbroken\n{"question": "b"}\n')
    assert [r.question for r in read_questions(spark, str(tmp_path / "q.json"), 2).collect()] == ["a"]
    (tmp_path / "r.jsonl").write_text('{"key": "k1"}\n\n{"id": "k2"}\nbad\n')
    assert sorted(r.custom_id for r in read_replies(spark, str(tmp_path / "r.jsonl")).collect()) == ["k1", "k2"]


def test_replies_of_every_shape(spark):
    rows = [
        ('{"response": {"body": {"text": "a"}}}', "a", False),
        ('{"response": {"text": "b"}}', "b", False),
        ('{"response": {"body": {"choices": [{"message": {"content": "c"}}, {"message": {"content": "x"}}]}}}', "c", False),
        ('{"response": {"candidates": [{"content": {"parts": [{"text": "d"}, {"n": 1}]}}, {}, {"content": {"parts": [{"text": "e"}]}, "finish_reason": "STOP"}]}}', "d\ne", False),
        ('{"response": {"candidates": [{"finish_reason": "STOP"}, {"finish_reason": "blocklist"}]}}', None, True),
        ('{"response": {"prompt_feedback": {"block_reason": "BLOCK_REASON_UNSPECIFIED"}}}', None, False),
        ('{"response": {"body": {"prompt_feedback": {"block_reason": "OTHER"}}}}', None, True),
        ('{"custom_id": "q"}', None, True),
        ("no json", None, True),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "j string")
    got = df.select(P.reply_text(F.col("j")), P.blocked(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_elements_of_a_list_count_by_their_own_type(spark):
    texts = ['["7.9", 5, 3]', "[true, 2]", '[" 7 ", 3.9, null, [1], {"a": 1}, 1e1]', '{"scores": [false, "x", 8]}', '["a"]', "[]", "[-3, 99, 4", "words [2, 3] more", '"[4]"']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.s for r in rows.select("i", P.parse_scores(F.col("t"), 3).alias("s")).orderBy("i").collect()]
    assert got == [[5, 3, 0], [1, 2, 0], [7, 3, 10], [0, 8, 0], [0, 0, 0], [0, 0, 0], [3, 4, 0], [2, 3, 0], [4, 0, 0]]


def test_local_paths_are_what_the_caller_lists(spark):
    rows = spark.createDataFrame([("./docs",), ("./other",), ("https://a.b/c",), ("https://a.b",), ("name",), ("a:b",)], "s string")
    assert [r[0] for r in rows.select(P.source_type(F.col("s"), ["./docs", "https://a.b"])).collect()] == ["local_path", "invalid", "url", "invalid", "huggingface_dataset", "huggingface_dataset_with_config"]
