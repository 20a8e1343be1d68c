import json

from pyspark.sql import functions as F

from rankfold.functions import answers as A


def one(spark, rows, schema, column):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column.alias("x")).collect()]


def test_ids_and_prompts(spark):
    assert one(spark, [("12",), (" 7 ",), ("-3",), ("1.5",), ("a1",), ("",), (None,)], "t string", A.id_int(F.col("t"))) == [12, 7, -3, None, None, None, None]
    rows = [("q?", "ctx"), ("q?", "  "), ("q?", None)]
    assert one(spark, rows, "q string, c string", A.prompt(F.col("q"), F.col("c"))) == ["Context:\nctx\n\nQuestion: q?\nAnswer:", *["Question: q?\nAnswer:"] * 2]


def test_contexts_at_any_depth(spark):
    deep = {"contexts": [" a ", {"x": ["b", {"y": 3}], "z": None}, "", 1.5]}
    texts = [json.dumps(deep), json.dumps({"context": "c"}), json.dumps({"contexts": []}), json.dumps([1]), "raw " * 3000, "", None]
    got = one(spark, [(t,) for t in texts], "t string", A.contexts(F.col("t")))
    assert got == ["a\n\nb\n\n3\n\n1.5", "c", '{"contexts": []}', "[1]", ("raw " * 3000).strip()[:8000], "", ""]


def test_answers_of_every_kind(spark):
    rows = [
        ("Question: q Answer: yes Question: z Answer: no", "q"), ('Answer: "quoted part" more', "q"), ("what is it? It is red. And so on", "what is it?"),
        ('say "what" or "blue"', "What now"), ("x" * 200, "q"), ("", "q"), (None, None),
    ]
    got = one(spark, rows, "o string, q string", A.answer(F.col("o"), F.col("q")))
    assert got == ["yes", "quoted part", "It is red", "blue", "x" * 100, "No answer generated", "No answer generated"]


def test_best_answer_takes_the_first_of_equals_and_no_blanks(spark):
    rows = [(1, "a b", 0, " "), (1, "a b", 1, "b"), (1, "a b", 2, "a"), (2, "a", 0, None)]
    got = {r.q: tuple(r)[1:] for r in A.best_answer(spark.createDataFrame(rows, "q int, question string, place int, answer string")).collect()}
    assert got == {1: (1, "b", 0.5, 3), 2: (None, None, None, 1)}


def test_lookup_prefers_the_own_id_then_the_keys_in_order(spark):
    corpus = spark.createDataFrame([(1, {"PMID": "x"}), (2, {"pubid": " X"}), (3, {"doc_id": "1"}), (4, None)], "d long, meta map<string,string>")
    asked = spark.createDataFrame([(10, "x"), (11, "1"), (12, "none"), (13, None), (14, "")], "q long, id string")
    assert {tuple(r) for r in A.found_by_id(asked, corpus).collect()} == {(10, 2, "pubid"), (11, 1, "own id")}


def test_relevance_prompt_caps_and_numbers_documents(spark):
    rows = spark.createDataFrame([("q?", ["a" * 5000, None, "c"]), (None, [])], "q string, ds array<string>")
    first, none = (r[0] for r in rows.select(A.relevance_prompt(F.col("q"), F.col("ds"))).collect())
    assert "with 3 whole numbers" in first and "QUERY:\nq?\n" in first and "--- ITEM 2 ---\n\n" in first and first.count("a" * 4000) == 1 and "a" * 4001 not in first and first.endswith("--- ITEM 3 ---\nc\n")
    assert "with 0 whole numbers" in none and "ITEM" not in none


def test_an_answer_ends_where_the_next_question_starts(spark):
    rows = spark.createDataFrame([('Answer: foo" Question',), ('Answer: foo bar" Q',), ("Answer: Question",)], "o string")
    assert [r[0] for r in rows.select(A.answer(F.col("o"), F.lit("x"))).collect()] == ["foo", "foo bar", "Question"]
