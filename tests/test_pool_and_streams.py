import json

from pyspark.sql import functions as F

from rankfold.operators import pool as O
from rankfold.operators import vector as V
from rankfold.streaming import sync


def test_interleaving_keeps_first_places_and_closes_up(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "d", 2)], "query_idx long, doc_id string, r int")
    q = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "e", 1), (2, "b", 2)], "query_idx long, doc_id string, r int")
    lists = O.interleaved(t, q)
    assert [(r.doc_id, r.pos) for r in lists.filter("query_idx = 1").orderBy("pos").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert [r.doc_id for r in O.global_pool(lists).orderBy("pool_pos").collect()] == ["a", "b", "e", "c", "d"]


def test_writes(spark):
    s = "query_idx long, doc_id string, llm_score double"
    r = spark.createDataFrame([(1, "a", None), (1, "b", 0.0), (1, "c", 0.4)], s)
    assert O.unscored(r.select("query_idx", "doc_id"), r, zeros=True).count() == 2 and O.unscored(r.select("query_idx", "doc_id"), r, zeros=False).count() == 1
    new = spark.createDataFrame([(1, "a", 0.2, 1), (1, "a", 0.9, 2), (2, "x", 0.1, 1)], "query_idx long, doc_id string, new_score double, seq int")
    assert {x.doc_id: x.llm_score for x in O.update_scores(r, new).collect()} == {"a": 0.9, "b": 0.0, "c": 0.4}
    assert O.insert_ignore(r, spark.createDataFrame([(1, "a", 0.7), (1, "d", 0.1)], s)).count() == 4
    q = spark.createDataFrame([("r1", 1, ["c"], "succeeded"), ("r2", 1, ["b", "c"], "succeeded"), ("r3", 1, ["c"], "failed")], "custom_id string, query_idx long, doc_ids array<string>, status string")
    assert sorted(x.custom_id for x in O.retry_set(q, r).collect()) == ["r2", "r3"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0], [0.0, 0.0, 0.0])], "a array<float>, z array<float>")
    x = df.select(V.cosine(F.col("a"), F.col("z")).alias("c"), V.unit(F.col("a")).alias("u"), V.unit(F.col("z")).alias("z"), V.metric("L2")(F.col("a"), F.col("z")).alias("l")).first()
    assert (x.c, [round(v, 9) for v in x.u], x.z, x.l) == (0.0, [0.6, 0.8, 0.0], [0.0, 0.0, 0.0], 5.0)


def test_streams(spark, tmp_path, sf_dir):
    (tmp_path / "in").mkdir()
    line = lambda k, t: json.dumps({"custom_id": k, "response": {"body": {"text": t}}})
    (tmp_path / "in/a.jsonl").write_text("\n".join((line("1", "8"), line("1", "8"), line("2", "none"))))
    for _ in range(2):
        sync.merge_replies(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.custom_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1": 0.8, "2": 0.0}
    (tmp_path / "ev").mkdir()
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev/x"))
    stream = sync.windowed_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev/x")))
    q = stream.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from win").first()[0] == events.count()
