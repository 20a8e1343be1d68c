"""The vector store: loads that fail and go on, look-ups, and the index's recall over every row of the stated set."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold import storing
from rankfold.functions.vectorise import HashedWords, hashed_words, with_vectors
from rankfold.operators import vector as V
from rankfold.operators.store import VectorStore


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), "text", "lang")


def embed(rows):
    return with_vectors(rows, hashed_words(16))


def content(store):
    return sorted((r.d, r.text, r.lang, tuple(r.embedding or ())) for r in store.rows().collect())


def test_a_load_that_failed_goes_on_and_equals_one_of_one_go(spark, tmp_path, docs):
    once = VectorStore(spark, str(tmp_path / "once"))
    assert len(once.add(docs, "a", embed, size=30).done) == 7
    cut, calls = VectorStore(spark, str(tmp_path / "cut")), []

    def failing(rows):
        calls.append(1)
        if len(calls) in (2, 5):
            return embed(rows).withColumn("lang", F.raise_error(F.lit("no model")).cast("string"))
        return embed(rows)

    load = cut.add(docs, "a", failing, size=30, stop=False)
    assert len(load.failed) == 2 and len(load.done) == 5 and all("no model" in e or "USER_RAISED" in e for e in load.failed.values())
    assert cut.rows().count() < docs.count()  # what failed isn't there
    again = cut.add(docs.limit(3), "a", embed, size=1)  # the first call's rows and batches count
    assert sorted(again.done) == sorted(load.failed) and sorted(again.skipped) == sorted(load.done)
    assert content(cut) == content(once) and not storing.exists(spark, f"{cut.folder}/staged/a")
    with pytest.raises(Exception, match="no model"):
        VectorStore(spark, str(tmp_path / "stop")).add(docs, "a", lambda rows: rows.withColumn("lang", F.raise_error(F.lit("no model")).cast("string")))


def test_first_load_of_an_id_stands_and_torn_batches_are_not_seen(spark, tmp_path, docs):
    store = VectorStore(spark, str(tmp_path / "s"))
    assert not store.exists()
    with pytest.raises(ValueError):
        store.rows()
    store.add(docs.filter("d < 50").unionByName(docs.filter("d < 5")).unionByName(docs.limit(1).withColumn("d", F.lit(None).cast("long"))), "a", embed, size=20)
    store.add(docs.filter("d between 40 and 60").withColumn("text", F.lit("new")), "b", embed)
    got = {r.d: r for r in store.rows().collect()}
    assert len(got) == store.rows().count() == 61 and got[45].text != "new" and got[55].text == "new"
    embed(docs.filter("d = 199")).write.parquet(f"{store.folder}/data/torn")
    storing.remove(spark, f"{store.folder}/data/torn/_SUCCESS")
    assert store.rows().filter("d = 199").count() == 0
    s = store.statistics().first()
    assert (s.n_rows, s.n_vectors, s.width, s.n_batches) == (61, 61, 16, len(store.batches()))
    assert sorted(r.d for r in store.fetch(spark.createDataFrame([(3,), (3,), (55,), (150,)], "d long")).collect()) == [3, 55]


def test_an_empty_load(spark, tmp_path, docs):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.add(docs.limit(0), "a", embed)
    assert store.rows().count() == 0 and store.add(docs, "b", embed).failed == {} and store.rows().count() == docs.count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_index(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("d"), F.lit("t").alias("text"), "embedding")
    queries = rows.filter("d % 50 = 0").select(F.col("d").alias("q"), "embedding")
    store = VectorStore(spark, str(tmp_path / "s"))
    store.add(rows, "a", size=700)
    index = store.build_index(tries=100)
    assert index == store.index() and index["rows"] == rows.count()
    exact, found = ({(r.q, r.d) for r in f(queries, 10).collect()} for f in (store.search, store.search_index))
    assert len(exact & found) / len(exact) >= 0.9
    if index["probes"] < index["cells"]:
        assert store.products(queries) < rows.count() * queries.count() / 2
    assert {(r.q, r.d, r.similarity, r.rank) for r in V.top_k(rows, queries, 3).collect()} == {(r.q, r.d, r.similarity, r.rank) for r in store.search_index(queries, 3, probes=index["cells"]).collect()}


def test_clusters_are_found_by_few_probes_and_later_rows_exactly(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    points = (centres[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 24))).astype(np.float32)
    points[:1000] = points[0]  # a third of all rows are one vector
    rows = spark.createDataFrame([(i, "t", p.tolist()) for i, p in enumerate(points)] + [(9000, "zero", [0.0] * 24)], "d long, text string, embedding array<float>")
    store = VectorStore(spark, str(tmp_path / "s"))
    store.add(rows, "a")
    index = store.build_index(cells=30, tries=60)
    assert index["probes"] <= 8 and index["recall"] >= 0.95
    new = spark.createDataFrame([(7000 + i, "t", (points[1500 + i] * 2).tolist()) for i in range(40)], "d long, text string, embedding array<float>")
    store.add(new, "b")
    queries = rows.filter("d % 50 = 0").select(F.col("d").alias("q"), "embedding").unionByName(new.select((F.col("d") + 1000).alias("q"), "embedding"))
    exact, found = ({(r.q, r.d) for r in f(queries, 10).collect()} for f in (store.search, store.search_index))
    assert len(exact & found) / len(exact) >= 0.9 and any(d >= 7000 for _, d in found)


def test_models(spark):
    m = HashedWords(8)
    x = m(["One two two", "", "one TWO two"])
    assert np.allclose(x[0], x[2]) and not x[1].any() and np.isclose(np.linalg.norm(x[0]), 1)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "d long, text string")
    assert {r.d: r.embedding is None for r in with_vectors(rows, hashed_words()).collect()} == {1: False, 2: True}
    with pytest.raises(Exception, match="the model gave"):
        with_vectors(rows, lambda: lambda texts: np.zeros((0, 3))).collect()


def test_a_batch_is_dealt_to_many_tasks(spark, tmp_path, docs):
    store, seen = VectorStore(spark, str(tmp_path / "s")), []

    def held(rows):
        seen.append(len(rows.inputFiles()))
        return embed(rows)

    store.add(docs, "a", held, size=100)
    assert len(seen) == 2 and min(seen) > 1 and len({r.d for r in store.rows().collect()}) == store.rows().count() == docs.count()


@pytest.mark.parametrize("probes", [3, 30])
def test_more_queries_than_a_task_holds(spark, tmp_path, monkeypatch, probes):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("d"), F.lit("t").alias("text"), "embedding")
    store, queries = VectorStore(spark, str(tmp_path / "s")), rows.filter("d % 5 = 0").select(F.col("d").alias("q"), "embedding")
    store.add(rows, "a")
    store.build_index(cells=30, sample=100, tries=5)
    want = sorted(store.search_index(queries, 4, probes).collect())
    monkeypatch.setattr(V, "MOST_QUERIES", 7)
    assert queries.count() > 7 and sorted(store.search_index(queries, 4, probes).collect()) == want


def test_places_of_words_outlast_a_model():
    texts = ["A b\x0bc", "", "b b É", " ".join(f"w{i}" for i in range(300))]
    first, want = HashedWords(16)(texts), np.zeros((4, 16))
    for row, text in zip(want, texts):
        for w in text.lower().split():
            h = hashlib.md5(w.encode()).digest()
            row[int.from_bytes(h[:2]) % 16] += 1 - 2 * (h[2] & 1)
    want /= np.maximum(1e-9, np.linalg.norm(want, axis=1, keepdims=True))
    again = HashedWords(16)
    assert np.allclose(first, want) and {"a", "b", "c", "é", "w299"} <= set(again.at) and not HashedWords(17).at
    again.MOST = 10
    assert np.array_equal(again(texts), first) and np.array_equal(again(texts[:3]), first[:3]) and len(again.at) == 4
