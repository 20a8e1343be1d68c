import hashlib

from pyspark.sql import functions as F

from rankfold.functions import parsing as P
from rankfold.operators import vector as V
from rankfold.plans.retrieval import QUERIES


def test_knn_search_takes_all_queries_and_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = QUERIES["knn_search"](spark, sf_dir).collect()
    assert {r.q for r in out} == {r.vec_id for r in rows.filter("vec_id % 50 = 0").collect()} and min(r.d for r in out) < 50
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    docs = rows.select(F.col("vec_id").alias("d"), "embedding")
    assert sorted(V.top_k_in_blocks(docs, queries, 10, 50, most=3).collect()) == sorted(out)


def brute_normal(t):
    gap = " \t\n\x0b\x0c\r"
    low = "".join(c for c in t.lower() if c not in P.PUNCTUATION)
    for c in gap:
        low = low.replace(c, " ")
    return hashlib.md5(" ".join(x for x in low.split(" ") if x).encode()).hexdigest()


def test_normalised_documents_equal_brute_force_in_every_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r.normal for r in QUERIES["normalised_documents"](spark, sf_dir).collect()}
    assert got == {r.doc_id: None if r.text is None else brute_normal(r.text) for r in docs} and len({r.lang for r in docs}) > 1


def test_pair_metrics_cover_all_pairs(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert QUERIES["pair_metrics"](spark, sf_dir).count() == 50 * (n - 50)
