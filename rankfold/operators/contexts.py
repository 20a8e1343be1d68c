"""Contexts for questions: search, scoring anew, a threshold, and one text for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.vectorise import Vectoriser, with_vectors
from rankfold.operators import vector as V
from rankfold.storing import stored

#: similarities, larger is nearer: of the metrics those that are, and cosine as such
SIMILARITIES = {"cosine": V.cosine, "dot": V.dot, "euclidean": V.METRICS["euclidean"]}


def retrieve(corpus: DataFrame, questions: DataFrame, make: Vectoriser, k: int = 5, threshold: float = 0.5, most: int = 5, similarity: str = "cosine") -> DataFrame:
    """(q, d, rank, similarity, text): what stands in each question's context, best first.

    ``corpus`` has (d, text, embedding), ``questions`` (q, question). The ``k`` nearest by the stored vectors
    are found first; their texts are vectorised anew, compared with the question by ``similarity``, and of those
    at least ``threshold`` the first ``most`` stay, ties by the search's rank. Any number of questions, as in
    ``top_k``; what is joined are the rows found, k a question, and the texts of their documents, each of which is
    vectorised once. Questions and documents without text have no vector and no part in it.
    """
    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}; there are {sorted(SIMILARITIES)}")
    asked = stored(with_vectors(questions.select("q", "question").filter("question is not null"), make, text="question"), "asked")
    near = stored(V.top_k(corpus.select("d", "embedding"), asked, k).select("q", "d", F.col("rank").alias("found")), "near")
    texts = corpus.select("d", "text").filter("text is not null").join(near.select("d").distinct(), "d", "left_semi")
    again = with_vectors(texts, make).withColumnRenamed("embedding", "e").join(near, "d")
    rows = again.join(asked.select("q", "embedding"), "q")
    rows = rows.withColumn("similarity", F.round(SIMILARITIES[similarity](F.col("embedding"), F.col("e")), 6)).filter(F.col("similarity") >= threshold)
    w = V.Window.partitionBy("q").orderBy(F.desc("similarity"), "found")  # k rows a question
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("q", "d", "rank", "similarity", "text")


def contexts(corpus: DataFrame, questions: DataFrame, make: Vectoriser, **options) -> DataFrame:
    """(q, n, context): the texts of ``retrieve`` with a blank line between them; '' for a question that none fits."""
    rows = retrieve(corpus, questions, make, **options).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("t"))
    joined = rows.select("q", F.size("t").alias("n"), F.array_join("t.text", "\n\n").alias("context"))
    return questions.select("q").join(joined, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("context", F.lit("")).alias("context"))
