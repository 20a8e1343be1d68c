from pyspark.sql import functions as F

from rankfold.operators import vector as V
from rankfold.operators.scored import corpus, query_set
from rankfold.plans.retrieval import QUERIES


def test_each_query_is_searched_as_by_itself(spark, sf_dir):
    out = QUERIES["trilateration"](spark, sf_dir).collect()
    queries = {r.q: r.embedding for r in query_set(spark, sf_dir).collect()}
    assert {r.q for r in out} == set(queries)
    docs = corpus(spark, sf_dir)
    start = [r.d for r in V.anchors(docs, 4).collect()]
    for q in (0, 31):
        e = F.array(*(F.lit(float(x)) for x in queries[q]))
        alone = V.trilateration_search(docs, start, lambda rows: rows.select("d", ((1 + V.cosine(F.col("embedding"), e)) / 2).alias("score"))).collect()
        assert [(r.step, r.d, round(r.score, 9)) for r in out if r.q == q] == [(r.step, r.d, round(r.score, 9)) for r in alone]


def test_the_point_equals_a_plain_loop():
    import numpy as np

    from rankfold.operators.vector import trilaterate

    rng = np.random.default_rng(5)
    points, scores = rng.normal(size=(5, 3)), rng.uniform(0.2, 0.6, 5)
    x = [sum(points[i][k] / (1 - scores[i] + 1e-8) for i in range(5)) / sum(1 / (1 - s + 1e-8) for s in scores) for k in range(3)]
    for _ in range(20):
        slope = [0.0] * 3
        for i in range(5):
            far = sum((x[k] - points[i][k]) ** 2 for k in range(3)) ** 0.5
            for k in range(3):
                slope[k] += 2 / (1 - scores[i] + 1e-8) * (far - (1 - scores[i])) / (far + 1e-8) * (x[k] - points[i][k])
        if sum(g * g for g in slope) ** 0.5 <= 1e-4:
            break
        x = [a - 0.1 * g for a, g in zip(x, slope)]
    assert np.allclose(trilaterate(points, scores), x, rtol=1e-6)


def test_accuracy_of_plain_search_and_trilateration(spark):
    truths = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "q long, d long")
    naive = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (2, 9, 1), (2, 6, 2)], "q long, d long, rank int")
    searched = spark.createDataFrame([(1, 0, 9, 0.5), (1, 1, 5, 0.5), (2, 0, 9, 0.1), (2, 1, 6, 0.7), (3, 0, 7, 0.2)], "q long, step int, d long, score double")
    got = {r.method: tuple(r)[1:] for r in V.retrieval_accuracy(truths, naive, searched).collect()}
    assert got == {"naive": (3, 1, round(100 / 3, 6)), "trilateration": (3, 2, round(200 / 3, 6))}
