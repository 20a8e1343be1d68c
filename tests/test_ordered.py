"""Running sums, places and quantiles against plain ones, with groups cut by parts and by batches."""

import random

import numpy as np
import pytest

from rankfold.operators import ordered as O


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 5)
    yield
    spark.conf.set(key, before)


def test_running_sums(spark, small_batches):
    rng = random.Random(1)
    rows = [(g, i, rng.randrange(-3, 9), rng.randrange(5)) for g, n in (("a", 100), ("b", 1), (None, 30), ("c", 7)) for i in rng.sample(range(1000), n)]
    got = O.running(spark.createDataFrame(rows, "g string, o int, x long, y long"), ["g"], ["o"], ["x", "y"]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        x = y = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            want[g, r[1]] = (x, y)
            x, y = x + r[2], y + r[3]
    assert {(r.g, r.o): (r.before_x, r.before_y) for r in got} == want and len(got) == len(rows)


def test_one_group_over_all_parts(spark, small_batches):
    n = 500
    rows = spark.range(n).selectExpr("(id * 7919) % 1000 as o", "id")
    got = O.places(rows, [], ["o", "id"], "place").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [i for _, i in sorted(((i * 7919) % 1000, i) for i in range(n))]
    assert sorted(r.place for r in got) == list(range(1, n + 1))


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles(spark, small_batches, by):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.5, 0.5, rng.random(), None])) for g, n in (("a", 200), ("b", 1), (None, 17), ("none", 0)) for _ in range(n)] + [("none", None)]
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r.g if by else None): r for r in O.quantiles(spark.createDataFrame(rows, "g string, v double"), by, "v", at).collect()}
    groups = {r[0] for r in rows} if by else {None}
    for g in groups:
        values = [v for h, v in rows if v is not None and (not by or h == g)]
        if values:
            assert got[g].n == len(values) and np.allclose(got[g].q, np.quantile(values, at), rtol=0, atol=1e-12)
        else:
            assert g not in got


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double, x long")
    assert O.running(empty, ["g"], ["v"], ["x"]).collect() == [] == O.quantiles(empty, ["g"], "v", [0.5]).collect() == O.quantiles(empty, [], "v", [0.5]).collect()
