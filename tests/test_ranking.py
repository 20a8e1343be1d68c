import itertools
import math

import numpy as np
import pytest

from rankfold.operators import ranking as R

SCHEMA = "query_idx long, doc_id string, llm_score double, dist_to_gt double, is_gt int, rag_failed int"


def facts(spark, rows):
    return spark.createDataFrame([(q, d, s, x, g, 0) for q, d, s, x, g in rows], SCHEMA)


def test_queries_without_truth_are_dropped_and_the_least_of_two_truths_counts(spark):
    s = facts(spark, [(1, "b", 0.9, 0.0, 1), (1, "a", 0.5, 0.0, 1), (1, "c", 0.7, 0.3, 0), (2, "a", 1.0, 0.1, 0)])
    rows = R.per_query(s).collect()
    assert [(r.query_idx, r.gt_doc, r.rank_min, r.n_docs) for r in rows] == [(1, "a", 3, 3)]


@pytest.mark.parametrize("n, tier", [(1, "EASY"), (10, "MEDIUM"), (11, "HARD")])
def test_difficulty_counts_the_truth_itself(spark, n, tier):
    s = facts(spark, [(1, "g", 1.0, 0.0, 1)] + [(1, f"d{i}", 1.0, 0.5, 0) for i in range(n - 1)])
    assert R.per_query(s).first().difficulty == tier


def test_pending_scores_are_left_out_and_zeros_are_not(spark):
    s = facts(spark, [(1, "g", 0.5, 0.0, 1), (1, "a", None, 0.4, 0), (1, "b", 0.0, 0.5, 0)])
    assert R.per_query(s).first().n_docs == 2


def test_correlations_are_null_for_few_documents_or_a_constant_side(spark):
    few = [(1, f"d{i}", i / 10, i / 10, int(i == 0)) for i in range(4)]
    flat = [(2, f"d{i}", 0.1, i / 10, int(i == 0)) for i in range(6)]
    got = {r.query_idx: r for r in R.correlations(facts(spark, few + flat)).collect()}
    assert got[1].pearson is None and got[1].kendall is None and got[2].spearman is None and got[2].kendall is None


def test_kendall_equals_all_pairs(spark):
    import random

    random.seed(5)
    rows = [(1, f"d{i}", random.randint(1, 4) / 10, random.randint(0, 6) / 10, int(i == 0)) for i in range(40)]
    sign = lambda x: (x > 0) - (x < 0)
    pairs = list(itertools.combinations(rows, 2))
    net = sum(sign(a[2] - b[2]) * sign(a[3] - b[3]) for a, b in pairs)
    free = [sum(a[k] != b[k] for a, b in pairs) for k in (2, 3)]
    got = R.rank_correlations(facts(spark, rows)).first()
    assert got.kendall == pytest.approx(net / math.sqrt(free[0] * free[1]))
    rank = lambda k: [sum(b[k] < a[k] for b in rows) + (sum(b[k] == a[k] for b in rows) + 1) / 2 for a in rows]
    assert got.spearman == pytest.approx(np.corrcoef(rank(2), rank(3))[0, 1])


def test_p_values():
    assert R.t_test(0.5, 10) == pytest.approx(0.14111328125, abs=1e-6)
    assert R.t_test(0.0, 10) == 1.0 and R.t_test(1.0, 10) == 0.0 and math.isnan(R.t_test(0.3, 2))
    assert R.normal_test(0.0, 20) == 1.0 and R.normal_test(0.6, 30) < 1e-4
