"""Rank, tie, correlation and classification analytics over scored pairs.

Scores have few levels, so most results come from two small tables: one row for each query (``per_query``)
and one for each level (``levels``). Both are single aggregations with map-side partial sums.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.operators.ordered import level_quantile, quantiles, running

QUERY = "query_idx"


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def truth(scored: DataFrame) -> DataFrame:
    """One ground-truth row for each query: of several the one with the least doc_id."""
    one = F.min(F.when(F.col("is_gt") == 1, F.struct("doc_id", "llm_score", "dist_to_gt", "rag_failed"))).alias("g")
    rows = scored.groupBy(QUERY).agg(one).filter("g is not null")
    return rows.select(QUERY, F.col("g.doc_id").alias("gt_doc"), F.col("g.llm_score").alias("gt_score"), F.col("g.dist_to_gt").alias("gt_dist"), F.col("g.rag_failed").alias("gt_rag_failed"))


def annotated(scored: DataFrame) -> DataFrame:
    """Scored rows of queries that have a ground truth, with its score and distance."""
    return scored.filter("llm_score is not null").join(truth(scored.filter("llm_score is not null")), QUERY)


def per_query(scored: DataFrame) -> DataFrame:
    """One pass for ranks, ties, gaps, the top tier and the percentile of the ground truth."""
    s, g, d = F.col("llm_score"), F.col("gt_score"), F.col("dist_to_gt")
    other, top = F.col("is_gt") == 0, F.col("llm_score") == 1.0
    n = lambda c: F.sum(c.cast("long"))
    q = annotated(scored).groupBy(QUERY, "gt_doc", "gt_score", "gt_dist", "gt_rag_failed").agg(
        F.count("*").alias("n_docs"), n(s > g).alias("n_above"), n(s == g).alias("n_tied"), n(s < g).alias("n_below"),
        F.max(F.when(other, s)).alias("best_ngt"), F.max("llm_score").alias("max_score"), n(top).alias("n_at_top"),
        n(top & other).alias("n_top_ngt"), n(top & (F.col("is_gt") == 1)).alias("n_top_gt"), F.min(F.when(top & other, d)).alias("min_ngt_dist"),
        F.avg(F.when(top & other, d)).alias("mean_ngt_dist"), n(top & other & (d > F.col("gt_dist"))).alias("n_further"),
    )
    return q.withColumns({
        "rank_min": F.col("n_above") + 1,
        "rank_avg": F.col("n_above") + (F.col("n_tied") + 1) / 2,
        "rank_max": F.col("n_above") + F.col("n_tied"),
        "score_gap": F.col("gt_score") - F.col("best_ngt"),
        "gt_rank_pct": (2 * F.col("n_below") + F.col("n_tied") + 1) * 50.0 / F.col("n_docs"),
        "difficulty": F.when((F.col("n_above") > 0) | (F.col("gt_score") < 1.0), "FAILED").when(F.col("n_at_top") == 1, "EASY").when(F.col("n_at_top") <= 10, "MEDIUM").otherwise("HARD"),
    })


def dist_quantiles(rows: DataFrame, by: str, median: str = "median_dist") -> DataFrame:
    """(by, n_docs, mean_dist, median_dist, p10_dist, p90_dist), a row a group, from exact quantiles without a group in one task."""
    q = quantiles(rows, [by], "dist_to_gt", [0.5, 0.1, 0.9]).select(F.col(by).alias("g"), F.col("q")[0].alias(median), F.col("q")[1].alias("p10_dist"), F.col("q")[2].alias("p90_dist"))
    means = rows.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(F.col("is_gt").cast("long")).alias("n_gt"), F.avg("dist_to_gt").alias("mean_dist"))
    return means.join(q, F.col(by).eqNullSafe(F.col("g")), "left").drop("g")


def levels(scored: DataFrame) -> DataFrame:
    """One row for each score level."""
    return dist_quantiles(scored.filter("llm_score is not null"), "llm_score")


def level_statistics(rows: DataFrame, by: str, at: dict[str, float]) -> DataFrame:
    """(by, count, mean, std and quantiles of llm_score), from one row a group and level."""
    x, n = F.col("llm_score"), F.col("n")
    of = Window.partitionBy(by)  # a row a level
    cells = rows.groupBy(by, "llm_score").agg(F.count("*").alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(of)).withColumn("mean", F.sum(n * x).over(of) / F.col("all"))
    std = F.sqrt(F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))) / F.nullif(F.max("all") - 1, F.lit(0)))
    return cells.groupBy(by).agg(F.max("all").alias("count"), F.max("mean").alias("mean"), std.alias("std"), *(level_quantile("llm_score", p, "n").alias(c) for c, p in at.items()))


def cumulative(scored: DataFrame) -> DataFrame:
    """Levels from the highest down with running counts; the windows run over a row a level."""
    w = Window.orderBy(F.desc("llm_score")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    counts = scored.filter("llm_score is not null").groupBy("llm_score").agg(F.count("*").alias("n_docs"), F.sum(F.col("is_gt").cast("long")).alias("n_gt"))
    return counts.withColumns({"tp": F.sum("n_gt").over(w), "kept": F.sum("n_docs").over(w), "p": F.sum("n_gt").over(all_), "n": F.sum("n_docs").over(all_)})


def correlation(x: str, y: str) -> Column:
    """Pearson's; null where either side is constant (corr itself stops there)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), spread)


LEVELS = range(11)


def distance_cells(scored: DataFrame) -> DataFrame:
    """A row a query and distance, with the documents of each score level there (l0 to l10) and those nearer (before_l0 ...)."""
    level = F.round(F.col("llm_score") * 10).cast("int")
    rows = scored.filter("llm_score is not null and dist_to_gt is not null")
    cells = rows.groupBy(QUERY, "dist_to_gt").agg(*(F.count_if(level == k).alias(f"l{k}") for k in LEVELS))
    return running(cells, [QUERY], ["dist_to_gt"], [f"l{k}" for k in LEVELS])


def rank_correlations(scored: DataFrame, least: int = 5) -> DataFrame:
    """(query_idx, spearman, kendall) of score and distance, ties included; null under ``least`` documents or if a side is constant.

    All from sums over ``distance_cells``, so that no query's documents are ranked in one task. A distance's
    average rank is the number of nearer documents and half of those at it; a level's follows from the counts of
    levels. Both means are (n + 1) / 2, and the spread of average ranks is that of 1 to n less what ties take.
    For Kendall's tau-b a pair is concordant if both are larger: ties of distance drop out as nearer means
    strictly nearer, ties of score as levels are compared strictly.
    """
    here, nearer = [F.col(f"l{k}") for k in LEVELS], [F.col(f"before_l{k}") for k in LEVELS]
    all_of = lambda cs: sum(cs, F.lit(0))
    ties = lambda c: c.cast("double") * (c - 1) / 2
    cubes = lambda c: (F.pow(c.cast("double"), F.lit(3)) - c) / 12
    at = all_of(here)
    rank = all_of(nearer) + (at + 1) / 2
    net = all_of([here[k] * (all_of(nearer[:k]) - all_of(nearer[k + 1 :])) for k in LEVELS])
    sums = distance_cells(scored).groupBy(QUERY).agg(
        F.sum(net.cast("double")).alias("net"), F.sum(ties(at)).alias("td"), F.sum(cubes(at)).alias("cd"), F.sum(at).alias("n"),
        *(F.sum(c).alias(f"n{k}") for k, c in enumerate(here)), *(F.sum(c * rank).alias(f"r{k}") for k, c in enumerate(here)),
    )
    n, of = F.col("n"), [F.col(f"n{k}") for k in LEVELS]
    mean = (n + 1) / 2
    level_rank = [all_of(of[:k]) + (of[k] + 1) / 2 for k in LEVELS]
    together = all_of([(level_rank[k] - mean) * (F.col(f"r{k}") - mean * of[k]) for k in LEVELS])
    spread = (cubes(n) - F.col("cd")) * (cubes(n) - all_of([cubes(c) for c in of]))
    free = (ties(n) - F.col("td")) * (ties(n) - all_of([ties(c) for c in of]))
    big = lambda c: F.when(n >= least, c)
    return sums.select(QUERY, big(F.try_divide(together, F.sqrt(spread))).alias("spearman"), big(F.try_divide(F.col("net"), F.sqrt(free))).alias("kendall"))


def correlations(scored: DataFrame, least: int = 5) -> DataFrame:
    """(query_idx, n, pearson, spearman, point_biserial, kendall) of queries with a ground truth; null under ``least`` documents."""
    rows = annotated(scored)
    big = lambda c: F.when(F.count("*") >= least, c)
    out = rows.groupBy(QUERY).agg(
        F.count("*").alias("n"), big(correlation("llm_score", "dist_to_gt")).alias("pearson"), big(correlation("is_gt", "llm_score")).alias("point_biserial"),
    )
    return out.join(rank_correlations(rows, least), QUERY).select(QUERY, "n", "pearson", "spearman", "point_biserial", "kendall")


METHODS = {"spearman": "negative", "pearson": "negative", "kendall": "negative", "point_biserial": "positive"}


def long_correlations(scored: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in METHODS)
    return correlations(scored).select(QUERY, "n", F.expr(f"stack({len(METHODS)}, {pairs}) as (method, value)"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_test(r: float, n: float) -> float:
    """Two-sided p of a correlation r of n pairs, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    a, b = (n - 2) / 2, 0.5
    x = 1 - r * r  # df / (df + t^2)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def normal_test(tau: float, n: float) -> float:
    """Two-sided p of Kendall's tau by the normal approximation."""
    if n < 2 or tau is None or math.isnan(tau):
        return math.nan
    return math.erfc(abs(tau) / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) / math.sqrt(2))


def with_p_values(rows: DataFrame) -> DataFrame:
    """Adds p to (method, value, n); the rows are one for each query and method."""

    @F.pandas_udf("double")
    def p(method: pd.Series, value: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([normal_test(v, k) if m == "kendall" else t_test(v, k) for m, v, k in zip(method, value, n)])

    return rows.withColumn("p", F.nanvl(p("method", "value", "n"), F.lit(None).cast("double")))


def top_lists(scored: DataFrame, most: int) -> DataFrame:
    """Ranks by distance and by score, ties by doc_id, of rows that are among the first ``most`` of either."""
    by = lambda c: F.row_number().over(Window.partitionBy(QUERY).orderBy(c, "doc_id"))
    near = scored.select(QUERY, "doc_id", by(F.asc("dist_to_gt")).alias("rd")).filter(F.col("rd") <= most)
    high = scored.select(QUERY, "doc_id", by(F.desc("llm_score")).alias("rs")).filter(F.col("rs") <= most)
    return near.join(high, [QUERY, "doc_id"], "full")


def jaccard(scored: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 50, 100)) -> DataFrame:
    """(query_idx, K, jaccard, intersection) of the K nearest and the K best scored documents."""
    lists = top_lists(scored, max(ks)).withColumn("K", F.explode(F.array(*map(F.lit, ks))))
    a, b = F.coalesce(F.col("rd") <= F.col("K"), F.lit(False)), F.coalesce(F.col("rs") <= F.col("K"), F.lit(False))
    both = F.sum((a & b).cast("long"))
    return lists.groupBy(QUERY, "K").agg((both / F.sum((a | b).cast("int"))).alias("jaccard"), both.alias("intersection"))
