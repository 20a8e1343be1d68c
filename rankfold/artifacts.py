"""The tables that an analysis of a run gives, by name, with the columns and labels that their readers know."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankfold.operators import ranking as R
from rankfold.operators.ordered import quantiles
from rankfold.plans import analytics

P = analytics.PLANS

#: fixed values: columns of the four correlations, and what their summary calls them
CORRELATIONS = {
    "spearman": ("spearman_r", "spearman_p", "Spearman r (score vs dist_to_gt)"),
    "pearson": ("pearson_r", "pearson_p", "Pearson r (score vs dist_to_gt)"),
    "kendall": ("kendall_tau", "kendall_p", "Kendall τ-b (score vs dist_to_gt)"),
    "point_biserial": ("pointbiserial_r", "pointbiserial_p", "Point-biserial r (score vs is_gt)"),
}
#: fixed values: labels of metrics
ROC = {"ROC_AUC": "ROC-AUC", "average_precision": "Average Precision (PR-AUC)", "baseline": "Baseline (random) PR"}
SIDES = {"rank_min": ("optimistic", "min-rank"), "rank_avg": ("tie-corrected", "avg-rank"), "rank_max": ("pessimistic", "max-rank")}
CORRECTED = {f"MRR_{r}": f"MRR ({name}, {short})" for r, (name, short) in SIDES.items()}
CORRECTED |= {f"P@{k}_{r}": f"P@{k} ({name}, {r}<=k)" for k in analytics.KS for r, (name, _) in SIDES.items()}


def named(c: str, labels: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col(c)].alias(c)


def per_query_correlation(s: DataFrame) -> DataFrame:
    rows = R.with_p_values(R.long_correlations(s))
    side = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    values = (side(m, c).alias(name) for m, (r, p, _) in CORRELATIONS.items() for c, name in (("value", r), ("p", p)))
    return rows.groupBy("query_idx", F.col("n").alias("n_docs")).agg(*values)


def correlation_summary(s: DataFrame) -> DataFrame:
    significant = P["correlation_significance"](s).select("method", "pct_sig_p05")
    out = P["correlation_summary"](s).join(significant, "method")
    return out.select(named("method", {m: label for m, (_, _, label) in CORRELATIONS.items()}), "median", "mean", "pct_negative", "pct_positive", "pct_sig_p05", "expected_sign")


def _edge(x: float, places: int = 3) -> float:
    """Rounded to so many places, counted from the first that isn't 0 for numbers below 1."""
    if x == 0 or not math.isfinite(x):
        return x
    return round(x, places if abs(x) >= 1 else places - 1 - math.floor(math.log10(abs(x))))


@F.udf(StringType())
def interval(edges: list[float], k: int) -> str:
    """The k-th interval between distinct edges, open on the left; the first starts a thousandth lower, so that it holds its edge."""
    low = _edge(edges[k])
    return f"({low - 10**-3 if k == 0 else low}, {_edge(edges[k + 1])}]"


def distance_quantile_analysis(s: DataFrame) -> DataFrame:
    edges = quantiles(s, [], "dist_to_gt", [k / 10 for k in range(11)]).select(F.array_distinct("q").alias("e"))  # one row
    bins = P["distance_quantile_analysis"](s).crossJoin(F.broadcast(edges))
    return bins.withColumn("dist_bin_label", interval("e", "dist_bin")).drop("e")


def topk_jaccard(s: DataFrame) -> DataFrame:
    return R.jaccard(s).select("query_idx", "K", R.r6(F.col("jaccard")).alias("jaccard"), "intersection")


def per_query_overview(s: DataFrame) -> DataFrame:
    """All that is known of a query, from one aggregate, its correlations and the tiers."""
    q = R.per_query(s)
    unique = ((F.col("n_above") == 0) & (F.col("n_tied") == 1)).cast("int").alias("gt_uniquely_top")
    base = q.select(
        "query_idx", F.col("rank_min").alias("gt_llm_rank"), F.col("gt_score").alias("gt_llm_score"), "gt_rank_pct", "n_docs", F.col("gt_rag_failed").alias("rag_failed"), "difficulty", "gt_score", "n_at_top",
        F.col("n_tied").alias("n_tied_at_gt"), (1 / F.col("n_tied")).alias("tier_precision"), unique, "rank_min", "rank_avg", "rank_max", "score_gap", F.col("best_ngt").alias("best_ngt_score"),
    )
    corr = R.correlations(s).select("query_idx", *(F.col(m).alias(CORRELATIONS[m][0]) for m in ("spearman", "pearson", "kendall")))
    tier = P["within_tier_dist"](s).select("query_idx", "pct_ngt_further", "gt_would_win_dist")
    return base.join(corr, "query_idx", "left").join(tier, "query_idx", "left").orderBy("query_idx")


def renamed(plan: str, **columns: str) -> Callable[[DataFrame], DataFrame]:
    """A plan with columns picked and named: new name = old name."""
    return lambda s: P[plan](s).select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


#: fixed values: the tables of each step, by folder and name
ARTIFACTS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "base": {
        "per_query/per_query_correlation": per_query_correlation,
        "global/correlation_summary": correlation_summary,
        "per_query/gt_llm_rank": renamed("per_query_stats", query_idx="query_idx", gt_llm_rank="gt_llm_rank", gt_llm_score="gt_score", n_docs="n_docs", gt_rank_pct="gt_rank_pct", rag_failed="rag_failed"),
        "global/llm_recovery_at_k": P["llm_recovery_at_k"],
        "global/score_distribution_summary": P["score_distribution"],
        "per_query/gt_score_percentile": renamed("per_query_stats", query_idx="query_idx", gt_rank_pct="gt_rank_pct"),
        "global/roc_pr_summary": lambda s: P["roc_pr_summary"](s).select(named("metric", ROC), "value"),
        "global/distance_quantile_analysis": distance_quantile_analysis,
        "per_query/topk_jaccard": topk_jaccard,
        "global/topk_jaccard_summary": renamed("topk_jaccard_summary", K="K", count="count", mean="mean", std="std", min="min", **{"25%": "p25", "50%": "p50", "75%": "p75"}, max="max"),
        "per_query/score_gap": renamed("per_query_stats", query_idx="query_idx", gt_llm_score="gt_score", best_ngt_score="best_ngt", score_gap="score_gap"),
        "global/mrr_and_precision_at_k": P["mrr_and_precision_at_k"],
    },
    "extended": {
        "per_query/tie_structure": P["tie_structure"],
        "global/score_level_breakdown": P["score_level_breakdown"],
        "global/threshold_filter_analysis": P["threshold_filter_analysis"],
        "per_query/query_difficulty": P["query_difficulty"],
        "per_query/failure_cases": P["failure_cases"],
        "global/false_positive_analysis": P["false_positive_analysis"],
        "per_query/tie_corrected_ranks": P["tie_corrected_ranks"],
        "global/corrected_mrr_at_k": lambda s: P["tie_corrected_mrr"](s).select(named("metric", CORRECTED), "value"),
        "per_query/within_tier_dist": P["within_tier_dist"],
        "global/marginal_score_value": P["marginal_score_value"],
    },
    "report": {
        "per_query/per_query_overview": per_query_overview,
        "global/report_bundle": P["report_bundle"],
        "global/gt_percentile_summary": P["gt_percentile_summary"],
        "global/score_gap_summary": P["score_gap_summary"],
        "global/spearman_extremes": P["spearman_extremes"],
    },
}
