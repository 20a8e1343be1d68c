import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold import analysis, storing
from rankfold.operators.scored import raw

#: fixed values: the columns of the published tables
HEADERS = {
    "global/corrected_mrr_at_k": "metric,value",
    "global/correlation_summary": "method,median,mean,pct_negative,pct_positive,pct_sig_p05,expected_sign",
    "global/distance_quantile_analysis": "dist_bin,mean,median,std,count,dist_bin_label",
    "global/false_positive_analysis": "group,count,mean_dist,median_dist,p10_dist,p90_dist",
    "global/llm_recovery_at_k": "K,recovered,total,recovery_rate_pct",
    "global/marginal_score_value": "score,n_docs,mean_dist,median_dist,improvement_vs_01",
    "global/mrr_and_precision_at_k": "metric,value",
    "global/roc_pr_summary": "metric,value",
    "global/score_distribution_summary": "group,count,mean,median,std,p25,p75,p90,p99",
    "global/score_level_breakdown": "score,n_docs,n_gt,gt_fraction,mean_dist,median_dist,p10_dist,p90_dist",
    "global/threshold_filter_analysis": "threshold,n_docs_kept,avg_pool_size,precision,recall,f1",
    "global/topk_jaccard_summary": "K,count,mean,std,min,25%,50%,75%,max",
    "per_query/per_query_correlation": "query_idx,n_docs,spearman_r,spearman_p,pearson_r,pearson_p,kendall_tau,kendall_p,pointbiserial_r,pointbiserial_p",
    "per_query/failure_cases": "query_idx,gt_llm_score,gt_dist_to_gt,n_docs_above_gt,gt_rank,max_score_in_query,n_docs_at_max,n_docs_total",
    "per_query/gt_llm_rank": "query_idx,gt_llm_rank,gt_llm_score,n_docs,gt_rank_pct,rag_failed",
    "per_query/gt_score_percentile": "query_idx,gt_rank_pct",
    "per_query/query_difficulty": "query_idx,gt_score,n_at_top,difficulty",
    "per_query/score_gap": "query_idx,gt_llm_score,best_ngt_score,score_gap",
    "per_query/tie_corrected_ranks": "query_idx,rank_min,rank_avg,rank_max,n_docs",
    "per_query/tie_structure": "query_idx,gt_score,n_tied_at_gt,n_above_gt,n_docs,tier_precision,gt_uniquely_top",
    "per_query/topk_jaccard": "query_idx,K,jaccard,intersection",
    "per_query/within_tier_dist": "query_idx,gt_dist,mean_ngt_dist,min_ngt_dist,n_in_tier,pct_ngt_further,gt_would_win_dist",
}


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for name in ("staged_run_1", "staged_run_2", "z_other", "staged_run_3"):
        folder = f"{root}/{name}"
        if name != "staged_run_3":  # a run without results yet
            raw(spark, sf_dir).filter("query_idx <= 8").withColumn("more", F.lit(1)).write.parquet(f"{folder}/results")
        if name == "staged_run_2":
            spark.createDataFrame([("main_loop_completed", "TRUE"), ("staging_last_completed_stage", "4")], "key string, value string").write.parquet(f"{folder}/meta")
            spark.createDataFrame([(12, "no truth"), (9, "no vector")], "query_idx long, reason string").write.parquet(f"{folder}/skipped")
    run = analysis.latest_run(spark, str(root))
    assert run == f"{root}/staged_run_2"
    return run, analysis.analyse_run(spark, run)


def test_every_artifact_has_the_published_columns(spark, run):
    folder, done = run
    assert done == [n for named in analysis.ARTIFACTS.values() for n in named] and set(HEADERS) <= set(done)
    for name in done:
        columns = spark.read.csv(f"{folder}/analysis/csv/{name}", header=True).columns
        assert columns and (name not in HEADERS or ",".join(columns) == HEADERS[name]), name
        assert analysis.find_artifact(spark, f"{folder}/analysis", name.split("/")[1]) == f"{folder}/analysis/csv/{name}"


def read(spark, run, name):
    return spark.read.csv(f"{run[0]}/analysis/csv/{name}", header=True, inferSchema=True)


def test_per_query_tables(spark, run):
    facts = spark.read.parquet(f"{run[0]}/results").filter("llm_score is not null").toPandas()
    queries = sorted(facts[facts.is_gt == 1].query_idx.unique())
    gaps = {r.query_idx: r for r in read(spark, run, "per_query/score_gap").collect()}
    assert sorted(gaps) == queries
    overview = read(spark, run, "per_query/per_query_overview").collect()
    assert [r.query_idx for r in overview] == queries
    for q, o in zip(queries, overview):
        own = facts[facts.query_idx == q]
        truth, best = own[own.is_gt == 1].llm_score.iloc[0], own[own.is_gt == 0].llm_score.max()
        assert (gaps[q].gt_llm_score, gaps[q].best_ngt_score, gaps[q].score_gap) == (truth, best, round(truth - best, 6))
        assert o.spearman_r == pytest.approx(own.llm_score.rank().corr(own.dist_to_gt.rank())) and o.best_ngt_score == best
        assert o.pearson_r == pytest.approx(own.llm_score.corr(own.dist_to_gt))


def test_labels(spark, run):
    bins = read(spark, run, "global/distance_quantile_analysis").orderBy("dist_bin").collect()
    dist = spark.read.parquet(f"{run[0]}/results").filter("llm_score is not null").toPandas().dist_to_gt
    edges = np.quantile(dist, np.arange(11) / 10)
    for k, r in enumerate(bins):
        low, high = (float(x) for x in r.dist_bin_label[1:-1].split(", "))
        assert high == pytest.approx(edges[k + 1], abs=1e-3) and low == pytest.approx(edges[k] - (0.001 if k == 0 else 0), abs=1e-3)
    labels = [r.metric for r in read(spark, run, "global/corrected_mrr_at_k").collect()]
    assert len(set(labels)) == 21 and "MRR (tie-corrected, avg-rank)" in labels and "P@50 (pessimistic, rank_max<=k)" in labels
    assert {r.method.split()[0] for r in read(spark, run, "global/correlation_summary").collect()} == {"Spearman", "Pearson", "Kendall", "Point-biserial"}


def test_health(spark, run):
    health = json.loads(storing.read_text(spark, f"{run[0]}/analysis/run_health.json"))
    facts = spark.read.parquet(f"{run[0]}/results").toPandas()
    assert health["total_rows"] == len(facts) and health["null_score_rows"] == facts.llm_score.isna().sum() > 0
    assert health["loop_completed"] and not health["is_complete"] and health["staging_last_completed_stage"] == 4 and health["n_skipped"] == 2
    assert len(health["warnings"]) == 2 and health["n_queries_full_pool"] == 8 and health["n_queries_partial_pool"] == 0
    index = storing.read_text(spark, f"{run[0]}/analysis/INDEX.md")
    assert all(f"csv/{n} " in index for n in run[1]) and "2 queries were skipped" in index
    assert [r.query_idx for r in read(spark, run, "per_query/skipped_queries").collect()] == [9, 12]
    assert read(spark, run, "per_query/queries_with_null_scores").agg(F.sum("null_scores")).first()[0] == health["null_score_rows"]


def test_health_of_whole_empty_and_failed_runs(spark):
    rows = spark.createDataFrame([(q, f"d{i}", 0.5, 0.1, 0, 0) for q in (1, 2) for i in range(3)], analysis.FACT)
    whole = analysis.run_health(rows, {"main_loop_completed": "1"}, 0)
    assert whole["is_complete"] and whole["warnings"] == [] and whole["n_queries_full_pool"] == 2
    partial = analysis.run_health(rows.filter("query_idx = 1 or doc_id = 'd0'"), {"main_loop_completed": "1"}, 0)
    assert not partial["is_complete"] and (partial["n_queries_full_pool"], partial["n_queries_partial_pool"]) == (1, 1)
    fatal = analysis.run_health(rows, {"fatal_llm_error": "x" * 200, "fatal_llm_error_query_idx": "7"}, 0)
    assert fatal["fatal_error_query_idx"] == 7 and "at query 7: " + "x" * 120 + "…" in fatal["warnings"][1]
    empty = analysis.run_health(rows.limit(0), {}, 0)
    assert (empty["total_rows"], empty["sync_pct"], empty["n_queries_full_pool"]) == (0, 100.0, 0)


def test_runs_and_artifacts_that_are_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        analysis.latest_run(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        analysis.analyse_run(spark, str(tmp_path))
    assert analysis.find_artifact(spark, str(tmp_path), "score_gap") == f"{tmp_path}/csv/per_query/score_gap"
    (tmp_path / "score_gap.csv").write_text("query_idx\n")
    assert analysis.find_artifact(spark, str(tmp_path), "score_gap") == f"{tmp_path}/score_gap.csv"


def test_steps():
    assert analysis.parse_steps(None) == analysis.parse_steps("all") == ["base", "extended", "report"]
    assert analysis.parse_steps("report, base,report") == ["report", "base"]
    with pytest.raises(ValueError, match="unknown"):
        analysis.parse_steps("charts")


def test_golden_closed_forms(spark):
    """One query, the truth tied with two others below one better: places 2, 3 and 4."""
    rows = [(1, d, s, x, int(d == "t"), 1) for d, s, x in (("a", 0.9, 0.1), ("t", 0.5, 0.0), ("b", 0.5, 0.2), ("c", 0.5, 0.3), ("e", 0.1, 0.9))]
    facts = spark.createDataFrame(rows, analysis.FACT)
    plan = lambda name: {r.metric: r.value for r in analysis.analytics.PLANS[name](facts).collect()}
    mrr = plan("tie_corrected_mrr")
    assert [mrr[f"MRR_{r}"] for r in ("rank_min", "rank_avg", "rank_max")] == [0.5, round(1 / 3, 6), 0.25]
    assert plan("mrr_and_precision_at_k")["P@1"] == 0 and plan("mrr_and_precision_at_k")["P@3"] == 1
    assert plan("roc_pr_summary")["ROC_AUC"] == 0.5  # below one, above one, tied with two
    bundle = plan("report_bundle")
    assert bundle["wr_within"] is None and bundle["gt_in_top"] == 0 and bundle["rag_fail_pct"] == 100 and len(bundle) == 12


def test_published_figures_follow_from_published_counts():
    """Closed forms of the published run: 195 of 199 truths first, 2021 others at the top level, 1004140 pairs."""
    assert 195 / 199 * 100 == pytest.approx(97.98994974874373) and (195 + 2021) / 199 == pytest.approx(11.135678391959798)
    assert 195 / (195 + 2021) == pytest.approx(0.08799638989169675) and 1004140 / 199 == pytest.approx(5045.929648241206)
