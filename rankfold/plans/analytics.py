"""Queries of the ranking analytics, each with its SQL twin over the same fact table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.operators import ranking as R
from rankfold.operators.ordered import quantiles
from rankfold.operators.ranking import r6
from rankfold.operators.scored import SCORED_SQL, raw, scored

QUERIES, SQL = {}, {}
#: the same by name as functions of any fact table; those over raw facts, with missing scores, apart
PLANS, RAW_PLANS = {}, {}


def query(sql: str | None = None, fact=scored):
    """Register a function of the fact table, with SQL after the fact table's common tables."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(fact(spark, sf_dir))

        QUERIES[f.__name__] = run
        (RAW_PLANS if fact is raw else PLANS)[f.__name__] = f
        if sql:
            SQL[f.__name__] = SCORED_SQL + PQ + sql
        return f

    return register


PQ = """,
ann AS (SELECT r.*, gt_doc, gt_score, gt_dist, t.rag_failed AS gt_rag FROM results r JOIN truth t USING (query_idx)),
pq AS (SELECT query_idx, gt_score, gt_dist, gt_rag, count(*) AS n_docs, count(*) FILTER (llm_score > gt_score) AS n_above,
  count(*) FILTER (llm_score = gt_score) AS n_tied, count(*) FILTER (llm_score < gt_score) AS n_below, max(llm_score) FILTER (is_gt = 0) AS best_ngt,
  max(llm_score) AS max_score, count(*) FILTER (llm_score = 1.0) AS n_at_top, count(*) FILTER (llm_score = 1.0 AND is_gt = 0) AS n_top_ngt,
  min(dist_to_gt) FILTER (llm_score = 1.0 AND is_gt = 0) AS min_ngt_dist, avg(dist_to_gt) FILTER (llm_score = 1.0 AND is_gt = 0) AS mean_ngt_dist,
  count(*) FILTER (llm_score = 1.0 AND is_gt = 0 AND dist_to_gt > gt_dist) AS n_further,
  n_above + 1 AS rank_min, n_above + (n_tied + 1) / 2 AS rank_avg, n_above + n_tied AS rank_max,
  (2 * n_below + n_tied + 1) * 50.0::DOUBLE / n_docs AS gt_rank_pct,
  CASE WHEN n_above > 0 OR gt_score < 1.0 THEN 'FAILED' WHEN n_at_top = 1 THEN 'EASY' WHEN n_at_top <= 10 THEN 'MEDIUM' ELSE 'HARD' END AS difficulty
  FROM ann GROUP BY query_idx, gt_score, gt_dist, gt_rag),
lv AS (SELECT llm_score, count(*) AS n_docs, sum(is_gt)::BIGINT AS n_gt, avg(dist_to_gt) AS mean_dist, quantile_cont(dist_to_gt, 0.5) AS median_dist,
  quantile_cont(dist_to_gt, 0.1) AS p10_dist, quantile_cont(dist_to_gt, 0.9) AS p90_dist FROM results GROUP BY llm_score),
cum AS (SELECT *, sum(n_gt) OVER w AS tp, sum(n_docs) OVER w AS kept, sum(n_gt) OVER () AS p, sum(n_docs) OVER () AS n FROM lv
  WINDOW w AS (ORDER BY llm_score DESC ROWS UNBOUNDED PRECEDING))
"""
RANKS = ("rank_min", "rank_avg", "rank_max")
KS = (1, 3, 5, 10, 20, 50)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def metrics(df: DataFrame, **values) -> DataFrame:
    """One row (metric, value) for each aggregate."""
    row = df.agg(*(r6(v).alias(f"m{i}") for i, v in enumerate(values.values())))
    pairs = ", ".join(f"'{name}', m{i}" for i, name in enumerate(values))
    return row.select(F.expr(f"stack({len(values)}, {pairs}) as (metric, value)"))


def metrics_sql(values: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, round(({v})::DOUBLE, 6) AS value FROM {source}" for k, v in values.items())


_mrr = {f"MRR_{r}": f"avg(1.0::DOUBLE / {r})" for r in RANKS} | {f"P@{k}_{r}": f"avg(CASE WHEN {r} <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for k in KS for r in RANKS}


@query(metrics_sql(_mrr, "pq"))
def tie_corrected_mrr(s: DataFrame) -> DataFrame:
    """Reciprocal ranks and precision at K with ties taken at best, on average and at worst."""
    values = {f"MRR_{r}": F.avg(1 / F.col(r)) for r in RANKS} | {f"P@{k}_{r}": F.avg((F.col(r) <= k).cast("double")) for k in KS for r in RANKS}
    return metrics(R.per_query(s), **values)


@query("SELECT query_idx, rank_min, rank_avg::DOUBLE AS rank_avg, rank_max, n_docs FROM pq")
def tie_corrected_ranks(s: DataFrame) -> DataFrame:
    return R.per_query(s).select("query_idx", "rank_min", "rank_avg", "rank_max", "n_docs")


@query("""SELECT query_idx, n_docs, gt_score, gt_dist, rank_min AS gt_llm_rank, rank_avg::DOUBLE AS gt_llm_rank_avg, round(gt_rank_pct, 6) AS gt_rank_pct,
round(rank_min::DOUBLE / n_docs, 6) AS norm_rank, best_ngt, round(gt_score - best_ngt, 6) AS score_gap, gt_rag AS rag_failed FROM pq""")
def per_query_stats(s: DataFrame) -> DataFrame:
    return R.per_query(s).select(
        "query_idx", "n_docs", "gt_score", "gt_dist", F.col("rank_min").alias("gt_llm_rank"), F.col("rank_avg").alias("gt_llm_rank_avg"), r6(F.col("gt_rank_pct")).alias("gt_rank_pct"),
        r6(F.col("rank_min") / F.col("n_docs")).alias("norm_rank"), "best_ngt", r6(F.col("score_gap")).alias("score_gap"), F.col("gt_rag_failed").alias("rag_failed"),
    )


_CORR = """, rk AS (SELECT *, rank() OVER (PARTITION BY query_idx ORDER BY llm_score) + (count(*) OVER (PARTITION BY query_idx, llm_score) - 1) / 2 AS rs,
  rank() OVER (PARTITION BY query_idx ORDER BY dist_to_gt) + (count(*) OVER (PARTITION BY query_idx, dist_to_gt) - 1) / 2 AS rd FROM ann),
kn AS (SELECT a.query_idx, sum(sign(a.llm_score - b.llm_score) * sign(a.dist_to_gt - b.dist_to_gt)) AS net, count(*) AS pairs,
  count(*) FILTER (a.llm_score = b.llm_score) AS ts, count(*) FILTER (a.dist_to_gt = b.dist_to_gt) AS td
  FROM ann a JOIN ann b ON a.query_idx = b.query_idx AND a.doc_id < b.doc_id GROUP BY a.query_idx),
nn AS (SELECT query_idx, count(*) AS n, CASE WHEN stddev_pop(llm_score) > 0 AND stddev_pop(dist_to_gt) > 0 THEN corr(llm_score, dist_to_gt) END AS pearson,
  CASE WHEN stddev_pop(rs) > 0 AND stddev_pop(rd) > 0 THEN corr(rs, rd) END AS spearman,
  CASE WHEN stddev_pop(is_gt) > 0 AND stddev_pop(llm_score) > 0 THEN corr(is_gt, llm_score) END AS point_biserial FROM rk GROUP BY query_idx),
co AS (SELECT query_idx, n, pearson, spearman, point_biserial, net / sqrt((pairs - ts)::DOUBLE * (pairs - td)) AS kendall FROM nn JOIN kn USING (query_idx)),
lc AS (UNPIVOT (SELECT query_idx, n, spearman, pearson, kendall, point_biserial FROM co) ON spearman, pearson, kendall, point_biserial INTO NAME method VALUE v)
"""


@query(_CORR + "SELECT query_idx, n, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman, round(point_biserial, 6) + 0.0 AS point_biserial, round(kendall, 6) + 0.0 AS kendall FROM co")
def per_query_correlation(s: DataFrame) -> DataFrame:
    c = R.correlations(s)
    return c.select("query_idx", "n", *(r6(F.col(m)).alias(m) for m in ("pearson", "spearman", "point_biserial", "kendall")))


@query(_CORR + """SELECT method, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(avg(v), 6) + 0.0 AS mean, round(avg((v < 0)::INT) * 100, 6) AS pct_negative,
round(avg((v > 0)::INT) * 100, 6) AS pct_positive, CASE WHEN method = 'point_biserial' THEN 'positive' ELSE 'negative' END AS expected_sign FROM lc GROUP BY method""")
def correlation_summary(s: DataFrame) -> DataFrame:
    v, sign = F.col("value"), F.create_map(*(F.lit(x) for kv in R.METHODS.items() for x in kv))
    out = R.long_correlations(s).filter("value is not null").groupBy("method").agg(
        r6(F.percentile(v, F.lit(0.5))).alias("median"), r6(F.avg(v)).alias("mean"), r6(F.avg((v < 0).cast("int")) * 100).alias("pct_negative"), r6(F.avg((v > 0).cast("int")) * 100).alias("pct_positive"),
    )
    return out.withColumn("expected_sign", sign[F.col("method")])


@query()
def correlation_significance(s: DataFrame) -> DataFrame:
    """Share of queries with p < 0.05; SQL has no incomplete beta function."""
    p = R.with_p_values(R.long_correlations(s))
    return p.filter("value is not null").groupBy("method").agg(r6(F.avg((F.col("p") < 0.05).cast("int")) * 100).alias("pct_sig_p05"), F.count("*").alias("n_queries"))


@query(_CORR + """SELECT count(*) AS n, round(avg(spearman), 6) AS mean, round(quantile_cont(spearman, 0.5), 6) AS median, round(stddev_samp(spearman), 6) AS std,
arg_min(query_idx, (spearman, query_idx)) AS lowest_query, arg_max(query_idx, (spearman, -query_idx)) AS highest_query FROM co""")
def spearman_overview(s: DataFrame) -> DataFrame:
    c = R.correlations(s).filter("spearman is not null")
    x = F.col("spearman")
    low, high = F.min_by("query_idx", F.struct("spearman", "query_idx")), F.max_by("query_idx", F.struct(x, -F.col("query_idx")))
    return c.agg(F.count("*").alias("n"), r6(F.avg(x)).alias("mean"), r6(F.percentile(x, F.lit(0.5))).alias("median"), r6(F.stddev_samp(x)).alias("std"), low.alias("lowest_query"), high.alias("highest_query"))


@query(" UNION ALL ".join(f"SELECT {k} AS K, count(*) FILTER (rank_min <= {k}) AS recovered, count(*) AS total, round(count(*) FILTER (rank_min <= {k}) * 100.0::DOUBLE / count(*), 6) AS recovery_rate_pct FROM pq" for k in (1, 3, 5, 10, 20, 50, 100, 200)))
def llm_recovery_at_k(s: DataFrame) -> DataFrame:
    rows = R.per_query(s).select("rank_min", F.explode(F.array(*map(F.lit, (1, 3, 5, 10, 20, 50, 100, 200)))).alias("K"))
    hit = F.sum((F.col("rank_min") <= F.col("K")).cast("long"))
    return rows.groupBy("K").agg(hit.alias("recovered"), F.count("*").alias("total"), r6(hit * 100.0 / F.count("*")).alias("recovery_rate_pct"))


@query(_CORR + """SELECT side, place::INT AS place, query_idx, round(spearman, 6) + 0.0 AS spearman FROM (
SELECT 'lowest' AS side, row_number() OVER (ORDER BY spearman, query_idx) AS place, * FROM co WHERE spearman IS NOT NULL UNION ALL
SELECT 'highest', row_number() OVER (ORDER BY spearman DESC, query_idx), * FROM co WHERE spearman IS NOT NULL) WHERE place <= 5""")
def spearman_extremes(s: DataFrame) -> DataFrame:
    """The five queries of least and of most correlation."""
    c = R.correlations(s).filter("spearman is not null")
    ends = (("lowest", F.col("spearman")), ("highest", F.desc("spearman")))
    w = Window.orderBy
    return union([c.select(F.lit(n).alias("side"), F.row_number().over(w(o, "query_idx")).alias("place"), "query_idx", (r6(F.col("spearman")) + 0.0).alias("spearman")).filter("place <= 5") for n, o in ends])


@query("""SELECT CASE WHEN is_gt = 1 THEN 'GT' ELSE 'non-GT' END AS "group", count(*) AS count, round(avg(llm_score), 6) AS mean, round(quantile_cont(llm_score, 0.5), 6) AS median,
round(stddev_samp(llm_score), 6) AS std, round(quantile_cont(llm_score, 0.25), 6) AS p25, round(quantile_cont(llm_score, 0.75), 6) AS p75, round(quantile_cont(llm_score, 0.9), 6) AS p90,
round(quantile_cont(llm_score, 0.99), 6) AS p99 FROM results GROUP BY 1""")
def score_distribution(s: DataFrame) -> DataFrame:
    rows = s.filter("llm_score is not null").withColumn("group", F.when(F.col("is_gt") == 1, "GT").otherwise("non-GT"))
    out = R.level_statistics(rows, "group", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p99": 0.99})
    return out.select("group", "count", *(r6(F.col(c)).alias(c) for c in ("mean", "median", "std", "p25", "p75", "p90", "p99")))


@query(metrics_sql({"median": "quantile_cont(gt_rank_pct, 0.5)"} | {f"pct_ge_{k}": f"avg((gt_rank_pct >= {k})::INT) * 100" for k in (50, 75, 90)}, "pq"))
def gt_percentile_summary(s: DataFrame) -> DataFrame:
    x = F.col("gt_rank_pct")
    return metrics(R.per_query(s), median=F.percentile(x, F.lit(0.5)), **{f"pct_ge_{k}": F.avg((x >= k).cast("int")) * 100 for k in (50, 75, 90)})


@query("""SELECT 'ROC_AUC' AS metric, round(sum(n_gt * ((n - p) - (kept - tp) + (n_docs - n_gt) / 2.0::DOUBLE) / (p::DOUBLE * (n - p))), 6) AS value FROM cum
UNION ALL SELECT 'average_precision', round(sum(n_gt::DOUBLE / p * tp / kept), 6) FROM cum UNION ALL SELECT 'baseline', round(max(p)::DOUBLE / max(n), 6) FROM cum""")
def roc_pr_summary(s: DataFrame) -> DataFrame:
    n, p, kept, tp, g = (F.col(c).cast("double") for c in ("n", "p", "kept", "tp", "n_gt"))
    auc = F.sum(g * ((n - p) - (kept - tp) + (F.col("n_docs") - g) / 2) / (p * (n - p)))
    return metrics(R.cumulative(s), ROC_AUC=auc, average_precision=F.sum(g / p * tp / kept), baseline=F.max(p) / F.max(n))


@query("""SELECT llm_score AS threshold, round((kept - tp)::DOUBLE / (n - p), 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr, round(tp::DOUBLE / kept, 6) AS prec FROM cum""")
def roc_pr_curve(s: DataFrame) -> DataFrame:
    c = R.cumulative(s)
    return c.select(F.col("llm_score").alias("threshold"), r6((F.col("kept") - F.col("tp")) / (F.col("n") - F.col("p"))).alias("fpr"), r6(F.col("tp") / F.col("p")).alias("tpr"), r6(F.col("tp") / F.col("kept")).alias("prec"))


@query("""SELECT llm_score AS threshold, kept::BIGINT AS n_docs_kept, round(kept::DOUBLE / (SELECT count(DISTINCT query_idx) FROM results), 6) AS avg_pool_size,
round(tp::DOUBLE / kept, 6) AS precision, round(tp::DOUBLE / p, 6) AS recall,
round(CASE WHEN tp > 0 THEN 2 * (tp::DOUBLE / kept) * (tp::DOUBLE / p) / (tp::DOUBLE / kept + tp::DOUBLE / p) ELSE 0 END, 6) AS f1 FROM cum""")
def threshold_filter_analysis(s: DataFrame) -> DataFrame:
    pr, rc = F.col("tp") / F.col("kept"), F.col("tp") / F.col("p")
    c = R.cumulative(s).crossJoin(F.broadcast(s.agg(F.countDistinct("query_idx").alias("nq"))))  # one row
    f1 = F.when(F.col("tp") > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)
    return c.select(F.col("llm_score").alias("threshold"), F.col("kept").alias("n_docs_kept"), r6(F.col("kept") / F.col("nq")).alias("avg_pool_size"), r6(pr).alias("precision"), r6(rc).alias("recall"), r6(f1).alias("f1"))


@query("SELECT llm_score AS score, n_docs, n_gt, round(n_gt::DOUBLE / n_docs, 6) AS gt_fraction, round(mean_dist, 6) AS mean_dist, round(median_dist, 6) AS median_dist, round(p10_dist, 6) AS p10_dist, round(p90_dist, 6) AS p90_dist FROM lv")
def score_level_breakdown(s: DataFrame) -> DataFrame:
    dists = (r6(F.col(c)).alias(c) for c in ("mean_dist", "median_dist", "p10_dist", "p90_dist"))
    return R.levels(s).select(F.col("llm_score").alias("score"), "n_docs", "n_gt", r6(F.col("n_gt") / F.col("n_docs")).alias("gt_fraction"), *dists)


_EDGES = ", ".join(f"quantile_cont(dist_to_gt, {k / 10}) AS e{k}" for k in range(11))


@query(f""", e AS (SELECT {_EDGES} FROM results),
b AS (SELECT r.*, CASE {" ".join(f"WHEN dist_to_gt <= e{k} THEN {k - 1}" for k in range(1, 11))} END AS dist_bin FROM results r, e)
SELECT dist_bin, round(avg(llm_score), 6) AS mean, round(quantile_cont(llm_score, 0.5), 6) AS median, round(stddev_samp(llm_score), 6) AS std, count(*) AS count FROM b GROUP BY dist_bin""")
def distance_quantile_analysis(s: DataFrame) -> DataFrame:
    """Scores by distance decile: edges by linear interpolation, bins closed on the right, the first on both sides; equal edges make one bin."""
    edges = quantiles(s, [], "dist_to_gt", [k / 10 for k in range(11)]).select(F.array_distinct("q").alias("e"))
    rows = s.crossJoin(F.broadcast(edges))  # one row
    which = F.greatest(F.lit(0), F.array_size(F.filter("e", lambda x: x < F.col("dist_to_gt"))) - 1)
    out = R.level_statistics(rows.select("llm_score", "e", which.alias("dist_bin")), "dist_bin", {"median": 0.5})
    return out.select("dist_bin", *(r6(F.col(c)).alias(c) for c in ("mean", "median", "std")), "count")


_JAC = """, rkd AS (SELECT query_idx, doc_id, row_number() OVER (PARTITION BY query_idx ORDER BY dist_to_gt, doc_id) AS rd,
row_number() OVER (PARTITION BY query_idx ORDER BY llm_score DESC, doc_id) AS rs FROM results),
jac AS (SELECT query_idx, K, count(*) FILTER (rd <= K AND rs <= K)::DOUBLE / count(*) FILTER (rd <= K OR rs <= K) AS j FROM rkd, (VALUES (5), (10), (20), (50), (100)) x(K) GROUP BY query_idx, K)
"""


@query(_JAC + "SELECT query_idx, K, round(j, 6) AS jaccard FROM jac")
def topk_jaccard(s: DataFrame) -> DataFrame:
    return R.jaccard(s).select("query_idx", "K", r6(F.col("jaccard")).alias("jaccard"))


@query(_JAC + """SELECT K, count(*) AS count, round(avg(j), 6) AS mean, round(stddev_samp(j), 6) AS std, round(min(j), 6) AS min, round(quantile_cont(j, 0.25), 6) AS p25,
round(quantile_cont(j, 0.5), 6) AS p50, round(quantile_cont(j, 0.75), 6) AS p75, round(max(j), 6) AS max FROM jac GROUP BY K""")
def topk_jaccard_summary(s: DataFrame) -> DataFrame:
    x = F.col("jaccard")
    ps = (r6(F.percentile(x, F.lit(k / 100))).alias(f"p{k}") for k in (25, 50, 75))
    return R.jaccard(s).groupBy("K").agg(F.count("*").alias("count"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"), r6(F.min(x)).alias("min"), *ps, r6(F.max(x)).alias("max"))


@query(metrics_sql({"pct_positive": "avg((gt_score - best_ngt > 0)::INT) * 100", "pct_zero": "avg((gt_score - best_ngt = 0)::INT) * 100", "mean_gap": "avg(gt_score - best_ngt)", "median_gap": "quantile_cont(gt_score - best_ngt, 0.5)"}, "pq"))
def score_gap_summary(s: DataFrame) -> DataFrame:
    x = F.col("score_gap")
    return metrics(R.per_query(s), pct_positive=F.avg((x > 0).cast("int")) * 100, pct_zero=F.avg((x == 0).cast("int")) * 100, mean_gap=F.avg(x), median_gap=F.percentile(x, F.lit(0.5)))


@query("SELECT query_idx, gt_score, n_tied AS n_tied_at_gt, n_above AS n_above_gt, n_docs, round(1.0::DOUBLE / n_tied, 6) AS tier_precision, (n_above = 0 AND n_tied = 1)::INT AS gt_uniquely_top FROM pq")
def tie_structure(s: DataFrame) -> DataFrame:
    unique = ((F.col("n_above") == 0) & (F.col("n_tied") == 1)).cast("int")
    return R.per_query(s).select("query_idx", "gt_score", F.col("n_tied").alias("n_tied_at_gt"), F.col("n_above").alias("n_above_gt"), "n_docs", r6(1 / F.col("n_tied")).alias("tier_precision"), unique.alias("gt_uniquely_top"))


@query("SELECT query_idx, gt_score, n_at_top, difficulty FROM pq")
def query_difficulty(s: DataFrame) -> DataFrame:
    return R.per_query(s).select("query_idx", "gt_score", "n_at_top", "difficulty")


@query("SELECT x.d AS difficulty, count(query_idx) AS n FROM (VALUES ('EASY'), ('MEDIUM'), ('HARD'), ('FAILED')) x(d) LEFT JOIN pq ON difficulty = x.d GROUP BY 1")
def difficulty_counts(s: DataFrame) -> DataFrame:
    """All four tiers, with 0 for those without queries."""
    tiers = s.sparkSession.createDataFrame([(t,) for t in ("EASY", "MEDIUM", "HARD", "FAILED")], "difficulty string")
    return tiers.join(R.per_query(s).groupBy("difficulty").agg(F.count("*").alias("n")), "difficulty", "left").select("difficulty", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT query_idx, gt_score AS gt_llm_score, gt_dist AS gt_dist_to_gt, n_above AS n_docs_above_gt, rank_min AS gt_rank, max_score AS max_score_in_query,
(SELECT count(*) FROM results r WHERE r.query_idx = pq.query_idx AND r.llm_score = pq.max_score) AS n_docs_at_max, n_docs AS n_docs_total FROM pq WHERE gt_score < 1.0""")
def failure_cases(s: DataFrame) -> DataFrame:
    at = s.groupBy("query_idx", "llm_score").agg(F.count("*").alias("c")).groupBy("query_idx").agg(F.max_by("c", "llm_score").alias("n_docs_at_max"))
    f = R.per_query(s).filter("gt_score < 1.0").join(at, "query_idx")
    return f.select("query_idx", F.col("gt_score").alias("gt_llm_score"), F.col("gt_dist").alias("gt_dist_to_gt"), F.col("n_above").alias("n_docs_above_gt"), F.col("rank_min").alias("gt_rank"), F.col("max_score").alias("max_score_in_query"), "n_docs_at_max", F.col("n_docs").alias("n_docs_total"))


_GROUP = "CASE WHEN is_gt = 1 AND llm_score = 1.0 THEN 'GT (score=1.0)' WHEN is_gt = 0 AND llm_score = 1.0 THEN 'non-GT (score=1.0)' WHEN is_gt = 0 AND llm_score = 0.1 THEN 'non-GT (score=0.1)' END"


@query(f"""SELECT {_GROUP} AS "group", count(*) AS count, round(avg(dist_to_gt), 6) AS mean_dist, round(quantile_cont(dist_to_gt, 0.5), 6) AS median_dist,
round(quantile_cont(dist_to_gt, 0.1), 6) AS p10_dist, round(quantile_cont(dist_to_gt, 0.9), 6) AS p90_dist FROM results WHERE {_GROUP} IS NOT NULL GROUP BY 1""")
def false_positive_analysis(s: DataFrame) -> DataFrame:
    rows = s.withColumn("group", F.expr(_GROUP)).filter("group is not null")
    dists = (r6(F.col(c)).alias(c) for c in ("mean_dist", "median_dist", "p10_dist", "p90_dist"))
    return R.dist_quantiles(rows, "group").select("group", F.col("n_docs").alias("count"), *dists)


@query("""SELECT query_idx, gt_dist, round(mean_ngt_dist, 6) AS mean_ngt_dist, min_ngt_dist, n_at_top AS n_in_tier, round(n_further * 100.0::DOUBLE / n_top_ngt, 6) AS pct_ngt_further,
(gt_dist <= min_ngt_dist)::INT AS gt_would_win_dist FROM pq WHERE gt_score = 1.0 AND n_top_ngt > 0""")
def within_tier_dist(s: DataFrame) -> DataFrame:
    """Breaking top-tier ties by distance to the answer itself: an oracle's bound, as no ranker knows that distance."""
    q = R.per_query(s).filter("n_top_gt > 0 and n_top_ngt > 0")
    return q.select("query_idx", "gt_dist", r6(F.col("mean_ngt_dist")).alias("mean_ngt_dist"), "min_ngt_dist", F.col("n_at_top").alias("n_in_tier"), r6(F.col("n_further") * 100.0 / F.col("n_top_ngt")).alias("pct_ngt_further"), (F.col("gt_dist") <= F.col("min_ngt_dist")).cast("int").alias("gt_would_win_dist"))


@query("""SELECT llm_score AS score, count(*) AS n_docs, round(avg(dist_to_gt), 6) AS mean_dist, round(quantile_cont(dist_to_gt, 0.5), 6) AS median_dist,
round((SELECT avg(dist_to_gt) FROM results WHERE is_gt = 0 AND llm_score = 0.1) - avg(dist_to_gt), 6) + 0.0 AS improvement_vs_01
FROM results WHERE is_gt = 0 AND llm_score IN (0.1, 0.2, 0.4, 0.6, 0.8, 1.0) GROUP BY 1""")
def marginal_score_value(s: DataFrame) -> DataFrame:
    rows = R.dist_quantiles(s.filter((F.col("is_gt") == 0) & F.col("llm_score").isin(0.1, 0.2, 0.4, 0.6, 0.8, 1.0)), "llm_score")
    base = F.max(F.when(F.col("llm_score") == 0.1, F.col("mean_dist"))).over(Window.partitionBy())  # a row a level
    return rows.select(F.col("llm_score").alias("score"), "n_docs", r6(F.col("mean_dist")).alias("mean_dist"), r6(F.col("median_dist")).alias("median_dist"), r6(base - F.col("mean_dist")).alias("improvement_vs_01"))


@query("""SELECT query_idx, gt_score, rank_min AS gt_llm_rank, n_tied AS n_tied_at_gt, difficulty, round(gt_score - best_ngt, 6) AS score_gap, round(gt_rank_pct, 6) AS gt_rank_pct,
(gt_dist <= min_ngt_dist)::INT::DOUBLE AS gt_would_win_dist FROM pq""")
def per_query_overview(s: DataFrame) -> DataFrame:
    """All per-query results side by side, from the one aggregate that holds them."""
    win = F.when(F.col("min_ngt_dist").isNotNull(), (F.col("gt_dist") <= F.col("min_ngt_dist")).cast("double"))
    return R.per_query(s).select("query_idx", "gt_score", F.col("rank_min").alias("gt_llm_rank"), F.col("n_tied").alias("n_tied_at_gt"), "difficulty", r6(F.col("score_gap")).alias("score_gap"), r6(F.col("gt_rank_pct")).alias("gt_rank_pct"), win.alias("gt_would_win_dist"))


@query("SELECT rank_min, round(cume_dist() OVER (ORDER BY rank_min), 6) AS cdf FROM pq")
def rank_cdf(s: DataFrame) -> DataFrame:
    return R.per_query(s).select("rank_min", r6(F.cume_dist().over(Window.orderBy("rank_min"))).alias("cdf"))


@query("""SELECT count(*) AS total_rows, count(llm_score) AS scored_rows, count(*) - count(llm_score) AS null_score_rows, round(count(llm_score) * 100.0::DOUBLE / count(*), 6) AS sync_pct,
count(DISTINCT query_idx) AS n_queries_in_db, count(DISTINCT query_idx) FILTER (llm_score IS NOT NULL) AS n_queries_scored, count(DISTINCT doc_id) AS unique_docs_in_pool,
(SELECT min(n) FROM (SELECT count(*) n FROM raw GROUP BY query_idx)) AS pool_size_min, (SELECT max(n) FROM (SELECT count(*) n FROM raw GROUP BY query_idx)) AS pool_size_max,
(SELECT quantile_cont(n, 0.5)::DOUBLE FROM (SELECT count(*) n FROM raw GROUP BY query_idx)) AS pool_size_median,
(SELECT count(*) FROM (SELECT query_idx FROM raw GROUP BY query_idx HAVING count(*) > count(llm_score))) AS n_queries_with_nulls FROM raw""", raw)
def run_health(s: DataFrame) -> DataFrame:
    by = s.groupBy("query_idx").agg(F.count("*").alias("n"), F.count("llm_score").alias("k"))
    docs = s.agg(F.countDistinct("doc_id").alias("unique_docs_in_pool"))
    one = by.agg(
        F.sum("n").alias("total_rows"), F.sum("k").alias("scored_rows"), (F.sum("n") - F.sum("k")).alias("null_score_rows"), r6(F.sum("k") * 100.0 / F.sum("n")).alias("sync_pct"),
        F.count("*").alias("n_queries_in_db"), F.sum((F.col("k") > 0).cast("long")).alias("n_queries_scored"), F.min("n").alias("pool_size_min"), F.max("n").alias("pool_size_max"),
        F.percentile("n", F.lit(0.5)).alias("pool_size_median"), F.sum((F.col("n") > F.col("k")).cast("long")).alias("n_queries_with_nulls"),
    )
    return one.crossJoin(F.broadcast(docs))  # one row each


@query("""SELECT r.query_idx, doc_id, llm_score AS imp_score, gt_score, round(llm_score - coalesce(gt_score, 0), 6) + 0.0 AS score_diff, dist_to_gt AS imp_dist, gt_dist, r.rag_failed
FROM results r LEFT JOIN truth USING (query_idx) WHERE is_gt = 0 AND llm_score >= 0.5 ORDER BY round(llm_score - coalesce(gt_score, 0), 6) DESC, llm_score DESC, r.query_idx, doc_id LIMIT 30""")
def top_imposters(s: DataFrame) -> DataFrame:
    rows = s.filter("is_gt = 0 and llm_score >= 0.5").join(R.truth(s), "query_idx", "left")
    rows = rows.withColumn("score_diff", r6(F.col("llm_score") - F.coalesce("gt_score", F.lit(0.0))))
    rows = rows.select("query_idx", "doc_id", F.col("llm_score").alias("imp_score"), "gt_score", "score_diff", F.col("dist_to_gt").alias("imp_dist"), "gt_dist", "rag_failed")
    return rows.orderBy(F.desc("score_diff"), F.desc("imp_score"), "query_idx", "doc_id").limit(30)


@query("SELECT count(*) AS n_imposters FROM results r JOIN truth g ON r.query_idx = g.query_idx AND r.llm_score >= g.gt_score WHERE is_gt = 0")
def imposter_count(s: DataFrame) -> DataFrame:
    return s.filter("is_gt = 0").join(R.truth(s).select(F.col("query_idx").alias("q"), "gt_score"), (F.col("query_idx") == F.col("q")) & (F.col("llm_score") >= F.col("gt_score"))).agg(F.count("*").alias("n_imposters"))


@query("SELECT query_idx, count(*) AS zeros FROM raw WHERE llm_score = 0.0 GROUP BY query_idx ORDER BY zeros DESC, query_idx LIMIT 15", raw)
def zero_score_hotspots(s: DataFrame) -> DataFrame:
    return s.filter("llm_score = 0.0").groupBy("query_idx").agg(F.count("*").alias("zeros")).orderBy(F.desc("zeros"), "query_idx").limit(15)


@query("SELECT llm_score, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM raw WHERE llm_score IS NOT NULL GROUP BY 1", raw)
def score_histogram(s: DataFrame) -> DataFrame:
    g = s.filter("llm_score is not null").groupBy("llm_score").agg(F.count("*").alias("n"))
    return g.withColumn("pct", r6(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())))


@query("""SELECT round(gt_score * 10)::INT AS level, count(*) AS n, count(*) FILTER (gt_score >= 0.8) AS high, count(*) FILTER (gt_score <= 0.3) AS low FROM truth GROUP BY 1""")
def gt_score_distribution(s: DataFrame) -> DataFrame:
    x = F.col("gt_score")
    return R.truth(s).groupBy(F.round(x * 10).cast("int").alias("level")).agg(F.count("*").alias("n"), F.sum((x >= 0.8).cast("long")).alias("high"), F.sum((x <= 0.3).cast("long")).alias("low"))


@query("""SELECT count(*) AS total, count(llm_score) AS scored, count(*) FILTER (llm_score = 0.0) AS zeros, count(*) FILTER (llm_score IS NULL) AS pending,
count(DISTINCT query_idx) FILTER (llm_score IS NOT NULL) AS queries_synced, sum(is_gt)::BIGINT AS n_gt, count(DISTINCT query_idx) FILTER (rag_failed = 1) AS rag_failed_queries FROM raw""", raw)
def score_overview(s: DataFrame) -> DataFrame:
    x = F.col("llm_score")
    n = lambda c: F.sum(c.cast("long"))
    return s.agg(F.count("*").alias("total"), F.count(x).alias("scored"), n(F.coalesce(x == 0.0, F.lit(False))).alias("zeros"), n(x.isNull()).alias("pending"), F.countDistinct(F.when(x.isNotNull(), F.col("query_idx"))).alias("queries_synced"), n(F.col("is_gt")).alias("n_gt"), F.countDistinct(F.when(F.col("rag_failed") == 1, F.col("query_idx"))).alias("rag_failed_queries"))


@query("SELECT query_idx, doc_id, llm_score, gt_score, round(llm_score - gt_score, 2) + 0.0 AS delta FROM ann WHERE is_gt = 0 AND llm_score >= gt_score")
def relevance_failures(s: DataFrame) -> DataFrame:
    rows = R.annotated(s).filter("is_gt = 0 and llm_score >= gt_score")
    return rows.select("query_idx", "doc_id", "llm_score", "gt_score", (F.round(F.col("llm_score") - F.col("gt_score"), 2) + 0.0).alias("delta"))


@query("SELECT count(*) AS n, round(corr(llm_score, dist_to_gt), 6) AS pearson FROM results")
def pooled_score_distance(s: DataFrame) -> DataFrame:
    return s.filter("llm_score is not null").agg(F.count("*").alias("n"), r6(R.correlation("llm_score", "dist_to_gt")).alias("pearson"))


@query("SELECT count(*) AS n_queries, round(avg(gt_rag::DOUBLE) * 100, 6) AS rag_fail_pct, round(avg((rank_min = 1)::INT::DOUBLE) * 100, 6) AS accuracy_at_1, round(avg(gt_dist), 6) AS mean_gt_dist, round(max(gt_dist), 6) AS max_gt_dist FROM pq")
def report_kpis(s: DataFrame) -> DataFrame:
    return R.per_query(s).agg(F.count("*").alias("n_queries"), r6(F.avg("gt_rag_failed") * 100).alias("rag_fail_pct"), r6(F.avg((F.col("rank_min") == 1).cast("double")) * 100).alias("accuracy_at_1"), r6(F.avg("gt_dist")).alias("mean_gt_dist"), r6(F.max("gt_dist")).alias("max_gt_dist"))


_flat = {"MRR": "avg(1.0::DOUBLE / rank_min)"} | {f"P@{k}": f"avg((rank_min <= {k})::INT::DOUBLE)" for k in (1, 3, 5, 10, 20, 50, 100)}


@query(metrics_sql(_flat, "pq"))
def mrr_and_precision_at_k(s: DataFrame) -> DataFrame:
    """By the best place among ties."""
    r = F.col("rank_min")
    return metrics(R.per_query(s), MRR=F.avg(1 / r), **{f"P@{k}": F.avg((r <= k).cast("double")) for k in (1, 3, 5, 10, 20, 50, 100)})


_tier = "CASE WHEN gt_score = 1.0 AND n_top_ngt > 0 THEN (gt_dist <= min_ngt_dist)::INT END"
_bundle = {
    "n_queries": "count(*)", "gt_in_top": "count(*) FILTER (n_above = 0)", "med_tied": "quantile_cont(n_tied, 0.5) FILTER (n_above = 0)", "rec_1": "avg((rank_min = 1)::INT) * 100",
    "mrr_opt": "avg(1.0::DOUBLE / rank_min)", "mrr_corr": "avg(1.0::DOUBLE / rank_avg)", "wr_within": f"avg({_tier}) * 100", "wr_overall": f"sum({_tier}) * 100.0::DOUBLE / count(*)", "rag_fail_pct": "avg(gt_rag) * 100",
}
_at_top = {"thresh_precision": "max(tp::DOUBLE / kept) * 100", "thresh_recall": "max(tp::DOUBLE / p) * 100"}
_auc = {"roc_auc": "sum(n_gt * ((n - p) - (kept - tp) + (n_docs - n_gt) / 2.0::DOUBLE) / (p * (n - p))::DOUBLE)"}


@query(" UNION ALL ".join((metrics_sql(_bundle, "pq"), metrics_sql(_at_top, "cum WHERE llm_score = 1.0"), metrics_sql(_auc, "cum"))))
def report_bundle(s: DataFrame) -> DataFrame:
    """The report's twelve figures."""
    above, r = F.col("n_above") == 0, F.col("rank_min")
    won = F.when((F.col("n_top_gt") > 0) & (F.col("n_top_ngt") > 0), (F.col("gt_dist") <= F.col("min_ngt_dist")).cast("int"))
    queries = metrics(
        R.per_query(s), n_queries=F.count("*").cast("double"), gt_in_top=F.count_if(above).cast("double"), med_tied=F.percentile(F.when(above, F.col("n_tied")), F.lit(0.5)), rec_1=F.avg((r == 1).cast("int")) * 100,
        mrr_opt=F.avg(1 / r), mrr_corr=F.avg(1 / F.col("rank_avg")), wr_within=F.avg(won) * 100, wr_overall=F.sum(won) * 100.0 / F.count("*"), rag_fail_pct=F.avg("gt_rag_failed") * 100,
    )
    top = R.cumulative(s).filter("llm_score = 1.0")
    kept = metrics(top, thresh_precision=F.max(F.col("tp") / F.col("kept")) * 100, thresh_recall=F.max(F.col("tp") / F.col("p")) * 100)
    auc = roc_pr_summary(s).filter("metric = 'ROC_AUC'").select(F.lit("roc_auc").alias("metric"), "value")
    return union([queries, kept, auc])
