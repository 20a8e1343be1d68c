"""The analysis of a stored run as a command.

``python -m rankfold.analysis [--run-dir RUN | --runs ROOT | --results FACTS] [--out FOLDER] [--steps base,extended,report]``

A run's folder holds ``results`` (query_idx, doc_id, llm_score, dist_to_gt, is_gt, rag_failed) and may hold ``meta``
(key, value) and ``skipped`` (query_idx, reason), all Parquet. ROOT has the folders of many runs, of which the last by
name is analysed. Each step writes CSV folders under csv/global and csv/per_query of FOLDER, by default RUN/analysis,
over those of an earlier call. run_health.json tells whether the run is whole, and INDEX.md names what there is.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import storing
from rankfold.artifacts import ARTIFACTS
from rankfold.plans import analytics
from rankfold.sources.readers import is_true, read_meta
from rankfold.sources.writers import write_artifact

FACT = "query_idx long, doc_id string, llm_score double, dist_to_gt double, is_gt int, rag_failed int"
STAGED = "staged_run_"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """All facts of a stored run, pending and blocked ones too; a missing column is an error."""
    rows = spark.read.parquet(path)
    return rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in FACT.split(", ")))


def latest_run(spark: SparkSession, root: str) -> str:
    """The last run by name that has results: of the staged ones if there are any, else of all."""
    runs = [n for n in storing.names(spark, root) if storing.exists(spark, f"{root}/{n}/results")]
    staged = [n for n in runs if n.startswith(STAGED)]
    if not runs:
        raise FileNotFoundError(f"no run with results under {root}")
    return f"{root}/{(staged or runs)[-1]}"


def find_artifact(spark: SparkSession, root: str, name: str) -> str:
    """Where an artifact of an analysis is: csv/global, csv/per_query, or, of an old analysis, the folder itself; the first if nowhere."""
    per_query = any(name == n.split("/")[1] for named in ARTIFACTS.values() for n in named if n.startswith("per_query/"))
    places = [f"{root}/csv/{'per_query' if per_query else 'global'}/{name}", f"{root}/{name}", f"{root}/{name}.csv"]
    return next((p for p in places if storing.exists(spark, p)), places[0])


def parse_steps(steps: str | None) -> list[str]:
    """The steps named, each once, in the order given; all for None, '', 'all' or '*'."""
    names = list(dict.fromkeys(x.strip().lower() for x in (steps or "").split(",") if x.strip()))
    if not names or names in (["all"], ["*"]):
        return list(ARTIFACTS)
    unknown = [n for n in names if n not in ARTIFACTS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; there are {list(ARTIFACTS)}")
    return names


def pending_queries(facts: DataFrame) -> DataFrame:
    """(query_idx, null_scores) of queries with pairs that have no score yet."""
    return facts.groupBy("query_idx").agg(F.count_if(F.col("llm_score").isNull()).alias("null_scores")).filter("null_scores > 0").orderBy("query_idx")


def run_health(facts: DataFrame, meta: dict[str, str], n_skipped: int) -> dict:
    """Counts of a run, whether it is whole, and what stands against that. A pool is full if it is as large as the largest."""
    told = {k: v or 0 for k, v in analytics.RAW_PLANS["run_health"](facts).first().asDict().items()}
    sizes = facts.groupBy("query_idx").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("queries"))
    full = sizes.agg(F.max_by("queries", "n").alias("q")).first()["q"] or 0
    partial = told["n_queries_in_db"] - full
    done, fatal, at = is_true(meta.get("main_loop_completed")), meta.get("fatal_llm_error"), meta.get("fatal_llm_error_query_idx")
    stage, number = meta.get("staging_last_completed_stage"), lambda x: int(x) if x and x.isdigit() else None
    warnings = []
    if not done:
        warnings.append("the main loop did not complete")
    if fatal:
        warnings.append(f"a fatal scorer error{f' at query {at}' if at else ''}: {fatal[:120]}{'…' if len(fatal) > 120 else ''}")
    if told["null_score_rows"]:
        warnings.append(f"{told['null_score_rows']:,} pairs of {told['n_queries_with_nulls']} queries have no score")
    if n_skipped:
        warnings.append(f"{n_skipped} queries were skipped")
    if partial:
        warnings.append(f"{partial} of {told['n_queries_in_db']} queries have a smaller pool than the largest, of {told['pool_size_max']:,}")
    if not told["total_rows"]:
        told["sync_pct"] = 100.0
    return {
        **told, "loop_completed": done, "is_complete": done and not told["null_score_rows"] and not n_skipped and not partial, "fatal_error": fatal, "fatal_error_query_idx": number(at),
        "staging_last_completed_stage": number(stage), "n_skipped": n_skipped, "n_queries_full_pool": full, "n_queries_partial_pool": partial, "warnings": warnings,
    }


def analyse(spark: SparkSession, results: str, out: str, steps: str | None = None, meta: str | None = None, skipped: str | None = None) -> list[str]:
    """Write the artifacts of the steps under ``out``; returns their names. The facts are read once and kept in the executors' cache meanwhile."""
    facts = read_facts(spark, results).cache()
    scored, done = facts.filter("llm_score is not null"), []
    left_out = spark.read.parquet(skipped) if skipped else None
    try:
        health = run_health(facts, read_meta(spark.read.parquet(meta)) if meta else {}, left_out.count() if skipped else 0)
        for step in parse_steps(steps):
            for name, plan in ARTIFACTS[step].items():
                write_artifact(plan(scored), f"{out}/csv/{name}")
                done.append(name)
        write_artifact(pending_queries(facts), f"{out}/csv/per_query/queries_with_null_scores")
        if skipped:
            write_artifact(left_out.select("query_idx", "reason").orderBy("query_idx"), f"{out}/csv/per_query/skipped_queries")
    finally:
        facts.unpersist()
    storing.put(spark, f"{out}/run_health.json", json.dumps(health, indent=2))
    lines = ["# Analysis", "", f"Queries scored: {health['n_queries_scored']} of {health['n_queries_in_db']}; pairs scored: {health['sync_pct']} %; whole: {'yes' if health['is_complete'] else 'no'}", ""]
    lines += [*(f"* {w}" for w in health["warnings"]), "", "| step | table |", "|-|-|"]
    lines += [f"| {step} | csv/{name} |" for step, named in ARTIFACTS.items() for name in named if storing.exists(spark, f"{out}/csv/{name}")]
    storing.put(spark, f"{out}/INDEX.md", "\n".join(lines) + "\n")
    return done


def analyse_run(spark: SparkSession, run: str, out: str | None = None, steps: str | None = None) -> list[str]:
    """``analyse`` of a run's folder."""
    if not storing.exists(spark, f"{run}/results"):
        raise FileNotFoundError(f"{run} has no results")
    more = {n: f"{run}/{n}" for n in ("meta", "skipped") if storing.exists(spark, f"{run}/{n}")}
    return analyse(spark, f"{run}/results", out or f"{run}/analysis", steps, **more)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Analyse a stored run")
    where = parser.add_mutually_exclusive_group(required=True)
    where.add_argument("--run-dir", help="a run's folder")
    where.add_argument("--runs", help="a folder of runs, of which the last is taken")
    where.add_argument("--results", help="a table of facts")
    parser.add_argument("--out", help="by default the run's folder analysis")
    parser.add_argument("--steps")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.results:
        if not given.out:
            parser.error("--results needs --out")
        done = analyse(spark, given.results, given.out, given.steps)
    else:
        done = analyse_run(spark, given.run_dir or latest_run(spark, given.runs), given.out, given.steps)
    print("\n".join(done))


if __name__ == "__main__":
    main()
