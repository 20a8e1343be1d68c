"""Manifests and streams that are cut short, changed, repeated and restarted."""

import json

import pytest
from pyspark.sql import functions as F

from rankfold import storing
from rankfold.operators import manifest as M
from rankfold.operators import runs as R
from rankfold.operators import sync as S
from rankfold.streaming import facts as T

SPEC = M.Spec(2, 2, 5, 5)


def tables(spark, n=11):
    truths = spark.createDataFrame([(1, "p3", "one?"), (2, "t2", None)], "query_idx long, doc_id string, question string")
    return truths, spark.createDataFrame([(f"p{i}", i) for i in range(1, n + 1)], "doc_id string, pool_pos long")


def test_a_manifest_is_written_once(spark, tmp_path):
    run = str(tmp_path / "run")
    assert M.load_manifest(spark, run, SPEC) is None
    first = M.load_or_make(spark, run, SPEC, lambda: tables(spark))
    assert (first.n_truths, first.pool_size, first.stages) == (2, 11, 3)
    again = M.load_or_make(spark, run, SPEC, lambda: pytest.fail("made again"))
    assert again == first == M.save_manifest(spark, run, SPEC, *tables(spark, 4))  # a second writer gets the first's
    assert [r.stage for r in again.pool(spark).orderBy("pool_pos").collect()] == [1] * 4 + [2] * 4 + [3] * 3
    assert sum(n.startswith("snapshot-") for n in storing.names(spark, run)) == 1


def test_a_changed_specification_or_table_is_refused(spark, tmp_path):
    run = str(tmp_path / "run")
    made = M.load_or_make(spark, run, SPEC, lambda: tables(spark))
    for other in (M.Spec(3, 2, 5, 5), M.Spec(2, 1, 5, 5), M.Spec(2, 2, 6, 5), M.Spec(2, 2, 5, 4)):
        with pytest.raises(M.Changed):
            M.load_or_make(spark, run, other, lambda: tables(spark))
    tables(spark)[0].withColumn("question", F.lit("two?")).write.mode("overwrite").parquet(f"{made.folder}/truths")
    with pytest.raises(M.Changed, match="truths"):
        M.load_manifest(spark, run, SPEC)
    assert M.load_manifest(spark, run, SPEC, check=False) == made
    text = json.loads((tmp_path / "run/manifest.json").read_text())
    storing.remove(spark, f"{run}/manifest.json")
    storing.put_once(spark, f"{run}/manifest.json", json.dumps(text | {"fingerprint": "0" * 16}))
    with pytest.raises(M.Changed):
        M.load_manifest(spark, run)


def test_a_torn_write_is_not_seen(spark, tmp_path, monkeypatch):
    run = str(tmp_path / "run")
    monkeypatch.setattr(storing, "put_once", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        M.save_manifest(spark, run, SPEC, *tables(spark))
    monkeypatch.undo()
    assert M.load_manifest(spark, run, SPEC) is None
    assert M.load_or_make(spark, run, SPEC, lambda: tables(spark, 5)).pool_size == 5


def test_fingerprints(spark):
    assert len(SPEC.fingerprint()) == 16 and SPEC.fingerprint() != M.Spec(2, 2, 5, 6).fingerprint()
    from rankfold.operators.pool import spec_fingerprint

    assert spark.range(1).select(spec_fingerprint(2, 2, 5, 5, M.POOLING)).first()[0] == SPEC.fingerprint()


RESULTS = [(q, f"d{i}", 0.5 if i == 0 and q == 1 else None, 0.1 * i, int(i == 0), 0) for q in (1, 2, 3) for i in range(6)]
FACT = "query_idx long, doc_id string, llm_score double, dist_to_gt double, is_gt int, rag_failed int"
REQUESTS = [(f"q{q}_{k}", q, [f"d{2 * k}", f"d{2 * k + 1}"], "submitted") for q in (1, 2, 3) for k in range(3)]
REQUEST = "custom_id string, query_idx long, doc_ids array<string>, status string"


def reply(custom_id, text):
    return json.dumps({"custom_id": custom_id, "response": {"body": {"text": text}}})


ARRIVALS = [
    [reply("q1_0", "[3, 4]"), reply("q2_1", "[7, 8]"), "no json", reply("unknown", "[1]")],
    [reply("q2_1", "[1, 1]"), reply("q3_2", "no scores"), reply("q1_1", "[10, 2]")],
    [],
    [reply("q3_2", "[5, 6]")],
]


def by_key(df):
    return sorted(map(tuple, df.collect()), key=repr)


def start(spark, tmp_path, parts=4):
    (tmp_path / "in").mkdir(exist_ok=True)
    v = T.fact_versions(spark, str(tmp_path / "facts"), parts)
    v.create(results=spark.createDataFrame(RESULTS, FACT), requests=spark.createDataFrame(REQUESTS, REQUEST))
    return v


def run(spark, tmp_path, v):
    T.sync_replies(spark, str(tmp_path / "in"), v, str(tmp_path / "cp"), per_trigger=1).awaitTermination(120)


def expected(spark, arrivals):
    results, requests = spark.createDataFrame(RESULTS, FACT), spark.createDataFrame(REQUESTS, REQUEST)
    for lines in arrivals:
        rows = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
        named = [json.loads(x)["custom_id"] for x in lines if x.startswith("{")]
        out = S.sync(results, requests.filter(F.col("custom_id").isin(named)), rows)
        others = requests.filter(~F.col("custom_id").isin(named)).collect()
        requests = spark.createDataFrame(out.requests.select(requests.columns).collect() + others, REQUEST)
        results = spark.createDataFrame(out.results.select(results.columns).collect(), FACT)
    return by_key(results), by_key(requests)


def test_arrivals_merge_into_the_facts_and_replays_change_nothing(spark, tmp_path):
    v = start(spark, tmp_path)
    for k, lines in enumerate(ARRIVALS):
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join(lines) + "\n")
        run(spark, tmp_path, v)
    want = expected(spark, [a for a in ARRIVALS if a])
    assert (by_key(v.read("results")), by_key(v.read("requests"))) == want
    last = v.last()
    storing.remove(spark, f"{tmp_path}/cp/commits/{last}")  # the driver died before it noted the arrival
    run(spark, tmp_path, v)
    assert v.last() == last and (by_key(v.read("results")), by_key(v.read("requests"))) == want
    storing.remove(spark, f"{tmp_path}/cp/commits/{last}")
    storing.remove(spark, f"{v.folder}/versions/{last:012d}.json")  # and before the version was there
    run(spark, tmp_path, v)
    assert v.last() == last and (by_key(v.read("results")), by_key(v.read("requests"))) == want
    assert by_key(v.read("results", -1)) == by_key(spark.createDataFrame(RESULTS, FACT))  # what a reader of the first version has


def test_two_arrivals_equal_one_of_both(spark, tmp_path):
    for name, files in (("two", [ARRIVALS[0], [reply("q1_1", "[9, 2]"), reply("q3_0", "[2, 2]")]]), ("one", [ARRIVALS[0] + [reply("q1_1", "[9, 2]"), reply("q3_0", "[2, 2]")]])):
        (tmp_path / name).mkdir()
        v = start(spark, tmp_path / name)
        for k, lines in enumerate(files):
            (tmp_path / name / f"in/{k}.jsonl").write_text("\n".join(lines))
            run(spark, tmp_path / name, v)
        got = by_key(v.read("results"))
        first = got if name == "two" else first
    assert got == first
    rows = spark.createDataFrame(list(enumerate(files[0])), "seq long, value string")
    assert got == by_key(S.sync(spark.createDataFrame(RESULTS, FACT), spark.createDataFrame(REQUESTS, REQUEST), rows).results.select(*[c.split()[0] for c in FACT.split(", ")]))


def test_only_the_parts_that_change_are_written(spark, tmp_path):
    v = start(spark, tmp_path, parts=64)
    (tmp_path / "in/0.jsonl").write_text(reply("q1_0", "[3, 4]"))
    run(spark, tmp_path, v)
    written = [n for n in storing.names(spark, f"{v.folder}/data/results/v0") if n.startswith("part=")]
    assert 1 <= len(written) <= 2 and v.read("results").count() == len(RESULTS)


def score(pairs):
    return pairs.withColumn("llm_score", F.col("query_idx") / 10 + F.length("doc_id"))


def test_stages_as_a_stream_go_on_after_a_stop_and_equal_the_loop(spark, tmp_path):
    made = M.load_or_make(spark, str(tmp_path / "run"), SPEC, lambda: tables(spark))
    want = sorted(map(tuple, R.run_stages(spark, str(tmp_path / "loop"), made.truths(spark), made.pool(spark), score, 2).collect()))
    T.lay_out_stages(spark, made, str(tmp_path / "stages"))
    calls = []

    def dying(pairs):
        calls.append(1)
        return score(pairs) if len(calls) != 2 else score(pairs).withColumn("llm_score", F.raise_error(F.lit("killed")).cast("double"))

    args = (made, str(tmp_path / "stages"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="killed"):
        T.stream_stages(spark, *args, dying, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.stage for r in R.scored_stages(spark, str(tmp_path / "out")).collect()} == {1}
    T.lay_out_stages(spark, made, str(tmp_path / "stages"))
    T.stream_stages(spark, *args, dying, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(map(tuple, R.scored_stages(spark, str(tmp_path / "out")).collect())) == want
    assert len(calls) == 1 + 1 + 2  # the first stage wasn't done again
    T.stream_stages(spark, *args, dying, str(tmp_path / "cp")).awaitTermination(120)
    assert len(calls) == 4


def test_a_part_is_written_by_many_tasks(spark, tmp_path):
    versions = T.fact_versions(spark, str(tmp_path / "v"), 1)
    rows = spark.range(300).selectExpr("id % 3 AS query_idx", "CAST(id AS STRING) AS doc_id", "0.1D AS llm_score")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        versions.create(results=rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = versions.read("results")
    assert len(got.inputFiles()) > 1 and sorted(got.collect()) == sorted(rows.collect())
