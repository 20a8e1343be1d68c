"""Facts and requests in versions, and replies and stages that arrive as streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rankfold import storing
from rankfold.functions import parsing as P
from rankfold.operators import runs, sync
from rankfold.operators.manifest import Manifest


class Versions:
    """Tables in ``folder`` whose rows are dealt into parts by key. A version rewrites only the parts it changes.

    ``versions/n.json`` says which write holds each part of each table. It appears by a rename and never changes,
    so a reader has one version whole, a version that was cut short isn't there, and version n is made once.
    """

    #: most files of a part in a write: a few large parts are written by many tasks
    FILES = 8

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, list[str]], parts: int = 64):
        self.spark, self.folder, self.keys, self.parts = spark, folder.rstrip("/"), keys, parts

    def _part(self, table: str):
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.parts)).cast("int")

    def last(self) -> int | None:
        numbers = [int(n[:-5]) for n in storing.names(self.spark, f"{self.folder}/versions") if n.endswith(".json") and not n.startswith(".")]
        return max(numbers, default=None)

    def _tell(self, version: int) -> dict:
        return json.loads(storing.read_text(self.spark, f"{self.folder}/versions/{version:012d}.json"))

    def create(self, **tables: DataFrame) -> None:
        """Version -1: what there is before any arrival. Does nothing if it is there."""
        if self.last() is None:
            self._write(-1, {"schemas": {}, "parts": {}}, tables, None)

    def _write(self, version: int, before: dict, tables: dict[str, DataFrame], changed: dict[str, list[int]] | None) -> None:
        tell = {"schemas": dict(before["schemas"]), "parts": {t: dict(p) for t, p in before["parts"].items()}}
        for name, rows in tables.items():
            out = f"{self.folder}/data/{name}/v{version}"
            dealt = rows.withColumn("part", self._part(name)).repartition("part", F.pmod(F.xxhash64(F.lit(1), *self.keys[name]), F.lit(self.FILES)))
            dealt.write.mode("overwrite").partitionBy("part").parquet(out)
            there = {int(n[5:]) for n in storing.names(self.spark, out) if n.startswith("part=")}
            tell["schemas"][name] = rows.schema.json()
            of = tell["parts"].setdefault(name, {})
            for p in range(self.parts) if changed is None else changed[name]:
                of.pop(str(p), None)
                if p in there:
                    of[str(p)] = version
        storing.put_once(self.spark, f"{self.folder}/versions/{version:012d}.json", json.dumps(tell))

    def read(self, name: str, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """A table as of a version (the last one), or only some of its parts."""
        tell = self._tell(self.last() if version is None else version)
        schema = StructType.fromJson(json.loads(tell["schemas"][name]))
        paths = [f"{self.folder}/data/{name}/v{v}/part={p}" for p, v in tell["parts"][name].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, version: int, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], touched: dict[str, DataFrame]) -> bool:
        """Make ``version`` from the last one below: ``change`` maps the touched parts of the tables to what they become.

        ``touched`` has rows with the keys of what may change. False, and nothing is done, if the version is there
        already: an arrival that is run again after its version was made changes nothing, and one whose version
        was cut short starts again from what stood before it.
        """
        if storing.exists(self.spark, f"{self.folder}/versions/{version:012d}.json"):
            return False
        below = [n for n in (int(x[:-5]) for x in storing.names(self.spark, f"{self.folder}/versions") if not x.startswith(".")) if n < version]
        before = max(below)
        changed = {name: sorted(r["p"] for r in rows.select(self._part(name).alias("p")).distinct().collect()) for name, rows in touched.items()}  # at most ``parts``
        now = change({name: self.read(name, before, parts) for name, parts in changed.items()})
        self._write(version, self._tell(before), now, changed)
        return True


def fact_versions(spark: SparkSession, folder: str, parts: int = 64) -> Versions:
    """Versions of results (by query and document) and requests (by custom_id)."""
    return Versions(spark, folder, {"results": ["query_idx", "doc_id"], "requests": ["custom_id"]}, parts)


def sync_replies(spark: SparkSession, folder: str, versions: Versions, checkpoint: str, per_trigger: int | None = None) -> StreamingQuery:
    """Put replies that arrive as JSON lines in ``folder`` into the facts, one version an arrival.

    An arrival goes through ``sync`` with the requests that its replies name and the facts of their documents;
    other parts aren't read. Requests without a reply keep their state, as their replies may come later. The
    arrival's number is the version's, so one that is run again changes nothing. The stream itself holds no state.
    """

    def merge(lines: DataFrame, number: int) -> None:
        spark_ = lines.sparkSession
        lines = storing.stored(lines.withColumn("seq", F.monotonically_increasing_id()), "arrival")  # numbered once
        named = sync.reply_lines(lines).filter("not bad").select("custom_id").distinct()
        before = versions.last() if versions.last() < number else number - 1
        asked = versions.read("requests", before).join(named, "custom_id", "left_semi")
        documents = asked.select("query_idx", F.explode(F.transform("doc_ids", P.norm_id)).alias("doc_id"))

        def change(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
            ours = now["requests"].join(named, "custom_id", "left_semi")
            after = sync.sync(now["results"], ours, lines)
            rest = now["requests"].join(named, "custom_id", "left_anti")
            return {"results": after.results.select(now["results"].columns), "requests": after.requests.select(now["requests"].columns).unionByName(rest)}

        versions.spark = spark_
        versions.commit(number, change, {"results": documents, "requests": asked})

    reader = spark.readStream.schema("value string")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.text(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lay_out_stages(spark: SparkSession, manifest: Manifest, folder: str) -> None:
    """The pool as the source of a stream: a file a stage, in their order. Stages that are there stay."""
    pool = manifest.pool(spark)
    for n in range(1, manifest.stages + 1):
        if not storing.exists(spark, f"{folder}/{n:06d}/_SUCCESS"):
            pool.filter(F.col("stage") == n).select("doc_id", "pool_pos", "stage").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{n:06d}")


def stream_stages(spark: SparkSession, manifest: Manifest, source: str, out: str, score: Callable[[DataFrame], DataFrame], checkpoint: str, skip: DataFrame | None = None) -> StreamingQuery:
    """``run_stages`` as a stream: each arrival is one stage's documents, and the checkpoint is the cursor.

    Takes the stages that ``lay_out_stages`` put in ``source``, one an arrival, and stores each under ``out``/stage=n,
    whole or not at all. A query that is stopped between stages or within one goes on there when it is started
    again; a stage that is run again overwrites itself with the same pairs.
    """
    truths, stride = manifest.truths(spark).select("query_idx", "doc_id"), manifest.spec.stride

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        for n in sorted(r["stage"] for r in batch.select("stage").distinct().collect()):  # one, or few if files came together
            done = runs.scored_stages(session, out).filter(F.col("stage") < n)
            pairs = runs.stage_pairs(truths, manifest.pool(session), done, n, stride, skip)
            score(pairs).select("query_idx", "doc_id", "llm_score").write.mode("overwrite").parquet(f"{out}/stage={n}")

    stages = spark.readStream.schema("doc_id string, pool_pos long, stage long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    return stages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
