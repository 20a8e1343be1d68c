"""A staged run's manifest: what a run asks and scores, written once, seen whole or not at all, and checked when it is loaded."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import storing
from rankfold.operators.pool import stage

#: fixed values: the name of the way pools are made, part of a specification's fingerprint
POOLING = "global_pool_v2"


class Changed(ValueError):
    """A run's folder holds a manifest of another specification, or one whose tables aren't what it says."""


@dataclass(frozen=True)
class Spec:
    """What a staged run is asked for: queries, documents a stage and query, and neighbours of each truth and query."""

    n_queries: int
    stride: int
    near_truth: int
    near_query: int

    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.n_queries}|{self.stride}|{self.near_truth}|{self.near_query}|{POOLING}".encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Manifest:
    spec: Spec
    folder: str  #: of the tables
    n_truths: int
    pool_size: int
    stages: int
    sums: dict[str, str]  #: of each table's rows, in any order

    def truths(self, spark: SparkSession) -> DataFrame:
        """(query_idx, doc_id, question)."""
        return spark.read.parquet(f"{self.folder}/truths")

    def pool(self, spark: SparkSession) -> DataFrame:
        """(doc_id, pool_pos, stage)."""
        return spark.read.parquet(f"{self.folder}/pool")


def checksum(rows: DataFrame) -> str:
    """The number of rows and two sums over their hashes, the same in any order of rows and files."""
    h = [F.xxhash64(F.lit(seed), *rows.columns) for seed in (1, 2)]
    r = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0)).alias(f"s{i}") for i, x in enumerate(h))).first()
    return f"{r['n']}:{r['s0']}:{r['s1']}"


def save_manifest(spark: SparkSession, run: str, spec: Spec, truths: DataFrame, pool: DataFrame) -> Manifest:
    """Write the queries with their truths and the ranked pool (doc_id, pool_pos) to new folders, then the manifest that names them.

    The manifest is one small file that appears by a rename, so readers see all or nothing; what a writer that
    died left behind is in folders that nothing names. Of two writers the first stands, and both get its manifest.
    """
    folder = f"{run}/snapshot-{uuid.uuid4().hex[:12]}"
    truths.select("query_idx", "doc_id", "question").write.parquet(f"{folder}/truths")
    pool.select("doc_id", "pool_pos", stage(F.col("pool_pos"), spec.stride, spec.n_queries).alias("stage")).write.parquet(f"{folder}/pool")
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("truths", "pool")}
    n, size = tables["truths"].count(), tables["pool"].count()
    stages = max(1, -(-size // (spec.stride * spec.n_queries)))
    made = Manifest(spec, folder, n, size, stages, {name: checksum(t) for name, t in tables.items()})
    text = json.dumps(asdict(made) | {"fingerprint": spec.fingerprint()}, sort_keys=True)
    if not storing.put_once(spark, f"{run}/manifest.json", text):
        storing.remove(spark, folder)
    return load_manifest(spark, run, spec)


def load_manifest(spark: SparkSession, run: str, spec: Spec | None = None, check: bool = True) -> Manifest | None:
    """The run's manifest; None if there is none yet. Refused if made for another ``spec``, if the file was changed,
    or, with ``check``, if its tables aren't what it was made of."""
    text = storing.read_text(spark, f"{run}/manifest.json")
    if text is None:
        return None
    told = json.loads(text)
    fingerprint = told.pop("fingerprint")
    made = Manifest(**told | {"spec": Spec(**told["spec"])})
    if fingerprint != made.spec.fingerprint():
        raise Changed(f"the manifest of {run} doesn't fit its own fingerprint")
    if spec is not None and fingerprint != spec.fingerprint():
        raise Changed(f"{run} was made for {made.spec}, not for {spec}")
    if check:
        for name, want in made.sums.items():
            if not storing.exists(spark, f"{made.folder}/{name}") or checksum(spark.read.parquet(f"{made.folder}/{name}")) != want:
                raise Changed(f"the table {name} of {run} isn't what its manifest was made of")
    return made


def load_or_make(spark: SparkSession, run: str, spec: Spec, make: Callable[[], tuple[DataFrame, DataFrame]]) -> Manifest:
    """The run's manifest, made of (truths, pool) from ``make`` if there is none: a run that resumes asks what it asked before,
    whatever the sources have become."""
    found = load_manifest(spark, run, spec)
    return found if found is not None else save_manifest(spark, run, spec, *make())

