"""A vector store in a folder: loads that resume, look-ups, exact search, and an approximate index gated by its recall."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold import storing
from rankfold.operators import vector as V


@dataclass
class Load:
    """What one call of ``add`` did to the batches of a load."""

    done: list[int]
    skipped: list[int]
    failed: dict[int, str]


class VectorStore:
    """Rows (d, text, embedding, and what else they bring) in ``folder``, which driver and executors share.

    A load is dealt into batches by its rows' ids. A batch counts once it is whole: readers see batches with the
    mark that Spark leaves at the end of a write, and nothing of others. The first load brings the columns.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # loads

    def add(self, rows: DataFrame, name: str, embed: Callable[[DataFrame], DataFrame] = lambda rows: rows, size: int = 10_000, stop: bool = True) -> Load:
        """Store ``rows`` (d, ...) that aren't stored yet as load ``name``, about ``size`` rows a batch; ``embed`` adds their vectors.

        Called again with the same name, it goes on: batches that are whole stay, others are done again, failed
        ones too. With ``stop`` a failing batch stops the call; else it is told and the next ones are tried. What
        a load holds is fixed by its first call, so one that was cut short can't mix two inputs. Of rows with one
        id one stays, and an id of an earlier load keeps its row. A null id is no id: such rows are left out.
        """
        plan_path, staged = f"{self.folder}/loads/{name}.json", f"{self.folder}/staged/{name}"
        text = storing.read_text(self.spark, plan_path)
        if text is None:
            new = rows.filter("d is not null")
            if self.exists():
                new = new.join(self.rows().select("d"), "d", "left_anti")
            columns, n, parts = new.columns, max(1, -(-rows.count() // size)), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            first = F.min_by(F.struct(*columns), F.xxhash64(*(c for c, t in new.dtypes if not t.startswith("map")))).alias("r")
            place = F.pmod(F.xxhash64("d"), F.lit(16 * n * parts))  # a batch has many places, so that all tasks write and read each one
            dealt = new.withColumn("batch", F.pmod(place, F.lit(n)).cast("int")).withColumn("place", F.floor(place / n))
            dealt = dealt.repartition(parts, "place").groupBy("place", "batch", "d").agg(first).select("batch", "r.*")
            dealt.write.mode("overwrite").partitionBy("batch").parquet(staged)
            storing.put_once(self.spark, plan_path, json.dumps({"batches": n, "schema": new.schema.json()}))
            text = storing.read_text(self.spark, plan_path)
        plan, load = json.loads(text), Load([], [], {})
        from pyspark.sql.types import StructType

        shape = StructType.fromJson(json.loads(plan["schema"]))
        for b in range(plan["batches"]):
            out = f"{self.folder}/data/{name}-{b:06d}"
            if storing.exists(self.spark, f"{out}/_SUCCESS"):
                load.skipped.append(b)
                continue
            try:
                part = f"{staged}/batch={b}"
                given = self.spark.read.schema(shape).parquet(part) if storing.exists(self.spark, part) else self.spark.createDataFrame([], shape)
                embed(given).write.mode("overwrite").parquet(out)
                load.done.append(b)
            except Exception as e:
                if stop:
                    raise
                load.failed[b] = str(e).splitlines()[0]
        if not load.failed:
            storing.remove(self.spark, staged)
        return load

    def batches(self) -> list[str]:
        """Names of the batches that are whole."""
        return [b for b in storing.names(self.spark, f"{self.folder}/data") if storing.exists(self.spark, f"{self.folder}/data/{b}/_SUCCESS")]

    def exists(self) -> bool:
        return bool(self.batches())

    def rows(self, batches: list[str] | None = None) -> DataFrame:
        """All rows that are stored, or those of some batches."""
        named = self.batches() if batches is None else batches
        if not named:
            raise ValueError(f"nothing is stored in {self.folder}")
        return self.spark.read.parquet(*(f"{self.folder}/data/{b}" for b in named))

    def fetch(self, ids: DataFrame) -> DataFrame:
        """Rows of the ids (d) that have a text and a vector."""
        return self.rows().join(ids.select("d").distinct(), "d", "left_semi").filter("text is not null and embedding is not null")

    def statistics(self) -> DataFrame:
        """One row: rows, rows with a vector, width, batches."""
        e = F.col("embedding")
        return self.rows().agg(F.count("*").alias("n_rows"), F.count(e).alias("n_vectors"), F.max(F.size(e)).alias("width")).withColumn("n_batches", F.lit(len(self.batches())))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Exact: (q, d, similarity, rank) for queries (q, embedding)."""
        return V.top_k(self.rows().select("d", "embedding"), queries, k)

    # the index

    MOST_CELLS = 16_384

    def build_index(self, cells: int | None = None, sample: int = 100_000, seed: int = 7, tries: int = 200, k: int = 10, recall: float = 0.95) -> dict:
        """Cluster the vectors into cells, store all rows by cell, and find how many cells a query has to probe.

        Centres are trained by k-means on at most ``sample`` unit vectors, the first by a hash of their ids; every
        row is indexed. ``cells`` is the root of their number if not given, MOST_CELLS at most: the centres are
        broadcast. ``tries`` vectors, by another hash, then are searched both ways, with twice as many probes until
        ``recall`` of their ``k`` nearest are found. If that takes over half the cells the index says so, and
        searches are exact. Rows are dealt by cell and id, so that a large cell is in many files. Returns what the
        index tells of itself; it covers the batches there are now, and searches look up later ones exactly.
        """
        batches = self.batches()
        rows = self.rows(batches).filter("embedding is not null").select("d", V.unit(F.col("embedding")).cast("array<float>").alias("embedding"))
        n = rows.count()
        cells = max(1, min(cells or round(n**0.5), self.MOST_CELLS))
        taken, by = rows, F.xxhash64(F.lit(seed), "d")
        if n > sample:  # where the hash is cut is found by hashes alone, so vectors stay where they are
            last = rows.select(by.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
            taken = rows.filter(by <= last)
        taken = taken.filter(V.norm(F.col("embedding")) > 0).select(array_to_vector("embedding").alias("features"))
        taken = storing.stored(taken.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "index-sample")
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(taken).clusterCenters()) if taken.count() else np.zeros((1, 1))
        centres = V.unit_rows(centres)
        version = f"{self.folder}/index/{len(storing.names(self.spark, f'{self.folder}/index')):06d}"
        held = self.spark.sparkContext.broadcast(centres)

        def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                if batch.num_rows:
                    width = held.value.shape[1] if len(held.value) > 1 or held.value.any() else len(batch.column(1)[0])
                    e = V.batch_vectors(batch, 1, width)
                    cell = np.argmax(e @ held.value.T, axis=1) if held.value.any() else np.zeros(len(e), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "d", "embedding"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.mapInArrow(deal, "cell int, d long, embedding array<float>").repartitionByRange(parts, "cell", "d").sortWithinPartitions("cell", "d")
        placed.write.option("parquet.block.size", 8 << 20).parquet(f"{version}/rows")
        sizes = {r["cell"]: r["n"] for r in self.spark.read.parquet(f"{version}/rows").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        centre_rows = [(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(centres)]
        self.spark.createDataFrame(centre_rows, "cell int, centre array<double>, n long").coalesce(1).write.parquet(f"{version}/cells")
        tell = {"batches": batches, "cells": len(centres), "rows": n, "probes": len(centres), "recall": 1.0, "path": version}
        asked = rows.orderBy(F.xxhash64(F.lit(seed + 1), "d"), "d").limit(tries).withColumnRenamed("d", "q")
        asked = storing.stored(asked, "index-tries")
        truth = storing.stored(V.top_k(rows, asked, k).select("q", "d"), "index-truth")
        probes, total = 1, truth.count()
        while 2 * probes <= len(centres):
            found = self._probe(tell, *V.query_matrix(asked, "q", "embedding"), k, probes).join(truth, ["q", "d"], "left_semi").count()
            if found >= recall * total:
                tell |= {"probes": probes, "recall": found / max(1, total)}
                break
            probes *= 2
        storing.put_once(self.spark, f"{version}/index.json", json.dumps(tell))
        return tell

    def index(self) -> dict | None:
        """What the newest whole index tells of itself."""
        for name in reversed(storing.names(self.spark, f"{self.folder}/index")):
            if (text := storing.read_text(self.spark, f"{self.folder}/index/{name}/index.json")) is not None:
                return json.loads(text)
        return None

    def _plan(self, index: dict, m: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, query) of what each query probes, by cell, and the sizes of cells: its nearest non-empty centres."""
        rows = self.spark.read.parquet(f"{index['path']}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        centres, sizes = np.array([r["centre"] for r in rows]), np.array([r["n"] for r in rows])
        unit, pairs = V.unit_rows(m), []
        for start in range(0, len(m), max(1, V.MOST_PRODUCTS // len(rows))):
            part = unit[start : start + max(1, V.MOST_PRODUCTS // len(rows))]
            near = np.where(sizes > 0, part @ centres.T if centres.shape[1] == part.shape[1] else 0.0, -np.inf)
            cell = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            pairs.append(np.stack((cell.ravel(), np.repeat(np.arange(start, start + len(part)), cell.shape[1])), 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))], sizes

    def products(self, queries: DataFrame, probes: int | None = None) -> int:
        """How many similarities a search of these queries computes in the index; exact search takes rows times queries."""
        index = self.index()
        pairs, sizes = self._plan(index, V.query_matrix(queries, "q", "embedding")[1], probes or index["probes"])
        return int(sizes[pairs[:, 0]].sum())

    def _probe(self, index: dict, keys: list, m: np.ndarray, k: int, probes: int) -> DataFrame:
        pairs, _ = self._plan(index, m, probes)
        cells, starts = np.unique(pairs[:, 0], return_index=True)
        of_cell = dict(zip(cells.tolist(), np.split(pairs[:, 1], starts[1:])))
        held = self.spark.sparkContext.broadcast((np.array(keys, np.int64), V.unit_rows(m), of_cell))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ks, queries_, probing = held.value
            best, small = V.Nearest(len(ks), k), queries_.astype(np.float32)
            for batch in batches:
                cell, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
                for a, b in zip(at, [*at[1:], len(cell)]):  # rows of a cell stand together
                    if (of := probing.get(int(cell[a]))) is not None:
                        ids, e = V.without_copies(d[a:b], V.batch_vectors(batch.slice(a, b - a), 2, queries_.shape[1]), k)
                        for start in range(0, len(of), max(1, V.MOST_PRODUCTS // max(1, len(e)))):
                            best.offer(of[start : start + max(1, V.MOST_PRODUCTS // max(1, len(e)))], [queries_], small, ids, e)
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ks[best.q], best.d, *best.s)], names=["q", "d", "s1"])

        rows = self.spark.read.parquet(f"{index['path']}/rows")
        if len(cells) <= 1000:  # a list that the scan can take: row groups of other cells aren't read
            rows = rows.filter(F.col("cell").isin(cells.tolist()))
        return rows.select("cell", "d", "embedding").mapInArrow(run, "q long, d long, s1 double")

    def search_index(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(q, d, similarity, rank): the nearest rows of the cells that each query probes, and of batches after the index.

        ``probes`` is by default what the index found to give its recall. Without an index, or where it found that
        no less than all cells will do, the search is exact. Any number of queries, in blocks as in ``top_k``.
        """
        index = self.index()
        if index is None or (probes or index["probes"]) >= index["cells"]:
            return self.search(queries, k)
        later = [b for b in self.batches() if b not in set(index["batches"])]
        near = []
        for keys, m in [V.query_matrix(queries, "q", "embedding")] if V.few(queries) else V.query_blocks(queries):
            near.append(self._probe(index, keys, m, k, probes or index["probes"]))
            if later:
                near.append(V.block_cosine(self.rows(later).select("d", "embedding"), keys, m, top=k))
        return V.first(reduce(DataFrame.unionByName, near), k)
