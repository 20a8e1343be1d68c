"""Line dedup: levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import SPACE, _remove, ascii_lower, carried, let, new_path, stored

HASH = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: ends stripped of white space, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACE)))


def hashed(key: Column) -> tuple[Column, Column]:
    """128 bits: two XXH64 under different seeds."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")


class LineRuns:
    """A log-structured store of (hash, documents that hold it), in runs sorted by hash.

    A batch becomes a run of level 0. ``fanout`` runs of a level are merged into one of the next, so each count
    is rewritten once per level. A batch first anti-joins the hashes that the runs already know to be frequent:
    these need no more counting. Runs are files in the shared folder, and nothing is held in memory.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = new_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.made = 0

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*runs)

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path, self.made = f"{self.path}/level-{level}/run-{self.made}", self.made + 1
        df.select(*HASH, "n").sortWithinPartitions(*HASH).write.parquet(path)
        self.levels[level].append(path)

    def add(self, counts: DataFrame) -> None:
        """Add a batch: one row (h1, h2, n) per hash."""
        if runs := sum(self.levels, []):
            counts = counts.join(self._read(runs).filter(F.col("n") >= self.min_docs).select(*HASH), HASH, "left_anti")
        self._write(counts, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._read(merged).groupBy(*HASH).agg(F.sum("n").alias("n")), level + 1)
            for run in merged:
                _remove(self.spark, run)
            level += 1

    def frequent(self) -> DataFrame:
        """The hashes found in at least ``min_docs`` documents."""
        runs = sum(self.levels, [])
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._read(runs).groupBy(*HASH).agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_docs).select(*HASH)


def frequent_lines(docs: DataFrame, text: str, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """Hashes of the keys that stand in at least ``min_docs`` rows of ``docs``."""
    lines = (
        docs.select(F.pmod(F.xxhash64(*docs.columns), F.lit(batches)).alias("batch"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("batch", *hashed(F.col("key")))
    )
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "line-batches")
    lines.groupBy("batch", *HASH).agg(F.count("*").alias("n")).write.partitionBy("batch").parquet(path)
    runs, counts = LineRuns(spark, min_docs), spark.read.schema("h1 long, h2 long, n long, batch long").parquet(path)
    for k in range(batches):
        runs.add(counts.filter(F.col("batch") == k).drop("batch"))
    _remove(spark, path)
    return runs.frequent()


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Drop every line whose key stands in at least ``min_docs`` documents.

    Adds n_lines, n_dropped and kept_text to the columns of ``docs``; columns of these names are replaced.
    A null or empty text is one empty line and keeps it. Each row is a document of its own: rows that repeat
    an id or a whole row each count, and null ids are allowed. A key counts once in a document. Keys shorter
    than ``min_chars`` code points stay. An empty table gives an empty table.

    Frequent hashes meet the lines in a semi join of hashes alone (AQE splits a hot line); texts move once, in
    the join with the positions to drop.
    """
    own = carried(docs)
    rows = own.df.withColumn("t", F.coalesce(own.at("text"), F.lit("")))
    rows = rows.withColumn("rid", F.col(own.at("doc_id")).cast("string")).withColumn("rh", F.xxhash64("t"))
    frequent = stored(frequent_lines(rows.select("rid", "t"), "t", min_docs, min_chars, batches), "frequent-lines")
    places = (
        rows.select("rid", "rh", F.posexplode(line_keys(F.col("t"))).alias("at", "key"))
        .filter(F.length("key") >= min_chars)
        .select("rid", "rh", "at", *hashed(F.col("key")))
    )
    drops = places.join(frequent, HASH, "left_semi").groupBy("rid", "rh").agg(F.collect_set("at").alias("drops"))
    drops = drops.select(F.col("rid").alias("drid"), F.col("rh").alias("drh"), "drops")
    joined = rows.join(drops, rows.rid.eqNullSafe(drops.drid) & (F.col("rh") == F.col("drh")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split("t", "\n")) - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("t")).otherwise(
        let(F.split("t", "\n"), lambda lines: F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    )
    return own.back(
        joined,
        n_lines=F.size(F.split("t", "\n")).cast("long"),
        n_dropped=F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long"),
        kept_text=kept,
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id, r
"""
}
