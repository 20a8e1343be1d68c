"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.llm.common import carried, stored, words_of

#: how documents stand in a source
ORDER = ["source", "size", "id", "tie"]


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Each source's target, from one row (source, source_size) a source.

    Sources take ``weights`` in turn, by code point with null last, and share all sizes by weight; a target
    stops at ``most`` times its source's size and the excess is shared again. Sharing again and again ends
    where the sources with the least room a weight are full, so one ordered pass finds the same targets:
    a source is full if, with all that have less room a weight than it full, its share reaches its room.
    The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("long"))
    s = s.withColumn("room", F.lit(most) * F.col("source_size")).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.col("all") - F.coalesce(F.sum("room").over(before), F.lit(0)))
    s = s.withColumn("sharing", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("weight") * F.col("rest") >= F.col("room") * F.col("sharing"))
    #: the first source that isn't full fixes the share of a weight for all after it
    first = F.min(F.when(~F.col("full"), F.struct(F.col("room") / F.col("weight"), "rest", "sharing"))).over(Window.partitionBy())
    s = s.withColumn("first", first)
    share = F.when(F.col("full"), F.col("room").cast("double")).otherwise(
        (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.sharing").cast("double")
    )
    return s.select("source", "source_size", share.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): 32 bits of a digest of its name and the seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))
    return F.conv(F.left(F.md5(name), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0, parts: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """How often the mix takes each document; adds size, source_size, target and copies to the columns.

    Size is the number of words, 0 for a null text. A document's expected copies are its source's target over
    its source's size. Within a source, documents stand by size, then id, so neighbours have like sizes; their
    expected copies are summed up from one random offset, and a document is taken once for each whole number
    that the sum passes at it. Copies are thus the expected number rounded down or up, never above ``most``,
    and the words taken miss the target by less than the largest document's size. A null source is a source,
    the last by name; null ids are allowed and stand first. Every row is a document of its own with a place of its
    own, rows that repeat an id or a whole row too; rows of one id and size stand by a hash of their text. A source
    without words has target 0, and its documents are not taken. An empty table gives an empty table. ``keep``
    names the columns to go along (all by default); columns of the added ones' names are replaced.

    Ranks come from a range partitioning by (source, size, id), which cuts a large source anywhere, and one
    count for each (part, source); no source is ever in one task. Rows are stored with a number of their own, so
    that only numbers and sizes stand in that order (texts would stand by length, the longest together), and
    decisions come back to the rows by number, which no two rows share.
    """
    own = carried(docs)
    kept = docs.columns if keep is None else keep
    rows = own.df.select(
        *(own.at(n) for n in kept), n_words(F.col(own.at("text"))).alias("size"), F.col(own.at("doc_id")).alias("id"),
        F.col(own.at("source")).cast("string").alias("source"), F.xxhash64(own.at("text")).alias("tie"),
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("row", *ORDER).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER, "row").withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed.select("row", "source", "place"), "mix-places").withColumn("part", F.shiftright("place", 33))
    sources = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-sources")
    runs = placed.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", F.col("source").alias("s"), "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    runs = runs.join(sources, F.col("s").eqNullSafe(sources.source)).drop("source").withColumnRenamed("part", "p")
    decided = placed.join(runs, (F.col("p") == F.col("part")) & F.col("source").eqNullSafe(F.col("s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    rank = F.col("ahead") + F.col("place") - F.col("first")
    start = offset(F.col("s"), seed)
    passed = F.floor((rank + 1) * each + start) - F.floor(rank * each + start)
    decided = decided.select("row", "source_size", "target", passed.alias("copies"))
    ours = ("size", "source_size", "target", "copies")
    theirs = [F.col(own.at(n)).alias(n) for n in kept if n.lower() not in ours]
    return rows.join(decided, "row").select(*theirs, *ours)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    names = [n if n in ("doc_id", "text", "source") else f"carried{i}" for i, n in enumerate(docs.columns)]
    out = mix_sources(docs.toDF(*names), **options).filter(F.col("copies") > 0)
    return out.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy").toDF(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix_sources(docs, keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


SQL = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::BIGINT AS weight,
             3 * source_size AS room, sum(source_size) OVER ()::BIGINT AS total FROM s),
r AS (SELECT *, total - coalesce(sum(room) OVER (ORDER BY room / weight, source IS NULL, encode(source)
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
             sum(weight) OVER (ORDER BY room / weight, source IS NULL, encode(source)
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS sharing FROM w),
f AS (SELECT *, weight * rest >= room * sharing AS is_full FROM r),
x AS (SELECT arg_min(rest, room / weight) AS rest, arg_min(sharing, room / weight) AS sharing FROM f WHERE NOT is_full),
t AS (SELECT f.source, f.source_size, CASE WHEN f.is_full THEN f.room::DOUBLE
             ELSE (f.weight * x.rest)::DOUBLE / x.sharing::DOUBLE END AS target,
             ('0x' || substr(md5('0:' || coalesce(f.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM f LEFT JOIN x ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS each,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(k::DOUBLE * each + u) - floor((k - 1)::DOUBLE * each + u))::BIGINT * size)::BIGINT AS taken FROM p
"""
}
