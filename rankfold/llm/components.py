"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import dropped, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large: link each node's larger neighbours to its least one. Small: link its smaller neighbours and itself to it."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = stored(least.select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "least")  # read back, the join deals both sides itself and AQE can split a hub
    linked = near.join(least, F.col("a") == F.col("k"))
    if small:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    else:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.filter(F.col("m") < F.col("k")).select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Each round is a few joins over the edges, whose number never grows past the nodes after the first round,
    and is written to the shared folder; the rounds end when the edges no longer change, which a count and a
    sum of hashes tell. A hub's rows are pre-aggregated and stored, so AQE can split its join. Edges with a null
    end are left out.
    """
    edges = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    mark = None
    while True:
        last, edges = edges, stored(_star(_star(edges, small=False), small=True), "edges")
        dropped(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b"), F.col("b")).distinct())
        mark = now
