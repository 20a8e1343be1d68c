"""Running sums, places and exact quantiles in groups of any size: no group is ever sorted or held by one task."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from rankfold.storing import stored


def _changes(columns: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """Where a row's values differ from the row's before it; nulls equal nulls."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for k, c in enumerate(columns):
        last = pa.array([None if before is None else before[k].as_py()], c.type)
        shifted = pa.concat_arrays([last, c.slice(0, n - 1)])
        differs = pc.fill_null(pc.not_equal(c, shifted), False).to_numpy(zero_copy_only=False)
        out |= differs | (pc.is_null(c).to_numpy(zero_copy_only=False) != pc.is_null(shifted).to_numpy(zero_copy_only=False))
    if n and columns and before is None:
        out[0] = True
    return out


def running(rows: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds before_x for each x of ``sums`` (longs): the sum of x over the rows of the same group that stand earlier.

    ``by`` may be empty: one group. Rows are unique by group and order; aggregate before, which also keeps ties in
    one row. A range partitioning by group and order cuts a large group anywhere. Each task sums up its part in
    order, holding one batch; the parts' own sums, a row a part and group, give what to add.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType(list(rows.schema.fields)).add("part", IntegerType())
    for x in sums:
        schema = schema.add(f"before_{x}", LongType())
    arrow, columns = to_arrow_schema(schema), list(rows.columns)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, np.zeros(len(sums), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = [batch.column(columns.index(c)) for c in by]
            starts = np.flatnonzero(_changes(groups, last))
            if len(starts) and starts[0] == 0:
                held[:] = 0
            of = np.searchsorted(starts, np.arange(n), "right")  # 0: the group that the last batch ended in
            out = []
            for k, x in enumerate(sums):
                values = pc.fill_null(batch.column(columns.index(x)), 0).to_numpy().astype(np.int64)
                stops = np.cumsum(values)
                before = stops - values
                base = np.concatenate(([-held[k] if not len(starts) or starts[0] else 0], before[starts]))
                out.append(before - base[of])
                held[k] = out[-1][-1] + values[-1]
            last = [g[n - 1] for g in groups]
            extra = [pa.array(np.full(n, part, np.int32)), *map(pa.array, out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=arrow)

    key = [*by, *order]
    placed = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    placed = stored(placed.mapInArrow(sum_up, schema), "running")
    ends = placed.groupBy("part", *by).agg(*(F.sum(x).alias(f"all_{x}") for x in sums))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    add = ends.select(F.col("part").alias("p"), *(F.col(c).alias(f"g{i}") for i, c in enumerate(by)), *(F.sum(f"all_{x}").over(ahead).alias(f"add_{x}") for x in sums))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"g{i}")) for i, c in enumerate(by)), F.col("part") == F.col("p"))
    joined = placed.join(add.filter(f"add_{sums[0]} is not null"), same, "left")  # none in a group's first part
    total = [(F.col(f"before_{x}") + F.coalesce(F.col(f"add_{x}"), F.lit(0))).alias(f"before_{x}") for x in sums]
    return joined.select(*columns, *total)


def places(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's number within its group, from 1, as row_number would; rows are unique by group and order."""
    return running(rows.withColumn("one", F.lit(1).cast("long")), by, order, ["one"]).withColumn(name, F.col("before_one") + 1).drop("one", "before_one")


def quantiles(rows: DataFrame, by: list[str], value: str, at: list[float]) -> DataFrame:
    """(by, n, q): the exact quantiles of a group's values, linear between neighbours, as an array in the order of ``at``.

    Equal values are counted together before anything moves; the values at the wanted places are then read off
    running counts. Nulls don't count; a group without values is left out, and so is ``q`` of an empty table.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counts = running(counts, by, ["v"], ["n"])
    totals = counts.groupBy(*by).agg(F.sum("n").alias("all"))
    if by:
        names = {c: f"t{i}" for i, c in enumerate(by)}
        totals = totals.select(*(F.col(c).alias(t) for c, t in names.items()), "all")
        counts = counts.join(totals, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(t)) for c, t in names.items())))
    else:
        counts = counts.crossJoin(F.broadcast(totals))  # one row
    wanted = [F.lit(float(p)) * (F.col("all") - 1) for p in at]
    holds = lambda i: (F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n"))
    picked = [F.max(F.when(holds(f(w)), F.col("v"))) for w in wanted for f in (F.floor, F.ceil)]
    out = counts.groupBy(*by).agg(F.max("all").alias("n"), *(p.alias(f"x{i}") for i, p in enumerate(picked)))
    between = [F.col(f"x{2 * i}") + (F.col(f"x{2 * i + 1}") - F.col(f"x{2 * i}")) * (F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1))) for i, p in enumerate(at)]
    return out.filter("n is not null").select(*by, "n", F.array(*between).alias("q"))


def level_quantile(value: str, p: float, count: str) -> Column:
    """The quantile of grouped counts (value, count): for values of few levels, whose counts are few rows."""
    if not 0 <= p <= 1 or math.isnan(p):
        raise ValueError("a quantile is from 0 to 1")
    return F.percentile(value, F.lit(p), F.col(count))
