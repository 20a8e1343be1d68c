"""SimHash near-dedup: a self-join of binary tries under a Hamming budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.llm.common import carried, id_and_text, per_row, stored
from rankfold.llm.components import components

SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits: each is set if over half of the shingles' XXH64 have it set. No words: 0.

    A-Z are lower-cased, words end at white space, and a text with fewer words is one shingle.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(parts) - k + 1
    a, b = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(flat[i:j], SEED) for i, j in zip(a[at : at + (1 << 16)], b[at : at + (1 << 16)])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def make() -> Callable[..., tuple]:
        def row(doc_id: int | None, text: str | None) -> tuple:
            f = fingerprint(text, words)
            return doc_id, f - (1 << 64) if f >> 63 else f

        return row

    rows = id_and_text(docs)
    return per_row(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long", make)


class Linker:
    """Union-find over a sorted table of fingerprints, with roots as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs; roots are the least members."""
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def trie_links(group: np.ndarray, fp: np.ndarray, most: int, chunk: int = 1 << 18) -> np.ndarray:
    """Components among the fingerprints of each group that differ in at most ``most`` bits.

    ``group`` and ``fp`` (distinct within a group) are sorted together. A trie node is a range of the table
    whose fingerprints share their first bits; below each group's root, pairs of nodes are taken down one bit
    at a time. Two children by the same bit keep the pair's errors, by different bits they have one more, and
    a pair over the budget is dropped with all below it. Pairs wait on a stack in chunks, deepest first, so
    memory is bounded; a pair whose two ranges already lie in one component is dropped too, so a dense group
    of near copies doesn't cost all its pairs. Returns each row's component as the row of its least member.
    """
    n = len(fp)
    linker = Linker(n)
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    lo, hi = cuts, np.concatenate((cuts[1:], [n]))
    big = hi - lo > 1
    root = np.stack((lo, hi, lo, hi, np.zeros_like(lo)), 1)[big]
    stack: list[tuple[int, np.ndarray]] = [(0, root[i : i + chunk]) for i in range(0, len(root), chunk)]
    popcount = np.bitwise_count
    while stack:
        depth, pairs = stack.pop()
        a0, a1, b0, b1, err = pairs.T
        own = a0 == b0
        comp = linker.root
        runs = np.cumsum(np.concatenate(([0], comp[1:] != comp[:-1])))
        linked = (runs[a0] == runs[a1 - 1]) & (runs[b0] == runs[b1 - 1]) & (comp[a0] == comp[b0])
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        leaf = single & ~own & ~linked
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = popcount(fp[x] ^ fp[y]) <= most
            linker.union(x[near], y[near])
        go = ~single & ~linked
        if depth == 64 or not go.any():
            continue
        a0, a1, b0, b1, err, own = (v[go] for v in (a0, a1, b0, b1, err, own))
        bit = np.uint64(1) << np.uint64(63 - depth)
        # the first row of each range that has the bit: ranges share the bits before it
        am, bm = _split(fp, a0, a1, bit), _split(fp, b0, b1, bit)
        down = [
            np.stack((a0, am, b0, bm, err), 1),
            np.stack((am, a1, bm, b1, err), 1),
            np.stack((a0, am, bm, b1, err + 1), 1),
            np.stack((am, a1, b0, bm, err + 1), 1)[~own],
        ]
        down = np.concatenate([d[(d[:, 0] < d[:, 1]) & (d[:, 2] < d[:, 3]) & (d[:, 4] <= most)] for d in down])
        stack += [(depth + 1, down[i : i + chunk]) for i in range(0, len(down), chunk)]
    return linker.root


def _split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        up = open_ & ((fp[np.minimum(mid, len(fp) - 1)] & bit) == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def blocks(bits: int, most: int) -> list[tuple[int, int]]:
    """(shift, width) of most + 1 blocks: fingerprints within ``most`` bits agree in one of them."""
    edges = [bits * k // (most + 1) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rest(fp: Column, shift: int, width: int) -> Column:
    """The bits outside a block, side by side."""
    low = fp.bitwiseAND(F.lit((1 << shift) - 1))
    high = F.shiftleft(F.shiftrightunsigned(fp, shift + width), shift) if shift + width < 64 else F.lit(0).cast("long")
    return low.bitwiseOR(high)


def near(spark: SparkSession, fps: DataFrame, most: int, hot: int = 200_000) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps`` (fp) wherever two differ in at most ``most`` bits.

    Each fingerprint goes once for each of most + 1 blocks to the shard of the block's value; two within the
    budget meet in a shard at least, whose trie is joined with itself. A shard of over ``hot`` fingerprints is
    split the same way by blocks of the other bits: two that agree in the first block differ in those alone, so
    they agree in one of most + 1 of them. That makes (most + 1) ** 2 copies of a row at most. A shard yields a
    link from each row to its component's least one: no pairs.
    """
    part = lambda c, shift, width: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << width) - 1))
    sub = lambda j, c: F.struct(F.lit(j).alias("j"), c.cast("long").alias("v"))
    parts = []
    for k, (shift, width) in enumerate(blocks(64, most)):
        subs = F.array(*(sub(j, part(_rest(F.col("fp"), shift, width), *own)) for j, own in enumerate(blocks(64 - width, most))))
        parts.append(fps.select(F.lit(k).alias("block"), part(F.col("fp"), shift, width).alias("value"), "fp", subs.alias("subs")))
    rows = reduce(DataFrame.unionAll, parts)
    sizes = rows.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    sizes = sizes.select(F.col("block").alias("hb"), F.col("value").alias("hv"))
    marked = rows.join(sizes, (F.col("block") == F.col("hb")) & (F.col("value") == F.col("hv")), "left")
    plain = F.array(sub(-1, F.lit(-1)))
    sharded = marked.select("value", "block", F.explode(F.when(F.col("hb").isNull(), plain).otherwise(F.col("subs"))).alias("s"), "fp")
    shard = F.xxhash64("block", "value", "s.j", "s.v")
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sharded.select(shard.alias("shard"), "fp").repartition(parts_n, "shard").sortWithinPartitions("shard", F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def link(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            root = trie_links(g, f.view(np.uint64), most)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(f[own]), pa.array(f[root[own]])], names=["a", "b"])

        held_g, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held_g = np.concatenate((held_g, batch.column(0).to_numpy()))
            held_f = np.concatenate((held_f, batch.column(1).to_numpy()))
            last = np.searchsorted(held_g, held_g[-1]) if len(held_g) else 0  # the last shard may go on
            if last >= 100_000:
                yield link(held_g[:last], held_f[:last].copy())
                held_g, held_f = held_g[last:], held_f[last:]
        if len(held_g):
            yield link(held_g, held_f.copy())

    return dealt.mapInArrow(run, "a long, b long")


def named_components(spark: SparkSession, fps: DataFrame, most: int) -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``fps`` (doc_id, fp), which is read twice: root stands for the component, component_id is its least doc_id."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(near(spark, distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(rooted.select("fp", "root").join(ids, "root"), "components")


def classes(spark: SparkSession, fps: DataFrame, most: int) -> DataFrame:
    """``fps`` (doc_id, fp) with the root and component_id of ``named_components``."""
    fps = stored(fps, "fingerprints")
    return fps.join(named_components(spark, fps, most), "fp")


def simhash_dedup(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """The documents that stay: of each component of near copies, the row with the least doc_id.

    The columns are those of ``docs``. Null ids come last, and of rows that repeat an id within a component
    one stays, chosen by the other columns. Documents without words have fingerprint 0 and link as any other.
    An empty table gives an empty table.
    """
    own = carried(docs)
    spark = docs.sparkSession
    rows = own.df.withColumn("k", F.xxhash64(F.coalesce(own.at("text"), F.lit(""))))
    base = stored(
        per_row(
            rows.select(F.col(own.at("doc_id")).alias("doc_id"), "k", F.col(own.at("text")).alias("text")),
            f"doc_id {rows.schema[own.at('doc_id')].dataType.simpleString()}, k long, fp long",
            lambda: (lambda doc_id, k, text, signed=lambda f: f - (1 << 64) if f >> 63 else f: (doc_id, k, signed(fingerprint(text, words)))),
        ),
        "simhash-rows",
    )
    first = base.join(named_components(spark, base.select("doc_id", "fp"), most), "fp")
    first = first.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("one")).select(F.col("one.doc_id").alias("sid"), F.col("one.k").alias("sk"))
    joined = rows.join(first, F.col(own.at("doc_id")).eqNullSafe(F.col("sid")) & (F.col("k") == F.col("sk")), "left_semi")
    return own.back(joined)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classes(spark, fingerprints(docs, 4), 4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
