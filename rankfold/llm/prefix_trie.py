"""Conversation prefix trie: chained prefix digests, nodes by (depth, digest), subtree sums by exploding to ancestors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.llm.common import per_row, stored, words_of

#: turns that one row of a chain holds; a longer conversation is chained block by block
BLOCK = 512
ROOT = bytes(16)
NODE = ["depth", "digest"]


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def chain(start: bytes, keys: Iterable[bytes]) -> list[bytes]:
    """digest(start, key 1), then each digest with the next key."""
    out = []
    for key in keys:
        out.append(start := digest(start, key))
    return out


def numbered(turns: DataFrame, conv: str, *order: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``turns`` in order, stored, with their places and parts, and for each (part, conversation) what numbers them.

    A range partitioning cuts a long conversation anywhere, so none is ever in one task; the counts of its parts
    say how many of its rows stand in earlier ones. Gives the stored rows and the runs (part, conv, first, ahead, n).
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartitionByRange(parts, conv, *order).sortWithinPartitions(conv, *order)
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()), "trie-turns").withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("part", conv).agg(F.count("*").alias("here"), F.min("place").alias("first"))
    of = Window.partitionBy(conv)
    ahead = F.coalesce(F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, runs.select("part", conv, "first", ahead.alias("ahead"), F.sum("here").over(of).alias("n"))


def rebuilt(conversations: DataFrame, every: int, borrow: int) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv, base, take, len) and their turns (conv, depth, len, key, words) after rebuilding.

    Conversation c starts with the first h turns of c - c % ``every`` and goes on with its own after the first h,
    where h is crc32 of c modulo ``borrow``.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.size(words_of(text)).alias("words")).filter("conv is not null")
    placed, runs = numbered(stored(rows, "trie-digests"), "conv", F.col("turn").asc_nulls_first(), F.col("key"))
    runs = stored(runs, "trie-runs")
    sizes = runs.filter("ahead = 0").select("conv", "n")
    own = sizes.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", F.crc32(F.col("conv").cast("string")) % borrow)
    found = own.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = found.select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("take"), "n")
    convs = stored(convs.withColumn("len", F.col("take") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "trie-convs")
    of_run = runs.select("part", "conv", "first", "ahead").join(convs.select("conv", "h", "take", "len"), "conv")
    turns = placed.join(of_run, ["part", "conv"]).withColumn("at", F.col("ahead") + F.col("place") - F.col("first") + 1)
    turns = stored(turns.select("conv", "at", "h", "take", "len", "key", "words"), "trie-numbered")
    after = turns.filter("at > h").select("conv", (F.col("at") - F.col("h") + F.col("take")).alias("depth"), "len", "key", "words")
    lent = turns.filter((F.col("at") < borrow) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "at", "key", "words")
    before = convs.join(lent, "base").filter("at <= take").select("conv", F.col("at").alias("depth"), "len", "key", "words")
    return convs, after.unionByName(before)


def chains(turns: DataFrame) -> DataFrame:
    """(conv, block, len, digests, words): the prefix digests of each conversation, at most BLOCK in a row.

    A digest is chained from the one before it within its block, and the digests of later blocks are mixed with
    the chain of all earlier blocks' last ones: equal prefixes have equal digests, and a conversation of any
    length is dealt out over many tasks. Only the blocks' last digests meet in one row.
    """
    blocks = turns.groupBy("conv", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(F.max("len").alias("len"), F.sort_array(F.collect_list(F.struct("depth", "key", "words"))).alias("t"))
    shape = "conv long, block long, len long, digests array<binary>, words array<int>"
    links = lambda conv, block, len_, keys, words: (conv, block, len_, chain(ROOT, keys), words)
    within = stored(per_row(blocks.select("conv", "block", "len", "t.key", "t.words"), shape, lambda: links), "trie-blocks")
    long = within.filter(F.col("len") > BLOCK)
    lasts = long.select("conv", F.struct("block", F.element_at("digests", -1).alias("d")).alias("b")).groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("b"))
    heads = per_row(lasts.select("conv", "b.d"), "conv long, heads array<binary>", lambda: lambda conv, ds: (conv, chain(ROOT, ds)))
    heads = heads.select("conv", F.posexplode("heads").alias("b", "head")).select("conv", (F.col("b") + 1).cast("long").alias("block"), "head")
    later = long.filter("block > 0").join(heads, ["conv", "block"]).select("conv", "block", "len", "digests", "words", "head")
    mixed = per_row(later, shape, lambda: lambda conv, block, len_, ds, words, head: (conv, block, len_, [digest(head, d) for d in ds], words))
    return within.filter("block = 0").unionByName(mixed)


def joined_ids(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of (depth, digest, conv): the ids of a node, ascending and comma-joined, hashed.

    A range partitioning cuts the ids of a large node into pieces of at most an Arrow batch, each joined where it
    is. The digest itself is one pass by definition: a task streams the pieces in order and holds one at a time.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depths, digests, ids = (c.to_pylist() for c in batch.columns)
            cuts = [0, *(i for i in range(1, len(ids)) if digests[i] != digests[i - 1]), len(ids)] if ids else [0]
            runs = [(depths[a], digests[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), (pa.int64(), pa.binary(), pa.int64(), pa.string()))], names=["depth", "digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string()))], names=[*NODE, "ends_sha256"])

        node, sha, done = None, hashlib.sha256(), []
        for batch in batches:
            for depth, name, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, name) == node:
                    sha.update(b",")
                else:
                    done += [(*node, sha.hexdigest())] if node else []
                    node, sha = (depth, name), hashlib.sha256()
                sha.update(ids.encode())
            if len(done) >= 1000:
                yield pack(done)
                done = []
        if node:
            yield pack([*done, (*node, sha.hexdigest())])

    by = ["digest", "conv"]
    pieces = ends.select(*NODE, "conv").repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(join, "depth long, digest binary, first long, ids string")
    whole = pieces.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
    return whole.mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def depths(rows: DataFrame, *columns: str) -> DataFrame:
    """Every prefix of chains: (columns, depth, digest, words)."""
    each = rows.select(*columns, "block", F.posexplode(F.arrays_zip("digests", "words")).alias("i", "p"))
    return each.select(*columns, (F.col("block") * BLOCK + F.col("i") + 1).alias("depth"), F.col("p.digests").alias("digest"), F.col("p.words").alias("words"))


def prefix_trie(conversations: DataFrame, every: int = 20, borrow: int = 4) -> DataFrame:
    """The trie of rebuilt conversations: a row a node, from the textless root, with its members' sums.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Takes conv_id, turn, role and text; other columns don't matter. Turns stand by turn, null first;
    turns of one number stand by the SHA-256 digest of their role and text, and repeated rows are turns of their
    own. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out. A
    conversation that is rebuilt without a turn is a member of the root alone. An empty table has no node.

    The smallest member of a node is that of the node below it on its own chain, so conversation c stands for one
    run of nodes, from depth k(c) to its end. Sums along this run are suffix sums; towards the ancestors above
    it the run goes as one sum, exploded to each of the k(c) of them. Texts never move: 32 bytes a turn do.
    """
    convs, turns = rebuilt(conversations, every, borrow)
    rows = chains(turns)
    root = [F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest")]
    prefixes = depths(rows, "conv", "len").unionByName(convs.select("conv", "len", *root, F.lit(0).alias("words")))
    nodes = prefixes.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("len").alias("longest"), F.max("words").alias("words"))
    nodes = stored(nodes.withColumn("own", (F.col("n") - 1) * F.col("words")), "trie-nodes")

    block = F.floor(F.col("depth") / BLOCK).alias("block")
    runs = nodes.groupBy("conv", block).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "n", "own", "longest"))).alias("nodes"), F.sum("own").alias("own"))
    of, last = Window.partitionBy("conv"), F.element_at("nodes", -1)
    runs = runs.withColumns({
        "k": F.min(F.col("nodes")[0]["depth"]).over(of), "end": F.max(last["depth"]).over(of), "total": F.sum("own").over(of),
        "later": F.coalesce(F.sum("own").over(of.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "leaf": F.max(F.when(last["depth"] == last["longest"], 1).otherwise(0)).over(of).cast("long"),
    })
    runs = stored(runs, "trie-runs-of-nodes")
    starts = runs.filter((F.col("k") > 0) & (F.col("block") == F.floor(F.col("k") / BLOCK))).select("conv", "k", "total", "leaf")

    above = rows.join(starts, "conv").filter(F.col("block") * BLOCK + 1 < F.col("k"))
    up = depths(above, "k", "total", "leaf").filter("depth < k").drop("words").unionByName(starts.select("k", "total", "leaf", *root))
    sums = up.groupBy(*NODE).agg(F.sum("total").alias("t"), F.sum("leaf").alias("l"), F.sum((F.col("depth") == F.col("k") - 1).cast("long")).alias("c"))
    forks = above.filter(F.floor((F.col("k") - 2) / BLOCK) == F.col("block")).select("conv", (F.col("k") - 1).alias("depth"), F.get("digests", ((F.col("k") - 2) % BLOCK).cast("int")).alias("digest"))
    forks = stored(forks, "trie-forks")  # so that AQE can split a node of very many children
    to = nodes.select(*NODE, F.col("conv").alias("parent"))
    parents = forks.join(to, NODE).select("conv", "parent").unionByName(starts.filter("k = 1").select("conv").crossJoin(F.broadcast(to.filter("depth = 0").select("parent"))))  # one row

    last_ones = rows.filter(F.col("block") == F.floor((F.col("len") - 1) / BLOCK)).select(F.col("len").alias("depth"), F.element_at("digests", -1).alias("digest"), "conv")
    ends = joined_ids(stored(last_ones.unionByName(convs.filter("len = 0").select(*root, "conv")), "trie-ends"))

    suffix = F.reverse(F.slice(F.aggregate(F.reverse("nodes.own"), F.array("later"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), F.lit(2), F.size("nodes")))
    each = runs.join(parents, "conv", "left").select("conv", "k", "end", "leaf", "parent", F.explode(F.arrays_zip("nodes", suffix.alias("saved"))).alias("x"))
    each = each.select("conv", "k", "end", "leaf", "parent", "x.nodes.*", "x.saved").join(sums, NODE, "left").join(ends, NODE, "left")
    d, plus = F.col("depth"), lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return each.select(
        F.col("conv").alias("conv_id"), "depth", F.when(d == 0, None).when(d > F.col("k"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), ((d < F.col("end")).cast("long") + plus("c")).alias("n_children"), (F.col("leaf") + plus("l")).alias("n_leaves"),
        (F.col("saved") + plus("t")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: fixed values: the remainders of CRC-32 for four bits
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_STEP = lambda c, x: f"xor({c} // 16, {_CRC}[1 + (xor({c}, {x}) & 15)])"

SQL = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM t),
bytes AS (SELECT DISTINCT c, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT) AS b FROM t),
crc AS (SELECT c, xor(list_reduce(flatten(list_transform(b, lambda x: [x % 16, x // 16])), lambda a, x: {_STEP("a", "x")}, 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h FROM bytes),
s AS (SELECT crc.c, h, (SELECT count(*) FROM o WHERE o.c = crc.c - crc.c % 20 AND p <= h) AS m FROM crc),
r AS (SELECT s.c, o.p - h + m AS d, k, w FROM s JOIN o ON o.c = s.c AND o.p > h UNION ALL SELECT s.c, o.p, k, w FROM s JOIN o ON o.c = s.c - s.c % 20 AND o.p <= h),
f AS (SELECT c, d, w, string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM s),
e AS (SELECT c, max(d) AS l, arg_max(key, d) AS key FROM f GROUP BY c),
n AS (SELECT f.d, f.key, min(f.c) AS c, count(*) AS n, max(w) AS w, max(e.l) = f.d AS leaf FROM f JOIN e ON e.c = f.c GROUP BY f.d, f.key),
u AS (SELECT f.d, f.key, sum(n.leaf::INT) AS leaves, sum((n.n - 1) * n.w) AS saved FROM n JOIN f ON f.c = n.c AND f.d <= n.d GROUP BY f.d, f.key),
x AS (SELECT l AS d, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM e GROUP BY l, key),
kids AS (SELECT d - 1 AS d, left(key, 64 * (d - 1)) AS key, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, pn.c AS parent_conv_id, n.n AS n_convs, coalesce(kids.k, 0)::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves,
  u.saved::BIGINT AS saved_tokens, coalesce(x.sha, sha256('')) AS ends_sha256
FROM n JOIN u ON u.d = n.d AND u.key = n.key LEFT JOIN x ON x.d = n.d AND x.key = n.key LEFT JOIN kids ON kids.d = n.d AND kids.key = n.key
LEFT JOIN n AS pn ON pn.d = n.d - 1 AND pn.key = left(n.key, 64 * greatest(n.d - 1, 0)) AND n.d > 0
"""
}
