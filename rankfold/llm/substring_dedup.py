"""Substring dedup: MinHash banding over paragraphs, exact Jaccard, components; repeated passages of any place by word grams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import dropped, id_and_text, per_batch, pieces, stored
from rankfold.llm.components import components
from rankfold.llm.words import Sketch, Words, mixed, name_hash

#: 6 bands of 2 rows: of pairs at Jaccard 0.8, 99.8 percent share a band; at 0.9, 99.995
BANDS, ROWS, WORDS = 6, 2, 5
#: passages are told by their grams of GRAM words; a gram is dealt by the least hash of its SEED-word shingles
GRAM, SEED = 15, 8
#: spans fewer words apart are one passage, with what stands between
APART = 5
#: edits part a passage: so many words at most may stand between two spans that keep their distance to one first text
BRIDGE = 2 * GRAM
#: the least passage of the query that no edit has parted
QUERY_WORDS = 50
#: bits of the sketches that say which seeds and paragraphs repeat
SKETCH = 1 << 26
#: in a mask of a run's grams, SEED at most: their first ones stand in the run's own text
OWN = 1 << SEED
#: hashes that a task deals out at once
DEALT = 1 << 20
#: a band key of at most so many paragraphs is one list
LISTED = 64
_rng = np.random.default_rng(11)
MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Paragraphs:
    """The paragraphs of five words or more of a column of texts: words [start, stop) of text ``text``, number ``at`` in it.

    A paragraph is what stands between blank lines, or a line in a text without them. ``names`` are 128 bits of its
    words' hashes; its shingles are the hashes of five words in a row.
    """

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        text, at, a, b = self.words.paragraphs()
        long = b - a >= WORDS
        self.text, self.at, self.start, self.stop = text[long], at[long], a[long], b[long]
        raw = memoryview(self.words.hashes.tobytes())
        self.names = [xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) for i, j in zip(self.start.tolist(), self.stop.tolist())]
        self.hashes = self.words.shingles(WORDS)

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.hashes[self.start[i] : self.stop[i] - WORDS + 1])

    def band_keys(self) -> np.ndarray:
        """One row for each band: the keys of the paragraphs' MinHash signatures."""
        padded, keys = np.append(self.hashes, np.uint64(0)), []
        bounds = np.column_stack((self.start, self.stop - WORDS + 1)).ravel()
        for band in range(BANDS):
            key = np.full(len(self.start), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mixed(key, np.minimum.reduceat(padded * MULTIPLIERS[k] + SHIFTS[k], bounds)[::2])
            keys.append(key.view(np.int64))
        return np.array(keys)


def forest(group: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what all pairs of a group at ``similarity`` or more connect.

    From one member on, each one reached is compared with all not reached yet, by one count over their
    hashes; those linked to it are reached. So a group of near copies costs a few counts and no list of pairs.
    """
    if len(group) == 2:
        (p, a), (q, b) = group
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(p, q)] if both >= similarity * (len(a) + len(b) - both) else []
    links, left = [], np.arange(1, len(group))
    sizes = np.array([len(h) for _, h in group])
    queue = [0]
    flat, owner = np.concatenate([h for _, h in group]), np.repeat(np.arange(len(group)), sizes)
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        both = np.bincount(owner[np.isin(flat, group[x][1])], minlength=len(group))[left]
        near = both >= similarity * (sizes[left] + sizes[x] - both)
        links += [(group[x][0], group[int(k)][0]) for k in left[near]]
        queue += left[near].tolist()
        if near.any():
            left = left[~near]
            if len(flat) > 2 * sizes[left].sum() + 1000:
                stay = np.isin(owner, left)
                flat, owner = flat[stay], owner[stay]
    return links


def _over(rows: DataFrame, schema: str, make: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Map the rows piece by piece, each as one batch of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch)):
            if (out := make(piece)) is not None and out.num_rows:
                yield out

    return rows.mapInArrow(run, schema)


def _found(rows: DataFrame, kind: str) -> DataFrame:
    """Every paragraph with its place, its name and its band keys."""
    bands = [f"b{k}" for k in range(BANDS)]

    def make(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        ps = Paragraphs(piece.column(1))
        if not ps.names:
            return None
        each = {
            "doc_id": piece.column(0).take(pa.array(ps.text)),
            "rid": pa.array(ps.words.rids[ps.text]),
            "at": pa.array(ps.at.astype(np.int32)),
            "start": pa.array((ps.start - ps.words.first[ps.text]).astype(np.int32)),
            "words": pa.array((ps.stop - ps.start).astype(np.int32)),
            "p": pa.array(ps.names, pa.binary()),
            **{b: pa.array(k) for b, k in zip(bands, ps.band_keys())},
        }
        return pa.RecordBatch.from_arrays(list(each.values()), names=list(each))

    return _over(rows, f"doc_id {kind}, rid long, at int, start int, words int, p binary, " + ", ".join(f"{b} long" for b in bands), make)


def repeated_hashes(rows: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(h): the hashes, of all that ``make`` gives for the pieces of rows, that stand there more than once, as longs.

    They are dealt by buckets of hashes, of which a task holds one at a time. A row of the shuffle has a bucket's
    share of up to DEALT hashes, so Spark moves and sorts few rows; of a hash that stands there often go two.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts

    def dealt(hashes: np.ndarray) -> pa.RecordBatch:
        h, n = np.unique(hashes, return_counts=True)
        h = np.concatenate((h, h[n > 1]))
        bucket = (h % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, h = bucket[order], h[order]
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        edges = (8 * np.append(heads, len(h))).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(edges), pa.py_buffer(h)])
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads]), lists], names=["bucket", "hashes"])

    def whole(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        return (dealt(hashes[k : k + 2 * DEALT]) for k in range(0, len(hashes), 2 * DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for piece in (p for batch in batches for p in pieces(batch)):
            held += [h] if len(h := make(piece)) else []
            if sum(map(len, held)) >= DEALT:
                yield from whole(held)
                held = []
        if held:
            yield from whole(held)

    def several(lists: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(lists))
        same = h[1:] == h[:-1]
        return pa.RecordBatch.from_arrays([pa.array(h[1:][same & ~np.append(False, same[:-1])].view(np.int64))], names=["h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield several(held)
                    held = []
                now = bucket
                held.append(np.frombuffer(hashes.as_buffer(), np.uint64))
        if held:
            yield several(held)

    return rows.mapInArrow(deal, "bucket int, hashes binary").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "h long")


def _shared_keys(names: DataFrame) -> DataFrame:
    """(key, p): the band keys that names (p and its keys) share, and the few that a sketch of them lets through."""
    rows = lambda batch: np.array([np.asarray(c) for c in batch.columns[-BANDS:]]).view(np.uint64)
    sketch = Sketch(repeated_hashes(names, lambda piece: rows(piece).ravel()), SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = rows(batch)
            band, at = np.nonzero(sketch.may_hold(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys[band, at].view(np.int64)), batch.column(0).take(pa.array(at))], names=["key", "p"])

    return names.mapInArrow(run, "key long, p binary")


def _shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, hashes) for the wanted paragraphs ``p``, and the few that a sketch of them lets through."""
    sketch = Sketch(wanted.select(name_hash(F.col("p")).alias("h")), SKETCH)

    def make(piece: pa.RecordBatch) -> pa.RecordBatch:
        ps = Paragraphs(piece.column(1))
        held = sketch.may_hold(np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in ps.names), np.uint64, len(ps.names)))
        own = {ps.names[i]: i for i in np.flatnonzero(held).tolist()}
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([ps.shingles(i).tobytes() for i in own.values()], pa.binary())], names=["s", "hashes"])

    return stored(_over(rows, "s binary, hashes binary", make).dropDuplicates(["s"]), "shingle-sets")


def _tasks(members: DataFrame, most: int) -> DataFrame:
    """(task, p): what is to be compared with one another; members are (key, p, g), g of a key.

    A list of up to LISTED paragraphs that several bands give is taken once. Of more than ``most``, all pairs of
    chunks of that size are tasks, so none is unbounded and no pair is lost.
    """
    lists = members.filter(F.col("g") <= LISTED).groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    lists = lists.groupBy(F.xxhash64("ps").alias("l1"), F.xxhash64(F.lit(1), "ps").alias("l2")).agg(F.min("key").alias("key"), F.first("ps").alias("ps"))
    short = lists.select(F.xxhash64("key", F.lit(-1)).alias("task"), F.explode("ps").alias("p"))
    chunks = F.ceil(F.col("g") / most)
    own = F.pmod(F.xxhash64("p"), chunks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda c: F.struct(F.least(own, c).alias("lo"), F.greatest(own, c).alias("hi")))
    long = members.filter(F.col("g") > LISTED).select("p", "key", F.explode(pairs).alias("t")).select(F.xxhash64("key", "t.lo", "t.hi").alias("task"), "p")
    return short.unionAll(long)


def _links(members: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b): links that connect the similar paragraphs of each band."""
    dealt = _tasks(members, most).join(sets, F.col("p") == F.col("s")).select("task", "p", "hashes")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "task").sortWithinPartitions("task", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[bytes, np.ndarray]] = []
        now = None

        def out() -> pa.RecordBatch:
            a, b = zip(*e) if (e := forest(group, similarity)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            for task, p, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now and group:
                    yield out()
                    group = []
                now = task
                group.append((p, np.frombuffer(hashes, np.uint64)))
        if group:
            yield out()

    return dealt.mapInArrow(run, "a binary, b binary")


def merged(spans: list[tuple[int, int]], apart: int = 0) -> list[tuple[int, int]]:
    """The union of [start, stop) spans; those that touch, or stand fewer than ``apart`` words apart, become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + max(0, apart - 1):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def lengths(spans: list[tuple[int, int]]) -> list[int]:
    """For each span, the words of the run of touching spans that it stands in."""
    joined = merged(spans)
    heads = [a for a, _ in joined]
    return [b - a for x, _ in spans for a, b in [joined[bisect_right(heads, x) - 1]]]


def grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(firsts, sizes, seeds, hashes) of the runs of GRAM-word grams: run k is ``sizes[k]`` grams from word ``firsts[k]`` on.

    A gram's seed is the least hash of its SEED-word shingles, so equal grams have equal seeds. Grams of a text
    follow one another in runs of one seed, about 4.5 long and 8 at most, and no hash stands twice in a run.
    hashes has those of all runs' grams, in order.
    """
    none = np.zeros(0, np.int64)
    each, count = words.hashes, len(words.hashes) - GRAM + 1
    if count <= 0:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for step in (1, 2, 4):
        each = mixed(each[:-step], each[step:])
    hashes, least = mixed(each[:count], each[GRAM - SEED :]), each
    for step in (1, 2, 4):
        least = np.minimum(least[:-step], least[step:])
    ends = np.repeat(words.first[1:], np.diff(words.first))[:count]
    at = np.flatnonzero(np.arange(count) + GRAM <= ends)
    hashes, least = hashes[at], least[at]
    if not len(at):
        return none, none, np.zeros(0, np.uint64), hashes
    new = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    for lag in range(1, min(SEED, len(new)) + 1):
        new[lag - 1 :] |= hashes[lag:] == hashes[:-lag]
    starts = np.concatenate(([0], np.flatnonzero(new) + 1))
    sizes = np.diff(starts, append=len(at))
    if sizes.max() > SEED:  # where a shingle returns before it ends
        starts = np.flatnonzero((np.arange(len(at)) - np.repeat(starts, sizes)) % SEED == 0)
        sizes = np.diff(starts, append=len(at))
    return at[starts], sizes, least[starts], hashes


def _seeds(rows: DataFrame) -> DataFrame:
    """(seed): those that more than one run has."""
    return repeated_hashes(rows.select("text"), lambda piece: grams(Words(piece.column(0)))[2]).withColumnRenamed("h", "seed")


def _runs_of_grams(rows: DataFrame, kind: str, seeds: Sketch) -> DataFrame:
    """(doc_id, rid, start, seed, like, grams): the runs of grams of each text whose seed may be one of ``seeds``.

    A gram is 32 bits of its hash; ``like`` is a hash of all grams of the run, in order.
    """

    def make(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        words = Words(piece.column(1))
        first, sizes, own, hashes = grams(words)
        held = seeds.may_hold(own)
        if not held.any():
            return None
        hashes = hashes[np.repeat(held, sizes)]
        first, sizes, own = first[held], sizes[held], own[held]
        heads = np.cumsum(sizes) - sizes
        like = np.add.reduceat(hashes * MULTIPLIERS[np.arange(len(hashes)) - np.repeat(heads, sizes)], heads)
        values = hashes.astype(np.uint32).view(np.int32)
        text = np.searchsorted(words.first, first, "right") - 1
        columns = [
            piece.column(0).take(pa.array(text)),
            pa.array(words.rids[text]),
            pa.array((first - words.first[text]).astype(np.int32)),
            pa.array(own.view(np.int64)),
            pa.array(like.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.append(heads, len(values)).astype(np.int32)), pa.array(values)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "start", "seed", "like", "grams"])

    return _over(rows, f"doc_id {kind}, rid long, start int, seed long, like long, grams array<int>", make)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, spans, keeps, kept, bridges): the words of each text that repeat, word for word, a passage that stands before.

    A passage is GRAM words or more, amid any other words and wherever lines break. Every gram of a text whose
    like has a lesser place (doc_id, rid, start), null ids last, is in the spans to its last word; of grams that
    overlap their own like, only the words behind it. keeps are the ids where the first ones stand; kept are the
    spans of a text's grams that stand there first and again later, in this text or another. bridges are the words
    between two spans that repeat one other text, if they are BRIDGE or fewer and the distance to that text changes
    by as many at most: what an edit has left of a copied passage.

    The texts are read twice: for the seeds that more than one run has, and for the runs that a sketch of them, of
    a fixed size, lets through. Runs of the same grams are looked up once. Equal grams are told by a 64-bit seed
    and 32 bits more.
    """
    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    twice = stored(_seeds(rows), "repeated-seeds")
    found = _runs_of_grams(rows, kind, Sketch(twice, SKETCH))
    found = found.join(twice.withColumnRenamed("seed", "twice"), F.col("seed") == F.col("twice"), "left_semi")
    found = stored(found, "repeated-runs")
    dropped(twice)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "start")
    kinds = stored(found.groupBy("seed", "like").agg(F.min(place).alias("p"), F.count("*").alias("n"), F.first("grams").alias("grams")), "kinds-of-runs")
    # most seeds have one kind of run, whose grams have their first ones in its first run; grams that kinds may share are looked up one by one
    mixed_ = kinds.groupBy(F.col("seed").alias("s")).agg(F.count("*").alias("kinds")).filter("kinds > 1")
    kinds_ = stored(kinds.join(mixed_, F.col("seed") == F.col("s"), "left").filter("kinds > 1 or n > 1").drop("s"), "kinds-of-repeated-runs")
    dropped(kinds)
    size = F.size("grams")
    alone = kinds_.filter("kinds is null").select(
        F.col("seed").alias("ks"), F.col("like").alias("kl"), F.col("p.doc_id").alias("fdoc"), F.col("p.rid").alias("frid"), F.col("p.start").alias("fstart"),
        (F.call_function("shiftleft", F.lit(1), size) - 1).alias("mask"),
    )
    each = kinds_.filter("kinds > 1").select("seed", "like", "p", "n", F.posexplode("grams").alias("at", "gram"))
    first = F.struct("p.last", "p.doc_id", "p.rid", (F.col("p.start") + F.col("at")).alias("start"))
    firsts = each.groupBy(F.col("seed").alias("s"), F.col("gram").alias("g")).agg(F.min(first).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    firsts = stored(firsts.select("s", "g", F.col("first.doc_id").alias("fdoc"), F.col("first.rid").alias("frid"), F.col("first.start").alias("fstart")), "gram-firsts")
    # the grams of a kind of run whose first ones stand in one text, one behind the other: their numbers are bits of a mask
    known = each.select("seed", "like", "at", "gram").join(firsts, (F.col("seed") == F.col("s")) & (F.col("gram") == F.col("g")))
    known = known.groupBy(F.col("seed").alias("ks"), F.col("like").alias("kl"), "fdoc", "frid", (F.col("fstart") - F.col("at")).alias("fstart"))
    known = stored(known.agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("mask")).unionByName(alone), "known-runs")
    dropped(kinds_)
    dropped(firsts)
    met = found.select("doc_id", "rid", "start", "seed", "like").join(known, (F.col("seed") == F.col("ks")) & (F.col("like") == F.col("kl")))
    own = F.col("doc_id").eqNullSafe(F.col("fdoc")) & (F.col("rid") == F.col("frid"))
    mask = F.when(own, F.col("mask") + OWN).otherwise(F.col("mask")).alias("mask")
    met = met.select("doc_id", "rid", F.xxhash64("doc_id", "rid").alias("name"), "start", mask, "fdoc", F.xxhash64("fdoc").alias("fid"), F.xxhash64("fdoc", "frid").alias("fname"), "fstart")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "rid", "name").sortWithinPartitions("rid", "name")
    spans = "array<struct<start:int,stop:int>>"
    out = stored(met.mapInArrow(_of_texts, f"doc_id {kind}, rid long, spans {spans}, keeps array<{kind}>, kept {spans}, bridges {spans}"), "exact-passages")
    dropped(found)
    dropped(known)
    return out


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text that met first ones, which stand together, as one row of ``passages``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rid, name = (np.asarray(batch.column(k)) for k in (1, 2))
        ends = np.flatnonzero((rid[1:] != rid[:-1]) | (name[1:] != name[:-1])) + 1
        if held and batch.num_rows and (held[-1].column(1)[-1], held[-1].column(2)[-1]) != (batch.column(1)[0], batch.column(2)[0]):
            ends = np.append(0, ends)
        if len(ends):  # the last text may go on
            yield _passages_of([*held, batch.slice(0, int(ends[-1]))])
            batch, held = batch.slice(int(ends[-1])), []
        held += [batch] if batch.num_rows else []
    if held:
        yield _passages_of(held)


def _passages_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for each text of these runs."""
    table = pa.Table.from_batches(batches).combine_chunks()
    doc_id, fdoc = (table[k].combine_chunks() for k in ("doc_id", "fdoc"))
    rid, name, start, mask, fid, fname, fstart = (table[k].to_numpy().astype(np.int64) for k in ("rid", "name", "start", "mask", "fid", "fname", "fstart"))
    bits = mask[:, None] >> np.arange(SEED) & 1 > 0
    low, high, own = bits.argmax(1), SEED - 1 - bits[:, ::-1].argmax(1), mask >= OWN
    here = own & (start == fstart)
    heads = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (name[1:] != name[:-1])))
    n, row = len(heads), np.repeat(np.arange(len(heads)), np.diff(heads, append=len(rid)))
    span = lambda a, b: (a << 32) + b
    # a run is shorter than a gram, so such grams cover one span, unless they overlap their own like
    whole = span(start + low, start + high + GRAM)
    at, k = np.nonzero(bits & (own & ~here)[:, None])
    again = span(np.maximum(start[at], fstart[at] + GRAM) + k, start[at] + GRAM + k)
    line = (fname & ~((1 << 32) - 1)) + ((fstart - start) & ((1 << 32) - 1))
    told = np.flatnonzero(~here & np.asarray(fdoc.is_valid()))
    told = told[np.lexsort((fid[told], row[told]))]
    told = told[np.append(True, (fid[told][1:] != fid[told][:-1]) | (row[told][1:] != row[told][:-1]))] if len(told) else told
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)), values)
    others, stay = np.flatnonzero(~own), np.flatnonzero(here)
    gone = lists(others, pa.array(whole[others]))
    columns = [
        doc_id.take(pa.array(heads)), pa.array(rid[heads]), _merged(gone, lists(at, pa.array(again))), lists(told, fdoc.take(pa.array(told))),
        _merged(lists(stay, pa.array(whole[stay]))), _bridges(gone, lists(others, pa.array(line[others]))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "spans", "keeps", "kept", "bridges"])


def _flat(*lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of columns of lists, and the row of each."""
    rows = [np.repeat(np.arange(len(x)), np.diff(np.asarray(x.offsets))) for x in lists]
    return np.concatenate([np.asarray(x.flatten()) for x in lists]), np.concatenate(rows)


def _spans(n: int, row: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """n lists of (start, stop), from the spans of all in order of their rows."""
    values = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def _merged(*lists: pa.Array) -> pa.Array:
    """As ``merged``, for the spans (start, stop), as start * 2 ** 32 + stop, of each row's lists."""
    flat, row = _flat(*lists)
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    a, b = (flat >> 32) + (row << 32), (flat & ((1 << 32) - 1)) + (row << 32)  # rows one behind the other on one line
    reach = np.maximum.accumulate(b)
    new = np.append(True, (a[1:] > reach[:-1]) | (row[1:] != row[:-1])) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    starts, stops = a[at] & ((1 << 32) - 1), reach[np.append(at[1:], len(a)) - 1] & ((1 << 32) - 1) if len(at) else at
    return _spans(len(lists[0]), row[at], starts, stops)


def _bridges(spans: pa.Array, lines: pa.Array) -> pa.Array:
    """The words between neighbouring spans of one other text, by ``lines``: 32 bits of its name, 32 of the distance to it."""
    flat, row = _flat(spans)
    line, _ = _flat(lines)
    text, far = line >> 32, line.astype(np.int32).astype(np.int64)
    order = np.lexsort((flat, text, row))
    row, text, far, start, stop = row[order], text[order], far[order], flat[order] >> 32, flat[order] & ((1 << 32) - 1)
    between = start[1:] - stop[:-1]
    near = (row[1:] == row[:-1]) & (text[1:] == text[:-1]) & (between > 0) & (between <= BRIDGE) & (np.abs(far[1:] - far[:-1]) <= BRIDGE)
    at = np.flatnonzero(near)
    return _spans(len(spans), row[at], stop[at], start[at + 1])


def exact_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, spans, keeps) of ``passages``, of the texts that have spans."""
    return passages(docs).filter(F.size("spans") > 0).drop("kept", "bridges")


def repeats(docs: DataFrame, similarity: float = 0.8, most: int = 4000) -> DataFrame:
    """(doc_id, rid, items): of each text with repeated paragraphs, these as (at, start, words, class, keep_doc, other), in order.

    Different paragraphs that share a band are linked if the exact Jaccard of their sets of five-word shingles is
    ``similarity`` or more. Links make classes, and paragraphs of the same words are one. Of a class the paragraph
    with the least (doc_id, rid, at) stays, null ids last; others are ``other``.

    Copies are counted before the bands, so the copies of a text weigh as one in a band, and hot lines don't meet.
    """
    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = stored(_found(rows, kind), "paragraphs")
    bands = [f"b{k}" for k in range(BANDS)]
    names = stored(found.groupBy("p").agg(F.count("*").alias("n"), *(F.min(b).alias(b) for b in bands)), "names")
    keys = stored(_shared_keys(names.select("p", *bands)), "shared-bands")
    shared = keys.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("g")).filter("g > 1")
    members = stored(keys.join(shared, F.col("key") == F.col("k")).select("key", "p", "g"), "candidates")
    sets = _shingle_sets(rows, members.select("p").distinct())
    classes = components(_links(members, sets, similarity, most)).withColumnRenamed("node", "m")
    marks = names.select("p", "n").join(classes, F.col("p") == F.col("m"), "left").filter("n > 1 or m is not null")
    marks = stored(marks.select(F.col("p").alias("kp"), F.coalesce("root", "p").alias("class")), "repeated-names")
    for t in (keys, members, sets, names):
        dropped(t)
    hits = stored(found.drop(*bands).join(marks, F.col("p") == F.col("kp")).drop("p", "kp"), "repeats")
    dropped(found)
    dropped(marks)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "at")
    firsts = stored(hits.groupBy("class").agg(F.min(place).alias("keep")).select(F.col("class").alias("c"), "keep"), "class-firsts")
    item = F.struct("at", "start", "words", F.col("class"), F.col("keep.doc_id").alias("keep_doc"), (place != F.col("keep")).alias("other"))
    marked = hits.join(firsts, F.col("class") == F.col("c"))
    return marked.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set(item)).alias("items"))


def substring_dedup(docs: DataFrame, min_words: int = 15, similarity: float = 0.8, most: int = 4000) -> DataFrame:
    """(doc_id, rid, at, start, words, class, keep_doc, run, removed): one row for each repeated paragraph.

    Number ``at`` of a text is ``words`` words from word ``start`` on; rid is the text's hash (see ``Paragraphs`` and
    ``repeats``). Paragraphs that don't stay go if they stand in a run of repeated paragraphs of at least
    ``min_words`` words. Null, empty and short texts have no paragraphs. Rows that repeat an id and its text count
    as repeats but appear once, and that of the row that stays is kept. An empty table gives an empty table.
    """
    marked = repeats(docs, similarity, most)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[..., Iterator[tuple]]:
        def run(ids: list, rids: list, lists: list) -> Iterator[tuple]:
            for doc_id, rid, items in zip(ids, rids, lists):
                for x, n in zip(items, lengths([(x["start"], x["start"] + x["words"]) for x in items])):
                    yield doc_id, rid, x["at"], x["start"], x["words"], x["class"], x["keep_doc"], n, x["other"] and n >= min_words

        return run

    return per_batch(marked, f"doc_id {kind}, rid long, at int, start int, words int, class binary, keep_doc {kind}, run int, removed boolean", make)


def removals(docs: DataFrame, min_words: int = 15) -> DataFrame:
    """(doc_id, n, k, spans, keeps): repeated and removed passages; the words that go, in disjoint spans, and where they stay.

    A passage is the union of repeated paragraphs and exact passages that touch or stand fewer than APART words
    apart, with what stands between, of ``min_words`` words or more. n counts passages, first ones included; k
    those that go, of the paragraphs and words that stay elsewhere. Spans that an edit has parted are one passage
    with the words of the edit (see ``passages``); of such a passage the pieces need not have ``min_words``, as two
    runs of GRAM words at one distance to another text tell a copy. Rows with the same id are taken together.
    """
    span = "array<struct<start:int,stop:int>>"
    both = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["words"]).alias("stop")))
    near = repeats(docs).select(
        "doc_id", "rid", both(F.filter("items", lambda x: x["other"])).alias("gone"), both(F.filter("items", lambda x: ~x["other"])).alias("stay"),
        F.transform(F.filter("items", lambda x: x["other"]), lambda x: F.struct(x["start"].alias("start"), x["keep_doc"].alias("keep"))).alias("keeps"), F.array().cast(span).alias("bridges"),
    )
    exact = passages(docs).select("doc_id", "rid", F.col("spans").alias("gone"), F.col("kept").alias("stay"), F.transform("keeps", lambda x: F.struct(F.lit(None).cast("int").alias("start"), x.alias("keep"))).alias("keeps"), "bridges")
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    texts = near.unionByName(exact).groupBy("doc_id", "rid").agg(flat("gone"), flat("stay"), flat("keeps"), flat("bridges"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def make() -> Callable[..., Iterator[tuple]]:
        def run(ids: list, rids: list, gone: list, stay: list, keeps: list, bridges: list) -> Iterator[tuple]:
            pairs = lambda xs: [(x["start"], x["stop"]) for x in xs]
            for doc_id, g, s, ks, over in zip(ids, gone, stay, keeps, bridges):
                edits = sorted(x["start"] for x in over)
                whole = lambda x: x[1] - x[0] >= min_words or (k := bisect_left(edits, x[0])) < len(edits) and edits[k] < x[1]
                out = [x for x in merged(pairs([*g, *over]), APART) if whole(x)]
                every = sum(map(whole, merged(pairs([*g, *over, *s]), APART)))
                heads = [a for a, _ in out]
                within = lambda a: a is None or ((i := bisect_right(heads, a) - 1) >= 0 and a < out[i][1])
                keep = sorted({k["keep"] for k in ks if k["keep"] is not None and within(k["start"])}) if out else []
                if every:
                    yield doc_id, every, len(out), [{"start": a, "stop": b} for a, b in out], keep

        return run

    one = per_batch(texts, f"doc_id {kind}, n long, k long, spans {span}, keeps array<{kind}>", make)
    one = one.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), flat("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keeps")))).alias("keeps"))

    def make_text() -> Callable[..., Iterator[tuple]]:
        def run(ids: list, ns: list, ks: list, spans: list, keeps: list) -> Iterator[tuple]:
            for doc_id, n, k, x, keep in zip(ids, ns, ks, spans, keeps):
                yield doc_id, n, k, ",".join(f"{a}-{b}" for a, b in merged([(y["start"], y["stop"]) for y in x])), keep

        return run

    return per_batch(one, f"doc_id {kind}, n long, k long, spans string, keeps array<{kind}>", make_text)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_repeated and n_removed passages, removed words (start-stop, comma-joined), keep_ids (where they stay).

    Passages of 50 words or more, as is common practice, and copies that edits have parted, however short the pieces.
    Other shorter ones are found too, at the same cost, but they are stock phrases, and documents with no others are
    left alone.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = removals(docs, min_words=QUERY_WORDS).withColumnRenamed("doc_id", "id")
    joined = docs.select("doc_id").join(out, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_repeated"), F.coalesce("k", F.lit(0)).alias("n_removed"),
        F.coalesce("spans", F.lit("")).alias("removed_words"), F.coalesce("keeps", F.array().cast("array<long>")).alias("keep_ids"),
    )


SQL: dict[str, str] = {}
