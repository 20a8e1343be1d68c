"""Cross-tokenizer alignment: overlaps of two tokenizers' tokens, and the id pairs that the corpus links most."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import id_and_text, pieces, stored

#: A unit is white space that starts with a blank or a line feed, and what follows up to the next of that kind. No
#: token of either tokenizer reaches across such a place (``Tokenizers`` checks it), so both end there.
UNIT = re.compile(r"[ \n]\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|[ \n]\s*\Z").findall
#: pairs that a broadcast may hold: 13 bytes each
MOST_HEAVY = 1 << 20
#: products of groups' distinct ids made at once
MOST_PRODUCTS = 1 << 22


def byte_of() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable ones themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Table:
    """The bytes of each id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        return self.flat[np.arange(stops[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - stops + sizes, sizes)]


class Tokenizers:
    """A, a byte-level file of tokenizers on blank and text, and B, a sentencepiece model on the text, which adds the blank."""

    TOGETHER = 1000

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        spec = json.loads(a)
        vocab, to_byte = spec["model"]["vocab"], byte_of()
        names = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        names |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.table_a = Table([names.get(i, b"") for i in range(max(names) + 1)])
        texts = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        own = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(texts)]
        self.table_b = Table(own)
        self.blank = self.b.piece_to_id("▁")
        if max(len(names), len(own), max(names) + 1) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        inner = [t for i, t in enumerate(texts) if not self.b.is_byte(i) and ("▁" in t.lstrip("▁") or "\n" in t)]
        if inner or self.b.encode("\n", out_type=int)[:1] != [self.blank] or self.b.encode("a  b", out_type=str) == self.b.encode("a b", out_type=str):
            raise ValueError("B's pieces reach across blanks or lines, or B changes blanks; units can't be told")

    def units(self, text: str) -> list[str]:
        """Of blank and text, cut where both tokenizers cut; one unit if the text has B's own sign for a blank."""
        whole = " " + text
        found = UNIT(whole) if "▁" not in text else []
        return found if sum(map(len, found)) == len(whole) else [whole]

    def encode_a(self, text: str) -> list[int]:
        """Of units, run together."""
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_b(self, text: str) -> list[int]:
        """The first unit's first blank is the one that B adds; a unit that starts with a line feed goes without it."""
        if text[0] != " ":
            return self.b.encode(text, num_threads=1)[1:]
        return self.b.encode(text[1:], num_threads=1) or [self.blank]

    def encode_units(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, owners, given back) of A and of B: the ids of units and which unit they are of, in order.

        Units run together are a text of their own that is cut at each of them, so TOGETHER of them are encoded at
        once and parted by bytes. Those which end in white space or have B's sign, and runs that aren't given back
        byte by byte, are encoded unit by unit.
        """
        alone = [k for k, u in enumerate(units) if "▁" in u or u[0] not in " \n" or u[-1].isspace()]
        joint = np.setdiff1d(np.arange(len(units)), alone).tolist()
        runs = [joint[k : k + self.TOGETHER] for k in range(0, len(joint), self.TOGETHER)] + [[k] for k in alone]
        out = []
        for encode, table in ((self.encode_a, self.table_a), (self.encode_b, self.table_b)):
            ids, owners, given = [], [], np.zeros(len(units), bool)
            todo = runs[::-1]
            while todo:
                run = todo.pop()
                text = "".join([units[k] for k in run])
                found, raw = np.array(encode(text), np.int64), [units[k].encode() for k in run]
                stops, ends = np.cumsum([len(r) for r in raw]), np.cumsum(table.sizes[found])
                same = len(ends) > 0 and ends[-1] == stops[-1] and np.array_equal(table.joined(found), np.frombuffer(b"".join(raw), np.uint8))
                if same and np.isin(stops, ends).all():
                    given[run] = True
                elif len(run) > 1:
                    todo += [[k] for k in reversed(run)]
                    continue
                ids.append(found)
                owners.append(np.array(run)[np.minimum(np.searchsorted(stops, ends), len(run) - 1)])
            ids, owners = np.concatenate(ids), np.concatenate(owners)
            order = np.argsort(owners, kind="stable")
            out.append((ids[order], owners[order], given))
        return out


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and each B token, from where they end, and the number of groups.

    The ends of both cut the bytes into elementary intervals. Each interval lies in one token of A and one of B,
    its owners: one overlap. Where both owners end, a group closes.
    """
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    closes = (a_ends[a] == ends) & (b_ends[b] == ends)
    group = np.cumsum(closes) - closes
    a_group, b_group = np.empty(len(a_ends), np.int64), np.empty(len(b_ends), np.int64)
    a_group[a], b_group[b] = group, group  # a token's intervals are in one group
    return a_group, b_group, int(closes.sum())


def products(groups: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, links) of all groups' products, MOST_PRODUCTS at a time; ids that repeat in a group count once, with their links.

    ``a`` and ``b`` are (group, id), ordered by group. A pair is A's id in the high and B's in the low 16 bits.
    """
    (ga, ia, ca), (gb, ib, cb) = ((k >> 16, k & 0xFFFF, c) for k, c in (np.unique(g << 16 | i, return_counts=True) for g, i in (a, b)))
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    sizes = na * nb
    stops = np.cumsum(sizes)
    at = 0
    while at < groups:
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + MOST_PRODUCTS, "right")))
        g = np.repeat(np.arange(at, to), sizes[at:to])
        k = np.arange(len(g)) - np.repeat(stops[at:to] - sizes[at:to] - (stops[at - 1] if at else 0), sizes[at:to])
        x, y = first_a[g] + k // nb[g], first_b[g] + k % nb[g]
        yield g, ia[x] << 16 | ib[y], ca[x] * cb[y]
        at = to


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, values, len(unique)).astype(np.int64)


#: ids as text
NUMBERS = list(map(str, range(1 << 16)))


class Units:
    """What is known of units met before: counts, groups as text, and pairs with their links; forgotten beyond MOST bytes."""

    MOST = 160_000_000

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.held, self.groups = 0, []
        self.counts = np.zeros((0, 5), np.int64)  # whole, tokens of A, tokens of B, groups, links
        self.edges, self.pairs, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, split: list[list[str]]) -> list[np.ndarray]:
        """Places of the units of texts in the arrays, after learning the new ones."""
        if self.held > self.MOST:
            self.clear()
        new = list(set().union(*split).difference(self.at))
        if new:
            self.learn(new)
        return [np.fromiter(map(self.at.__getitem__, units), np.int64, len(units)) for units in split]

    def learn(self, units: list[str]) -> None:
        encoded = self.t.encode_units(units)
        whole = encoded[0][2] & encoded[1][2]
        ids, owners, ends = [], [], []
        for (flat, owner, _), table in zip(encoded, (self.t.table_a, self.t.table_b)):
            ids.append(flat[whole[owner]]), owners.append(owner[whole[owner]])
            ends.append(np.cumsum(table.sizes[ids[-1]]))
        a_group, b_group, n = align(*ends)
        of = np.zeros(n, np.int64)  # the unit of a group
        of[a_group] = owners[0]
        cells, links = [], []
        for g, pair, times in products(n, (a_group, ids[0]), (b_group, ids[1])):
            cell, link = summed(of[g] << 32 | pair, times)
            cells.append(cell), links.append(link)
        cells, links = summed(np.concatenate(cells), np.concatenate(links)) if cells else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        unit = cells >> 32
        per = [np.bincount(o, minlength=len(units)) for o in (*owners, of)] + [np.bincount(unit, links, len(units)).astype(np.int64)]
        self.counts = np.concatenate((self.counts, np.stack([whole.astype(np.int64), *per], 1)))
        self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(np.bincount(unit, minlength=len(units)))))
        self.pairs, self.links = np.concatenate((self.pairs, cells & 0xFFFFFFFF)), np.concatenate((self.links, links))
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        texts = [[NUMBERS[k] for k in i.tolist()] for i in ids]
        cuts = [np.searchsorted(g, np.arange(n + 1)).tolist() for g in (a_group, b_group)]
        named = [f"{','.join(texts[0][a:b])}|{','.join(texts[1][c:d])}" for a, b, c, d in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
        first = np.searchsorted(of, np.arange(len(units) + 1)).tolist()
        joined = [";".join(named[a:b]) for a, b in zip(first, first[1:])]
        self.groups += joined
        self.held += sum(len(u) + 100 for u in units) + sum(map(len, joined)) + 16 * len(cells)


#: of this Python worker, which serves many tasks
_units: dict[int, Units] = {}

KEPT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links): each document's distinct pairs and how often it links them.

    Tokenizes whole texts unit by unit. The two files are read on the driver and broadcast; their size is fixed.
    """
    spark = docs.sparkSession
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    held = spark.sparkContext.broadcast(tuple(files))
    rows = id_and_text(docs)
    names = ["doc_id", *KEPT, "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(held.value)
        if key not in _units:
            _units.clear()
            _units[key] = Units(Tokenizers(*held.value))
        units = _units[key]
        for batch in batches:
            for piece in pieces(batch):
                texts = pc.fill_null(piece.column(1), "").to_pylist()
                places = units.places([units.t.units(t) if t else [] for t in texts])
                sums = [units.counts[p].sum(0) if len(p) and units.counts[p, 0].all() else None for p in places]
                shas = [hashlib.sha256(";".join([units.groups[i] for i in p]).encode()).hexdigest() if s is not None else "" for p, s in zip(places, sums)]
                kept = [p if s is not None else p[:0] for p, s in zip(places, sums)]
                doc = np.repeat(np.arange(len(kept)), [len(p) for p in kept])
                cell, times = np.unique(doc << 32 | np.concatenate(kept), return_counts=True)
                unit = cell & 0xFFFFFFFF
                sizes = units.edges[unit + 1] - units.edges[unit]
                stops = np.cumsum(sizes)
                at = np.arange(stops[-1] if len(unit) else 0) + np.repeat(units.edges[unit] - stops + sizes, sizes)
                pair, links = summed(np.repeat(cell >> 32, sizes) << 32 | units.pairs[at], units.links[at] * np.repeat(times, sizes))
                edges = np.searchsorted(pair >> 32, np.arange(len(kept) + 1)).astype(np.int32)
                numbers = np.array([s[1:] if s is not None else np.zeros(4, np.int64) for s in sums], np.int64).reshape(len(kept), 4)
                lists = [pa.ListArray.from_arrays(edges, v) for v in ((pair & 0xFFFFFFFF).astype(np.uint32).view(np.int32), links)]
                columns = [piece.column(0), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(shas, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, links array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, top): how many documents hold a pair linked, and whether that is the most of its A id."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftrightunsigned("pair", 16)), "alignment-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row an id of A: its vocabulary bounds it
    return counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to rows of pairs and links.

    Pairs with many documents would make hot keys of a join, and those are few: as many of the most frequent as
    MOST_HEAVY allows, by whole powers of two, are broadcast and looked up in the task. The others are joined; no
    key of that join has more rows than the power's documents.
    """
    spark = rows.sparkSession
    sizes = counts.groupBy((F.length(F.bin("n")) - 1).alias("power")).count().orderBy(F.desc("power")).collect()  # 64 rows at most
    least, total = 0, 0
    for r in sizes:
        total += r["count"]
        if total > MOST_HEAVY:
            least = 1 << (r["power"] + 1)
            break
    heavy = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()  # MOST_HEAVY rows at most
    held = spark.sparkContext.broadcast(tuple(heavy.column(c).to_numpy() for c in ("pair", "n", "top")))
    names = ["row", "doc_id", *KEPT, "n_best", "count_sum", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, tops = held.value
        for batch in batches:
            lists = batch.column(len(names) - 4)
            n, sizes = batch.num_rows, lists.value_lengths().to_numpy()
            pair, links = lists.flatten().to_numpy(), batch.column(len(names) - 3).flatten().to_numpy()
            doc = np.repeat(np.arange(n), sizes)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            found = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            at, times, of = at[found], links[found], doc[found]
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            np.add.at(sums[0], of, times * tops[at])
            np.add.at(sums[1], of, times * ns[at])
            edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(doc[~found], minlength=n)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(edges, v[~found]) for v in (pair, links)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 4], *map(pa.array, sums), *rest], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<int>, links array<long>"
    looked = rows.select("row", "doc_id", *KEPT, "pairs", "links").mapInArrow(run, schema)
    if not least:  # all pairs are among the heavy ones
        return looked.drop("row", "pairs", "links")
    looked = stored(looked, "alignment-looked-up")
    each = looked.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
    light = each.join(counts.filter(F.col("n") < least), "pair").groupBy("row")
    light = light.agg(F.sum(F.when(F.col("top"), F.col("links")).otherwise(0)).alias("b"), F.sum(F.col("links") * F.col("n")).alias("c"))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return looked.join(light, "row", "left").select("doc_id", *KEPT, plus("n_best", "b"), plus("count_sum", "c"))


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each document of doc_id and text.

    Each row is a document of its own, repeated rows and null ids too; other columns are not returned. Texts that
    are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty
    groups_sha256, and they count for no pair. An empty table gives an empty table. Whole texts are tokenized;
    tables of 16 bits hold ids, so larger vocabularies are refused.
    """
    rows = stored(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "alignment-documents")
    return with_counts(rows, pair_counts(rows))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: the tokenizers are beyond SQL
SQL: dict[str, str] = {}
