"""Token ids as a table of Parquet files in document order, whose tokens and metadata can be read selectively."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.llm.common import id_and_text, new_path, pieces
from rankfold.llm.words import Words

#: a column of texts to the ids of all of them, one text's after another's, and how many each text has
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: stands between words that are encoded together
MARK = "\x00"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of the letters a-z and \u00df to \u00ff, and ASCII signs that no cut of the tokenizer begins with
_LETTER = np.array([97 <= b <= 122 or b in (0xC3, 0x9F) or 0xA0 <= b <= 0xBF and b != 0xB7 for b in range(256)])
_SIGN = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in "'<|" for b in range(256)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each run, ``sizes[i]`` of them."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(sizes) else 0) + np.repeat(starts - stops + sizes, sizes)


class CachedWords:
    """Encodes texts word by word and remembers words, up to a bound; the ids equal those of whole texts.

    No piece of the vocabulary reaches across ASCII white space: the tokenizer drops it, and Unicode's normal forms
    don't compose across it. The words of a column are found and named by hashes as arrays, and looked up in arrays
    of what is known; each is then compared with the known word byte by byte, so that equal hashes can't mix words.
    Texts with the start of a special token, which go by case, are encoded whole.

    A-Z count as a-z, as the tokenizer lowers them. New words are parted as arrays into letters and up to eight
    signs behind, which are pieces of their own. Letters a-z and \u00df to \u00ff are what the tokenizer's normal form and
    its cuts leave alone, so they go to its model without either, many words at a time, and each ends with the one
    id that ends a word. Of other words one that ends in a sign of STOPS behind a letter or digit is that sign and a
    core; they stand between marks of one id. Beyond MOST words, those that were met last stay.
    """

    MOST, TOGETHER, STOPS = 500_000, 1000, ".,;:!?"
    #: words whose bytes are compared at once
    COMPARED = 1 << 16

    def __init__(self, make: Callable):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.model = make(), make()
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()
        ids = self._ids(self.tokenizer, [MARK])[0]
        self.mark = ids[0] if len(ids) == 1 else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, tokenizer, new: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray]]:
        blocks = [new[k : k + self.TOGETHER] for k in range(0, len(new), self.TOGETHER)]
        yield from zip(blocks, self._ids(tokenizer, [between.join(b) for b in blocks]))

    def _encoded(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        letters, marked, alone = [], [], []
        for w in new:
            if w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w) and w == w.lower():
                letters.append(w)
            else:
                (alone if self.mark is None or MARK in w else marked).append(w)
        for block, ids in self._runs(self.model, letters, " "):
            stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            yield from zip(block, [raw[a:b] for a, b in zip([0, *stops], stops)], strict=True)
        for block, ids in self._runs(self.tokenizer, marked, f" {MARK} "):
            at = np.flatnonzero(ids == self.mark)
            raw, starts, stops = ids.tobytes(), [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), 4 * len(ids)]
            yield from zip(block, [raw[a:b] for a, b in zip(starts, stops)], strict=True)
        yield from zip(alone, (i.tobytes() for i in self._ids(self.tokenizer, alone)))

    def _cores(self, new: list[str]) -> list[tuple[str, str, str]]:
        """(word, core, sign or '') of each."""
        out, stops = [], self.STOPS
        for w in new:
            core, tail = w, ""
            if w[-1] in stops and len(w) > 1 and (c := w[-2]).isalnum() and c < "\u0250" and c != "\u0130":
                core, tail = w[:-1], w[-1]
            out.append((w, core.lower() if core.isascii() else core, tail))
        return out

    def clear(self) -> None:
        self.cores: dict[str, bytes] = {}
        #: of known words, in order of hash: where their bytes and ids start, how many they are, and when they were met
        self.hashes, self.met = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.sizes = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        self.flat = [np.zeros(0, np.uint8), np.zeros(0, np.uint32)]
        self.time = 0

    def _known(self, cores: set[str]) -> None:
        """Sees to it that ``self.cores`` has these; what it had may go."""
        if len(self.cores) > self.MOST // 4:
            self.cores.clear()
        self.cores.update(self._encoded(list(cores.difference(self.cores))))

    def _plain(self, low: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words low[at[i]:at[i] + sizes[i]] are letters and up to eight signs, and how many bytes of letters each has."""
        letter, sign = (np.concatenate(([0], np.cumsum(kind[low], dtype=np.int32))) for kind in (_LETTER, _SIGN))
        letters = (letter[at + sizes] - letter[at]).astype(np.int64)
        signs = sign[at + sizes] - sign[at]
        return (letters > 0) & (letters + signs == sizes) & (signs <= 8) & (letter[at + letters] - letter[at] == letters), letters

    def _letters(self, low: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters one after the other, and how many each has."""
        ends = np.cumsum(sizes + 1)
        spaced = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
        spaced[spread(ends - sizes - 1, sizes)] = low[spread(at, sizes)]
        edges = np.concatenate(([0], ends))[[*range(0, len(sizes), self.TOGETHER), len(sizes)]].tolist()
        raw = spaced.tobytes()
        ids = np.concatenate([np.zeros(0, "<u4"), *self._ids(self.model, [raw[a : b - 1].decode() for a, b in zip(edges, edges[1:])])])
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(sizes):
            raise ValueError(f"{len(stops)} ends of words for {len(sizes)} words")
        return ids, np.diff(stops, prepend=0)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Adds words data[starts[i]:starts[i] + sizes[i]] of new hashes, which are in order."""
        low = LOWER[data[spread(starts, sizes)]]
        at = np.cumsum(sizes) - sizes
        plain, letters = self._plain(low, at, sizes)
        view = memoryview(data)
        other = np.flatnonzero(~plain)
        cores = self._cores([bytes(view[a:b]).decode() for a, b in zip(starts[other].tolist(), (starts + sizes)[other].tolist())])
        of = np.flatnonzero(plain)
        code, behind = np.zeros(len(of), np.uint64), sizes[of] - letters[of]
        for k in range(int(behind.max(initial=0))):  # the signs as one number
            has = np.flatnonzero(behind > k)
            code[has] |= low[at[of[has]] + letters[of[has]] + k].astype(np.uint64) << np.uint64(8 * k)
        codes, tail = np.unique(code, return_inverse=True)
        tails = [int(c).to_bytes(8, "little").rstrip(b"\0").decode() for c in codes]
        self._known({c for _, c, _ in cores}.union((t for _, _, t in cores if t), (t for t in tails if t)))
        own, n_own = self._letters(low, at[of], letters[of])
        ends = [np.frombuffer(self.cores[t], "<u4") if t else np.zeros(0, "<u4") for t in tails]
        n_end = np.array([len(e) for e in ends], np.int64)
        rest = [self.cores[c] + self.cores[t] if t else self.cores[c] for _, c, t in cores]
        # ids: of plain words, which are letters' and signs' in turn, then of others
        n = n_own + n_end[tail] if len(of) else n_own
        first = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.uint32)
        ids[spread(first, n_own)] = own
        if len(of):
            ids[spread(first + n_own, n_end[tail])] = np.concatenate(ends)[spread((np.cumsum(n_end) - n_end)[tail], n_end[tail])]
        many = np.zeros(len(hashes), np.int64)
        many[of], many[other] = n, [len(r) // 4 for r in rest]
        where = np.zeros(len(hashes), np.int64)
        where[of], where[other] = first, len(ids) + np.cumsum(many[other]) - many[other]
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.met = np.insert(self.hashes, place, hashes), np.insert(self.met, place, self.time)
        self.at = np.insert(self.at, place, np.stack((at + len(self.flat[0]), where + len(self.flat[1])), 1), axis=0)
        self.sizes = np.insert(self.sizes, place, np.stack((sizes, many), 1), axis=0)
        self.flat = [np.concatenate((self.flat[0], low)), np.concatenate((self.flat[1], ids, np.frombuffer(b"".join(rest), "<u4")))]

    def _forget(self) -> None:
        kept = self.met >= np.median(self.met)
        kept &= self.met > self.met.min()
        self.hashes, self.met, old, self.sizes = self.hashes[kept], self.met[kept], self.at[kept], self.sizes[kept]
        self.flat = [f[spread(old[:, k], self.sizes[:, k])] for k, f in enumerate(self.flat)]
        self.at = np.cumsum(self.sizes, axis=0) - self.sizes

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        w, self.time = Words(texts), self.time + 1
        if len(self.hashes) > self.MOST:
            self._forget()
        hashes, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if new.any():
            self._learn(hashes[new], w.data, w.starts[first[new]], (w.stops - w.starts)[first[new]])
            place = np.searchsorted(self.hashes, hashes)
        self.met[place] = self.time
        word, long = place[back], w.stops - w.starts
        same = np.array_equal(self.sizes[word, 0], long)
        for k in range(0, len(word), self.COMPARED):
            few = slice(k, k + self.COMPARED)
            same = same and np.array_equal(self.flat[0][spread(self.at[word[few], 0], long[few])], LOWER[w.data[spread(w.starts[few], long[few])]])
        if not same:  # two words of one hash
            self.clear()
            return self._whole(texts.to_pylist())
        ids = self.flat[1][spread(self.at[word, 1], self.sizes[word, 1])]
        ends = np.concatenate(([0], np.cumsum(self.sizes[word, 1])))
        return ids, np.diff(ends[np.append(w.first[: len(texts)], len(word))])

    def _whole(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(self.tokenizer, [t or "" for t in texts])
        return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")
        if not pc.any(special).as_py():
            return self._joined(texts)
        ids, sizes = self._joined(pc.if_else(special, "", texts))
        each = np.split(ids, np.cumsum(sizes)[:-1])
        for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            each[k] = self._whole([texts[k].as_py()])[0]
        return np.concatenate(each), np.array([len(i) for i in each], np.int64)


#: of this Python worker, which serves many tasks
_encoders: dict[bytes, CachedWords] = {}


def word_encoder(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """Encoder of a tokenizers file, read on the driver and broadcast (its size is fixed: under 2 MB)."""
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def make() -> Encoder:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        if held.value not in _encoders:
            _encoders.clear()
            _encoders[held.value] = CachedWords(lambda: Tokenizer.from_buffer(held.value))
        return _encoders[held.value]

    return make


ROWS = "part int, doc_id {}, start long, n_tokens int, tokens array<int>"


def write_token_table(
    docs: DataFrame, path: str, encoder: Callable[[], Encoder], end_id: int, parts: int | None = None, encoding: str = "dictionary",
    row_group: int = 32 << 20, page: int = 128 << 10, page_rows: int = 2048,
) -> None:
    """Encode whole texts, append ``end_id`` and write ``path``/data in ascending order of doc_id, null ids first.

    Rows that share an id stand by text. A null text is empty: its only token is the end. Other columns than
    doc_id and text are not kept. Each of ``parts`` files (part 0 holds the first ids, and so on) has its
    documents in order with ``start``, the number of tokens before it in this file; ``path``/index, written last,
    has a row a file: its tokens, documents, range of ids, and ``base``, the tokens of all files before it. A
    folder without an index is not whole. Texts are shuffled once, by ranges of ids, and encoded where they
    arrive, so that a file's running count needs no second pass.

    The list column is encoded by dictionary or, with ``encoding`` "delta", by differences (DELTA_BINARY_PACKED).
    Row groups hold about ``row_group`` bytes and pages ``page`` bytes or ``page_rows`` rows, and Parquet's page
    index says which ids and starts a page holds: filters on doc_id, part or start read the pages that they
    need alone, and metadata is read without touching tokens.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no encoding {encoding!r}; there are dictionary and delta")
    rows = id_and_text(docs)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ROWS.format(rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, 512):
                ids, sizes = encode(piece.column(1))
                sizes = sizes + 1
                stops = np.cumsum(sizes)
                ended = np.full(stops[-1], end_id, np.int32)
                ended[np.delete(np.arange(stops[-1]), stops - 1)] = ids
                lists = pa.ListArray.from_arrays(np.concatenate(([0], stops)).astype(np.int32), ended)
                columns = [pa.array(np.full(len(sizes), part, np.int32)), piece.column(0), pa.array(start + stops - sizes), pa.array(sizes.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "tokens"])
                start += int(stops[-1])

    placed = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)
    kind = {"parquet.writer.version": "v2", "parquet.enable.dictionary#tokens.list.element": "false"} if encoding == "delta" else {"parquet.dictionary.page.size": 1 << 20}
    sizes = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows}
    before = docs.sparkSession.conf.get(BATCH)
    docs.sparkSession.conf.set(BATCH, min(int(before), 2048) if int(before) > 0 else 2048)  # whole texts: a batch stands in the JVM and in Python
    try:
        placed.write.options(compression="zstd", **kind, **sizes).parquet(f"{path}/data")
    finally:
        docs.sparkSession.conf.set(BATCH, before)
    data = docs.sparkSession.read.schema(schema).parquet(f"{path}/data")
    each = data.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a file
    each.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, docs, tokens, first_id, last_id, base), a row a file."""
    return spark.read.parquet(f"{path}/index")


def read_token_table(spark: SparkSession, path: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Columns among doc_id, start, n_tokens and tokens (all if none are named), of rows that meet ``where``.

    ``start`` is the number of tokens of all documents before; ``where`` is over doc_id, part and n_tokens, and
    goes down to row groups and pages. Columns that aren't asked for aren't read.
    """
    data = spark.read.parquet(f"{path}/data")
    data = data.filter(where) if where is not None else data
    base = F.broadcast(read_index(spark, path).select("part", "base"))  # a row a file
    return data.join(base, "part").withColumn("start", F.col("start") + F.col("base")).select(*(columns or ("doc_id", "start", "n_tokens", "tokens")))


def token_window(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """(start, tokens): what stands at the places [first, stop) of the sequence of all tokens, document by document.

    The index names the files that reach into the window; in them the page index names the pages.
    """
    index = read_index(spark, path).filter((F.col("base") < stop) & (F.col("base") + F.col("tokens") > first))
    reached = [(r["part"], r["base"]) for r in index.select("part", "base").collect()]  # the window's files
    data, out = spark.read.parquet(f"{path}/data"), None
    for part, base in reached:
        #: bounds as plain numbers, so that they reach the scan; a document may start before the window
        rows = data.filter((F.col("part") == part) & (F.col("start") < stop - base) & (F.col("start") + F.col("n_tokens") > first - base))
        rows = rows.withColumn("start", F.col("start") + base)
        out = rows if out is None else out.unionByName(rows)
    out = data.limit(0) if out is None else out
    a, b = F.greatest(F.lit(first) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    return out.select(F.greatest(F.col("start"), F.lit(first)).alias("start"), F.slice("tokens", (a + 1).cast("int"), (b - a).cast("int")).alias("tokens"))


def with_crc32(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns and ids_crc32, the unsigned CRC-32 of a row's tokens as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            edges, raw = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist(), memoryview(flat).cast("B")
            crcs = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], crcs], names=[*kept, "ids_crc32"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "tokens").mapInArrow(run, f"{schema}, ids_crc32 long")


def op12_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), new_path(spark, "token-table")
    write_token_table(docs, path, word_encoder(spark, public_tokenizers.path("word_bpe_49k.json")), end_id=1)
    rows = read_token_table(spark, path).withColumn("n_tokens", F.col("n_tokens").cast("long"))
    return with_crc32(rows, ["doc_id", "start", "n_tokens"])


#: the tokenizer is beyond SQL
SQL: dict[str, str] = {}
