"""The token table against the tokenizers library on whole texts, its layout, and reads of parts of it."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankfold.llm import token_table as T
from rankfold.llm.common import new_path

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part string, start int, n_tokens string, tokens int"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(FILE)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def odd_texts():
    rng = random.Random(3)
    alphabet = list("abcXYZ019 \x00\t\n\r\x0b\x0c\x1c\x85\xa0'.,!<|>-é́̈ßΣσİ漢字　 😀️") + ["<|endoftext|>", "<|startoftext|>", "'s", "  ", "The", "words", "<|ENDOFTEXT|>", ". ", ", ", "\u0958", "ǅ", "²"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]


def test_words_apart_give_the_ids_of_whole_texts(spark, whole):
    encode = T.word_encoder(spark, FILE)()
    texts = odd_texts()
    want = [whole(t)[:-1] for t in texts]
    for at_once in (1500, 100, 7):  # at last from memory, of which half goes each time
        encode.MOST = 600_000 if at_once > 100 else 300
        for k in range(0, len(texts), at_once):
            ids, sizes = encode(pa.array([None, *texts[k : k + at_once]]))
            assert [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [[], *want[k : k + at_once]]


def test_letters_and_signs_behind_are_parted_as_arrays(spark, whole, monkeypatch):
    alone, seen = T.CachedWords._encoded, []
    monkeypatch.setattr(T.CachedWords, "_encoded", lambda self, new: (seen.extend(new), alone(self, new))[1])
    encode = T.word_encoder(spark, FILE)()
    encode.clear()
    plain = [f"wört{a}{b}{c}{s}" for a in "aßÿ" for b in "Zxé" for c in "bàQ" for s in ("", ".", "!!", "$$$", '."-_@~', "%%%%%%%%")]
    other = ["word'", "don't", "x" + "." * 9, "Éa", "a×", "a÷.", "a\u00b7", "\u00e9\u0301.", "ñ2", "2.", "...", "a.b", "ŧa.", "a.\u0301", "a<", "µ."]
    texts = [" ".join(plain), " \n".join(other), "", *plain, *other]
    ids, sizes = encode(pa.array(texts))
    assert [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [whole(t)[:-1] for t in texts]
    assert not {w.lower() for w in plain} & {w.lower() for w in seen} and len(seen) <= len(other) + 10
    encode.clear()


def test_words_of_one_hash_are_told_apart(spark, whole, monkeypatch):
    class Same(T.Words):
        def __init__(self, texts):
            super().__init__(texts)
            self.hashes = self.hashes % np.uint64(3)

    monkeypatch.setattr(T, "Words", Same)
    encode = T.word_encoder(spark, FILE)()
    encode.clear()
    texts = odd_texts()[:50]
    ids, sizes = encode(pa.array(texts))
    assert [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [whole(t)[:-1] for t in texts]
    encode.clear()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_written_and_read(spark, whole, encoding):
    texts = [None, "", " \n ", "Word " * 300_000, "x" * 200_000, *odd_texts()[:300]]
    rows = [(i * 7 % 311, t, "p", 1, "n", 2) for i, t in enumerate(texts)] + [(5, "second"), (5, "first"), (5, "first"), (None, "no id")]
    rows = [r if len(r) == 6 else (*r, "p", 1, "n", 2) for r in rows]
    path = new_path(spark, "test-tokens")
    T.write_token_table(spark.createDataFrame(rows, SCHEMA).repartition(3), path, T.word_encoder(spark, FILE), 1, parts=4, encoding=encoding, page_rows=16)
    got = sorted(T.read_token_table(spark, path).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, every = 0, []
    for r, (i, t, *_) in zip(got, order, strict=True):
        ids = whole(t)
        assert (r.doc_id, r.start, r.n_tokens, r.tokens) == (i, start, len(ids), ids)
        start, every = start + len(ids), every + ids
    index = T.read_index(spark, path).orderBy("part").collect()
    assert [r.part for r in index] == list(range(len(index))) and sum(r.tokens for r in index) == start and sum(r.docs for r in index) == len(rows)
    assert {r.doc_id: r.tokens for r in T.read_token_table(spark, path, "doc_id", "tokens", where=F.col("doc_id").between(20, 30)).collect()} == {r.doc_id: r.tokens for r in got if r.doc_id is not None and 20 <= r.doc_id <= 30}
    for a, b in ((0, 5), (start - 3, start + 9), (start // 3, start // 3 + 70_000), (4, 4), (start + 1, start + 2)):
        assert sum((r.tokens for r in sorted(T.token_window(spark, path, a, b).collect())), []) == every[a:b]
    crcs = {(r.start, r.ids_crc32) for r in T.with_crc32(T.read_token_table(spark, path), ["start"]).collect()}
    assert crcs == {(r.start, zlib.crc32(np.array(r.tokens, "<u4").tobytes())) for r in got}


def test_layout(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(60)), "p", 1, "n", 2) for i in range(3000)]
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = f"{tmp_path}/{encoding}"
        T.write_token_table(spark.createDataFrame(rows, SCHEMA), path, T.word_encoder(spark, FILE), 1, parts=2, encoding=encoding, row_group=256 << 10, page=16 << 10, page_rows=100)
        files = sorted((tmp_path / encoding / "data").glob("*.parquet"))
        metas = [pq.ParquetFile(f).metadata for f in files]
        assert sum(m.num_row_groups for m in metas) > len(files)
        column = lambda m, name: next(c for k in range(m.num_columns) if (c := m.row_group(0).column(k)).path_in_schema.startswith(name))
        for m in metas:
            assert name in column(m, "tokens").encodings or "PLAIN_DICTIONARY" in column(m, "tokens").encodings and encoding == "dictionary"
            assert column(m, "doc_id").has_offset_index and column(m, "doc_id").has_column_index
        plan = T.read_token_table(spark, path, "doc_id", "start", "n_tokens", where=F.col("doc_id") < 9)._jdf.queryExecution().toString()
        assert "LessThan(doc_id,9)" in plan and "tokens:array" not in plan.split("Physical Plan")[1].split("ReadSchema")[1].split("\n")[0]


def test_no_rows(spark):
    path = new_path(spark, "test-tokens")
    T.write_token_table(spark.createDataFrame([], SCHEMA), path, T.word_encoder(spark, FILE), 1)
    assert T.read_token_table(spark, path).collect() == [] == T.token_window(spark, path, 0, 10).collect() == T.with_crc32(T.read_token_table(spark, path), ["doc_id"]).collect()


def test_query(spark, sf_dir, whole):
    got = {r.doc_id: r for r in T.op12_token_table(spark, sf_dir).collect()}
    start = 0
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids, r = whole(d.text), got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got
