"""The alignment against a plain one over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankfold.llm import alignment as A

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "doc_id long, text string, pairs string, links int, `row` int, n string, n_a int"


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
        self.names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.byte = A.byte_of()

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        raw_a = [self.names[i].encode() if i == 50256 else bytes(self.byte[c] for c in self.names[i]) for i in a]
        raw_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, raw_a, b, raw_b

    def groups(self, text):
        """Lists of A and B ids between places where both end; none if the text isn't given back."""
        if not text:
            return []
        a, raw_a, b, raw_b = self.tokens(text)
        if not (b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()):
            return []
        out, x, y, i, j = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                out[-1][0].append(a[i])
                x, i = x + len(raw_a[i]), i + 1
            else:
                out[-1][1].append(b[j])
                y, j = y + len(raw_b[j]), j + 1
            if x == y and out[-1][0] and out[-1][1]:
                out.append(([], []))
        return out[:-1]

    def rows(self, docs):
        per = [(i, self.groups(t)) for i, t in docs]
        links = [Counter((p, q) for a, b in g for p in a for q in b) for _, g in per]
        count = Counter(k for c in links for k in c)
        best = {}
        for (p, _), n in count.items():
            best[p] = max(best.get(p, 0), n)
        out = []
        for (i, g), c in zip(per, links):
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
            n_best = sum(k for (p, q), k in c.items() if count[p, q] == best[p])
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sha, n_best, sum(k * count[x] for x, k in c.items())))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def odd_texts():
    rng = random.Random(5)
    alphabet = list("abcdeXYZ019 \t\n\r\x0b\x0c\x1c\x00\x85\xa0'.,!<|>_-é́ßİ漢字语　 ▁ﬁ😀️👩‍") + ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "  ", "\n\n", " the", " of", "ing"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 50))) for _ in range(2500)]


def test_units_give_the_ids_of_whole_texts(plain):
    t = A.Tokenizers(*(open(f, "rb").read() for f in FILES))
    texts = [*odd_texts(), " ", "\n", "\n\n", "  ", "a ", "a\n", " a", "\na", "a \n b", "a\n \nb ", "\ta", "a\t b", "a \tb", "word " * 500, "漢字" * 300]
    for text in texts:
        a, _, b, raw_b = plain.tokens(text)
        units = t.units(text)
        assert "".join(units) == " " + text
        (ids_a, of_a, given_a), (ids_b, of_b, given_b) = t.encode_units(units)
        assert ids_a.tolist() == a and (not given_b.all() or ids_b.tolist() == b), repr(text)
        assert given_a.all() and given_b.all() == (b"".join(raw_b) == (" " + text).encode())
        for ids, of, table in ((ids_a, of_a, t.table_a), (ids_b, of_b, t.table_b)):
            for k, u in enumerate(units):
                assert not given_b.all() or table.joined(ids[of == k]).tobytes() == u.encode()


def test_units_of_many_texts_together(plain):
    t = A.Tokenizers(*(open(f, "rb").read() for f in FILES))
    units = list(dict.fromkeys(u for text in odd_texts() for u in t.units(text)))
    for together in (1, 7, 1000):
        t.TOGETHER = together
        got = [[ids.tolist() for ids in (i[(o == k) & g[o]] for k in range(len(units)))] for i, o, g in t.encode_units(units)]
        once = got if together == 1 else once
        assert got == once


def test_odd_texts(spark, plain):
    rng = random.Random(2)
    texts = [None, "", *odd_texts()[:400], "The same text, of some words.", "The same text, of some words.", "x" * 60_000, "long words " * 30_000, "\U0001f600" * 3000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]
    rng.shuffle(docs)
    got = A.align_tokenizers(spark.createDataFrame([(*d, "x", 1, 2, "y", 3) for d in docs], SCHEMA).repartition(3), *FILES)
    assert got.columns == ["doc_id", *A.KEPT, "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain.rows(docs), key=repr)


@pytest.mark.parametrize("most", [0, 3, 200])
def test_pairs_beyond_the_broadcast_are_joined(spark, plain, monkeypatch, most):
    monkeypatch.setattr(A, "MOST_HEAVY", most)
    monkeypatch.setattr(A, "MOST_PRODUCTS", 5)
    docs = [(i, t) for i, t in enumerate(odd_texts()[:60] + ["the end of the day"] * 5)]
    got = A.align_tokenizers(spark.createDataFrame([(*d, "x", 1, 2, "y", 3) for d in docs], SCHEMA), *FILES)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain.rows(docs), key=repr)


def test_groups_of_many_tokens(plain):
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = [rng.integers(1, 6, rng.integers(1, 12)) for _ in range(2)]
        total = max(s.sum() for s in sizes)
        a, b = (np.append(s, total - s.sum()) if s.sum() < total else s for s in sizes)
        a_group, b_group, n = A.align(np.cumsum(a), np.cumsum(b))
        shared = sorted(set(np.cumsum(a)) & set(np.cumsum(b)))
        assert n == len(shared)
        assert a_group.tolist() == np.searchsorted(shared, np.cumsum(a)).tolist() and b_group.tolist() == np.searchsorted(shared, np.cumsum(b)).tolist()
        ids = [rng.integers(0, 3, len(x)) for x in (a, b)]
        want = Counter((g, p, q) for g in range(n) for p in ids[0][a_group == g].tolist() for q in ids[1][b_group == g].tolist())
        found = Counter()
        for g, pair, times in A.products(n, (a_group, ids[0]), (b_group, ids[1])):
            found.update({(x, y >> 16, y & 0xFFFF): z for x, y, z in zip(g.tolist(), pair.tolist(), times.tolist())})
        assert found == want


def test_no_rows_and_a_table_of_nulls(spark):
    assert A.align_tokenizers(spark.createDataFrame([], SCHEMA), *FILES).collect() == []
    nulls = A.align_tokenizers(spark.createDataFrame([(None, None, None, None, None, None, None)] * 2, SCHEMA), *FILES).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, 0, 0, 0, "", 0, 0)] * 2


def test_query(spark, sf_dir, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, A.op13_alignment(spark, sf_dir).collect())) == sorted(plain.rows(docs))
