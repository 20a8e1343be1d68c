"""Byte-level BPE encoding and decoding with a segment tree of pair ranks."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from rankfold.llm.common import id_and_text, per_batch, per_row

NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def unicode_spaces(pattern: str) -> str:
    r"""The pattern with ``\s`` and ``\S`` as the Unicode property White_Space, which tiktoken means by them."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
    return inside.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")


#: finds a character from U+0250 on
HIGH = re.compile("[^\\x00-\u024f]").search


def below_0250(pattern: str) -> str:
    """The pattern for texts whose characters are all below U+0250, with classes that the faster ``re`` knows."""
    letter, number, space = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    return inside.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


class SegmentTreeBpe:
    """Merges the leftmost pair of least rank until none has a rank.

    The leaves of the tree are byte positions. A leaf holds the rank of the pair that starts there, if a live
    token starts there and has a right neighbour. An inner node holds the least rank below it, so the root
    says what to merge, a walk down its left-most holders says where, and a merge changes three leaves: the
    merged one, its dead right half, and the left neighbour, each in logarithmic time. A piece of n bytes
    costs O(n log n) even when it has a million bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        width = 1 << max(0, (n - 2).bit_length())
        tree = [NONE] * (2 * width) if n < 4096 else array("i", [NONE]) * (2 * width)
        for i in range(n - 1):
            tree[width + i] = ranks.get(piece[i : i + 2], NONE)
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b
        end = list(range(1, n + 1)) if n < 4096 else array("q", range(1, n + 1))
        before = list(range(-1, n - 1)) if n < 4096 else array("q", range(-1, n - 1))
        longest = self.longest

        def put(i: int, rank: int) -> None:
            node = width + i
            tree[node] = rank
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a <= b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while (least := tree[1]) < NONE:
            node = 1
            while node < width:
                node *= 2
                if tree[node] != least:
                    node += 1
            i = node - width
            j = end[i]
            stop = end[i] = end[j]
            put(j, NONE) if j < n - 1 else None
            if stop < n:
                before[stop] = i
                put(i, ranks.get(piece[i : end[stop]], NONE) if end[stop] - i <= longest else NONE)
            else:
                put(i, NONE)
            if (p := before[i]) >= 0:
                put(p, ranks.get(piece[p:stop], NONE) if stop - p <= longest else NONE)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class ManyBpe:
    """The same trees for many short pieces at once: a column of the arrays is a piece, a row a node.

    Pairs are looked up by the ids of their halves in a sorted table of every token's splits in two tokens.
    """

    WIDTHS = (4, 8, 16, 32)

    def __init__(self, ranks: dict[bytes, int]):
        self.one = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        splits = [(ranks[a] << 20 | ranks[b], rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        table = np.array(sorted(splits) or [(-1, NONE)], np.int64)
        self.keys, self.ranks = table[:, 0].copy(), table[:, 1].copy()

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Of pieces of 1 to 32 bytes, the ids as little-endian bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for width in self.WIDTHS:
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            for start in range(0, len(own), 8192):
                part = own[start : start + 8192]
                for k, ids in zip(part.tolist(), self._encode([pieces[k] for k in part], sizes[part], width)):
                    out[k] = ids
            low = width
        return out

    def _encode(self, pieces: list[bytes], n: np.ndarray, width: int) -> list[bytes]:
        count = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width).T
        place = np.arange(width)[:, None]
        token, live = self.one[flat], place < n
        end = np.minimum(place + 1, n) + np.zeros((1, count), np.int64)
        before = place - 1 + np.zeros((1, count), np.int64)
        tree = np.full((2 * width, count), NONE, np.int64)
        tree[width : 2 * width - 1] = np.where(place[1:] < n, self.pair(token[:-1], token[1:]), NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
        tree, token, end, before, live = (x.reshape(-1) for x in (tree, token, end, before, live))

        def put(leaf: np.ndarray, rank: np.ndarray | int, column: np.ndarray) -> None:
            node = width + leaf
            tree[node * count + column] = rank
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                below = 2 * node * count + column
                tree[node * count + column] = np.minimum(tree[below], tree[below + count])

        column = np.arange(count)
        while (column := column[tree[count + column] < NONE]).size:
            least = tree[count + column]
            node = np.ones(len(column), np.int64)
            for _ in range(width.bit_length() - 1):
                node = 2 * node
                node += tree[node * count + column] != least
            left = node - width
            at = left * count + column
            right = end[at]
            stop = end[right * count + column]
            token[at], end[at], live[right * count + column] = least, stop, False
            put(right, NONE, column)
            inside = stop < n[column]
            after = np.where(inside, stop, 0) * count + column
            before[after[inside]] = left[inside]
            put(left, np.where(inside, self.pair(least, token[after]), NONE), column)
            p = before[at]
            has = p >= 0
            put(p[has], self.pair(token[(p * count + column)[has]], least[has]), column[has])
        token, live = token.reshape(width, count), live.reshape(width, count)
        ids = token.T[live.T].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(live.sum(0))).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


class Codec:
    """Encodes and decodes; remembers the ids of short pieces, up to a bound."""

    MOST, LONGEST = 500_000, ManyBpe.WIDTHS[-1]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.any_pieces = regex.compile(unicode_spaces(pattern)).findall
        self.low_pieces = re.compile(below_0250(pattern)).findall
        self.one, self.many = SegmentTreeBpe(ranks), ManyBpe(ranks)
        self.seen: dict[str, bytes] = {}
        tokens = {rank: token for token, rank in ranks.items()}
        every = [tokens.get(k, b"") for k in range(max(tokens, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(every), np.uint8)
        self.sizes = np.array([len(t) for t in every], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pieces(self, text: str) -> list[str]:
        return (self.any_pieces if HIGH(text) else self.low_pieces)(text)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text, the ids as little-endian unsigned 32-bit integers; a null text is empty."""
        split = [self.pieces(t or "") for t in texts]
        if len(self.seen) > self.MOST:
            self.seen.clear()
        new = list(set().union(*split).difference(self.seen))
        raw = [p.encode() for p in new]
        short = [k for k, p in enumerate(raw) if len(p) <= self.LONGEST]
        self.seen.update(zip([new[k] for k in short], self.many.encode([raw[k] for k in short])))
        long = {new[k]: array("I", self.one.encode(p)).tobytes() for k, p in enumerate(raw) if len(p) > self.LONGEST}
        ids = self.seen | long if long else self.seen
        for pieces in split:
            yield b"".join(map(ids.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian ids, gathered from the table of all tokens' bytes."""
        ids = np.frombuffer(ids, "<u4")
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        return self.flat[np.arange(stops[-1] if len(ids) else 0) + np.repeat(self.starts[ids] - stops + sizes, sizes)].tobytes()


#: of this Python worker, which serves many tasks
_codecs: dict[tuple[str, str], Codec] = {}


def codec_maker(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """Reads the vocabulary on the driver and broadcasts it (its size is fixed: about 1 MB)."""
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    def make() -> Codec:
        if (path, pattern) not in _codecs:
            _codecs.clear()
            _codecs[path, pattern] = Codec(ranks.value, pattern)
        return _codecs[path, pattern]

    return make


def bpe_encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    ids holds little-endian unsigned 32-bit integers. A null text is empty and has no ids. Each row is encoded
    by itself, so repeated rows and null ids are kept as they are; other columns are not returned.
    """
    make_codec = codec_maker(docs.sparkSession, path, pattern)

    def make() -> Callable[..., tuple]:
        codec, sha = make_codec(), lambda b: hashlib.sha256(b).hexdigest()

        def rows(doc_ids: list, texts: list[str | None]) -> Iterator[tuple]:
            for doc_id, ids in zip(doc_ids, codec.encode_all(texts)):
                out = doc_id, len(ids) // 4, sha(ids), sha(codec.decode(ids))
                yield (*out, ids) if with_ids else out

        return rows

    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_batch(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, make)


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The texts of (doc_id, ids)."""
    make_codec = codec_maker(encoded.sparkSession, path, pattern)

    def make() -> Callable[..., tuple]:
        codec = make_codec()
        return lambda doc_id, ids: (doc_id, codec.decode(ids or b"").decode("utf-8", "replace"))

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return per_row(encoded.select("doc_id", "ids"), f"doc_id {kind}, text string", make)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


SQL: dict[str, str] = {}
