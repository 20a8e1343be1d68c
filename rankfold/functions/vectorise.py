"""Texts to vectors: a protocol for embedding models, and a deterministic default that needs none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructType

#: made once a task; maps texts to a matrix with a row each
Vectoriser = Callable[[], Callable[[list[str]], np.ndarray]]
_words = re.compile(r"[^ \t\n\x0b\f\r]+").findall


class Places(dict):
    """Twice the place of each word that was asked for, and one more if its sign is minus; both as its MD5 says."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, w: str) -> int:
        h = hashlib.md5(w.encode()).digest()
        at = self[w] = 2 * (int.from_bytes(h[:2]) % self.width) + (h[2] & 1)
        return at


#: by width, of this Python worker, which serves many tasks
_places: dict[int, Places] = {}


class HashedWords:
    """Counts of lower-cased words, each at the place and with the sign that its MD5 says; unit length, or zero without words."""

    MOST = 500_000

    def __init__(self, width: int = 64):
        self.width, self.at = width, _places.setdefault(width, Places(width))

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [_words(t.lower()) for t in texts]
        if len(self.at) > self.MOST:
            self.at.clear()
        out = np.zeros((len(texts), self.width))
        for row, ws in zip(out, split):
            if ws:
                counts = np.bincount(np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)), minlength=2 * self.width)
                row += counts[0::2] - counts[1::2]
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)


def hashed_words(width: int = 64) -> Vectoriser:
    return lambda: HashedWords(width)


def with_vectors(rows: DataFrame, make: Vectoriser, text: str = "text", name: str = "embedding", at_once: int = 64) -> DataFrame:
    """Adds the vector of each row's text, null for a null text; other columns stay, and one called ``name`` is replaced.

    The model is made once a task and gets at most ``at_once`` texts at a time. A result that hasn't a finite row
    for each text is an error, so that a bad model stops the job and stores nothing.
    """
    columns = [c for c in rows.columns if c != name]
    kept = rows.select(*columns)
    schema = StructType(list(kept.schema.fields)).add(name, ArrayType(FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                piece = batch.slice(start, at_once)
                texts, vectors = piece.column(columns.index(text)), [None] * piece.num_rows
                given = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False)).tolist()
                if given:
                    m = np.asarray(model([texts[i].as_py() for i in given]), np.float64)
                    if m.ndim != 2 or len(m) != len(given) or not np.isfinite(m).all():
                        raise ValueError(f"the model gave {m.shape} for {len(given)} texts, or numbers that aren't finite")
                    for i, row in zip(given, m.astype(np.float32)):
                        vectors[i] = row
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*columns, name])

    return kept.mapInArrow(run, schema)
