"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.llm.common import carried, id_and_text, per_row, stored

#: hashed term space
BITS = 22
#: bytes that end a term become spaces, A-Z become lower case; bytes of other scripts stay
_TERMS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


class TermIds(dict):
    """Hash of each term, remembered up to a bound."""

    MOST = 500_000

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[term] = out = zlib.crc32(term) & ((1 << BITS) - 1)
        return out


_ids = TermIds()


def terms(text: str | None) -> set[bytes]:
    """The distinct terms of a whole text."""
    return set((text or "").encode().translate(_TERMS).split())


def hashed_terms(text: str | None) -> set[int]:
    return set(map(_ids.__getitem__, terms(text)))


@dataclass
class FactorizationMachine:
    """score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over a document's features, present or not.

    ``columns`` are the hashed terms, sorted, of the rows of ``w`` and ``v``; other terms have no weight.
    """

    columns: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, features: set[int]) -> float:
        z = self.w0
        if len(self.columns) and features:
            own = np.sort(np.fromiter(features, np.int32, len(features)))
            at = np.searchsorted(self.columns, own)
            at = at[self.columns[np.minimum(at, len(self.columns) - 1)] == own]
            v = self.v[at]
            z += float(self.w[at].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def widths(y: np.ndarray, doc: np.ndarray, idx: np.ndarray, doubt: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How far w and v of each term may go, by the evidence of the rows: no term is left out.

    w by chi / (chi + doubt), of the term's chi-square with the label; v likewise, but by ``least`` times the root
    of the share of rows that have the term at least, as pairs may tell what neither term tells alone.
    """
    n, pos = len(y), float(y.sum())
    df = np.bincount(idx).astype(np.float64)
    a = np.bincount(idx, weights=y[doc])
    b, c = df - a, pos - a
    e = n - pos - b
    chi = n * (a * e - b * c) ** 2 / np.maximum((a + b) * (c + e) * pos * (n - pos), 1e-9)
    own = chi / (chi + doubt)
    return own, np.maximum(own, least * np.sqrt(df / n))


def fit(
    docs: list[np.ndarray], y: np.ndarray, base_rate: float, factors: int = 4, steps: int = 60, rate: float = 0.05,
    decay: tuple[float, float] = (1e-3, 3e-3), doubt: float = 30.0, least: float = 0.5, seed: int = 7,
) -> FactorizationMachine:
    """Adam on the mean log loss, with ``decay`` of w and v in units of their widths, over documents as arrays of distinct hashed terms.

    Decay shrinks all scores, so in the end w0 is moved to put 0.5 where these rows cost least at ``base_rate``,
    a missed toxic document costing twice a false alarm: the middle of the gap, if they can be told apart.
    """
    full = np.array([len(x) > 0 for x in docs])
    sizes = np.array([len(x) for x in docs])[full]
    columns, idx = np.unique(np.concatenate([x for x in docs if len(x)]), return_inverse=True)
    y_all, y, n = y, y[full].astype(np.float32), int(full.sum())
    idx, doc = idx.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), sizes)
    row_starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(idx, kind="stable")
    doc_of, term_starts = doc[order], np.concatenate(([0], np.flatnonzero(np.diff(idx[order])) + 1))
    wide_w, wide_v = widths(y, doc, idx, doubt, least)
    scale = np.concatenate((wide_w[:, None], np.repeat(wide_v[:, None], factors, 1)), 1).astype(np.float32)
    shrink = np.array([decay[0]] + [decay[1]] * factors, np.float32)
    rng = np.random.default_rng(seed)
    p = np.concatenate((np.zeros((len(columns), 1)), rng.normal(0, 0.02, (len(columns), factors))), 1).astype(np.float32)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    w0, m, s = np.log(share / (1 - share)), np.zeros_like(p), np.zeros_like(p)

    def sums(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's sums of v, and its score without w0."""
        total = np.add.reduceat(np.concatenate((own, (own[:, 1:] ** 2).sum(1, keepdims=True)), 1)[idx], row_starts, axis=0)
        xv = total[:, 1:-1]
        return xv, total[:, 0] + 0.5 * ((xv * xv).sum(1) - total[:, -1])

    for t in range(1, steps + 1):
        own = p * scale
        xv, z = sums(own)
        g = ((1 / (1 + np.exp(-np.clip(z + w0, -30, 30))) - y) / n).astype(np.float32)
        grad = np.add.reduceat(np.concatenate((g[:, None], g[:, None] * xv), 1)[doc_of], term_starts, axis=0)
        grad[:, 1:] -= own[:, 1:] * grad[:, :1]
        grad = grad * scale + shrink * p
        m = 0.9 * m + 0.1 * grad
        s = 0.999 * s + 0.001 * grad * grad
        p = p - np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s / np.float32(1 - 0.999**t)) + np.float32(1e-8))
        w0 -= rate * np.sign(g.sum()) * min(1.0, abs(float(g.sum())) * 10)
    p = p * scale
    z = np.zeros(len(y_all))
    z[full] = sums(p)[1].astype(np.float64)
    order = np.argsort(z, kind="stable")
    missed = np.concatenate(([0], np.cumsum(y_all[order]))) / y_all.sum()
    alarms = 1 - np.concatenate(([0], np.cumsum(1 - y_all[order]))) / (len(y_all) - y_all.sum())
    edges = np.concatenate(([z.min() - 1], z[order], [z.max() + 1]))
    cost = 2 * base_rate * missed + (1 - base_rate) * alarms
    cost[edges[1:] == edges[:-1]] = np.inf  # rows with equal scores fall on one side
    cut = int(np.argmin(cost))
    return FactorizationMachine(columns.astype(np.int32), float(-0.5 * (edges[cut] + edges[cut + 1])), p[:, 0].copy(), p[:, 1:].copy())


def crc_fold(doc_id: str, folds: int = 5):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, most_terms: int = 3_000_000, folds: int = 5) -> FactorizationMachine:
    """Fit on labelled documents whose crc32(doc_id as text) mod ``folds`` is not 0, by all their hashed terms.

    The bounds, on labelled rows alone: at most ``most`` documents of each label, in the order of a hash of their
    ids, as long as they have no more than ``most_terms`` distinct terms together (always one document). The
    driver gets these rows, 4 bytes for each term. An id labelled twice takes its largest label, of rows of
    ``docs`` that repeat an id one is taken; null labels and ids are left out. If either label is missing, as when
    a table is empty or no document of a label has terms, the machine gives 0 to every document.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.filter(crc_fold("doc_id", folds) != 0)
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).filter("toxic in (0, 1)").collect()}
    none = FactorizationMachine(np.zeros(0, np.int32), -30.0, np.zeros(0, np.float32), np.zeros((0, 1), np.float32))
    if len(counts) < 2:
        return none
    order = F.xxhash64(F.lit("train"), "doc_id"), F.col("doc_id")
    chosen = [rows.filter(F.col("toxic") == k).orderBy(*order).limit(most) for k in (0, 1)]
    chosen = stored(chosen[0].unionAll(chosen[1]), "toxic-sample")

    def make() -> Callable[..., tuple]:
        def row(doc_id: int, toxic: int, text: str | None) -> tuple:
            f = np.sort(np.array(list(hashed_terms(text)), np.int32))
            return doc_id, toxic, len(f), f.tobytes()

        return row

    own = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # bounded by 2 * most ids
    kind = own.schema["doc_id"].dataType.simpleString()
    sample = per_row(own, f"doc_id {kind}, toxic int, n int, f binary", make).groupBy("doc_id").agg(F.min(F.struct("n", "f", "toxic")).alias("x"))
    sample = stored(sample.select("doc_id", "x.*"), "toxic-terms")
    sofar = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # over 2 * most rows
    got = sample.withColumn("sofar", sofar).filter((F.col("sofar") <= most_terms) | (F.col("sofar") == F.col("n"))).orderBy(*order).select("toxic", "f").toPandas()
    y = got["toxic"].to_numpy(np.float32)
    terms_of = [np.frombuffer(f, np.int32) for f in got["f"]]
    worded = {int(k) for k, x in zip(y, terms_of) if len(x)}
    if len(worded) < 2:
        return none
    return fit(terms_of, y, counts[1] / (counts[0] + counts[1]))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to the columns of ``docs``; columns of these names are replaced.

    Null and empty texts have no terms and take the score of the intercept. Every row is scored by itself, repeated
    rows alike; an empty table gives an empty table.
    """
    own = carried(docs)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    names = own.df.columns
    text = names.index(own.at("text"))

    def make() -> Callable[..., tuple]:
        m = model.value

        def row(*values) -> tuple:
            score = m.score(hashed_terms(values[text]))
            return (*values, score, int(score >= 0.5))

        return row

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.df.schema) + ", x_score double, x_predicted int"
    return own.back(per_row(own.df, schema, make), score=F.col("x_score"), predicted=F.col("x_predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is false for a null id: no label can belong to it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    model = spark.sparkContext.broadcast(machine)

    def make() -> Callable[..., tuple]:
        m = model.value
        return lambda doc_id, text: (doc_id, m.score(hashed_terms(text)))

    scored = per_row(docs, "doc_id long, score double", make)
    held = F.coalesce(crc_fold("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
