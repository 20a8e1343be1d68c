"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

All stages take the columns of documents and leave other columns out, whatever their names. An empty table gives an
empty table. Null texts count as empty ones and null ids and sources are values of their own; toxicity, line_dedup,
mixing and bpe treat repeated rows one by one, simhash leaves one row of equal ones.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.bpe import bpe_encode
from rankfold.llm.common import stored
from rankfold.llm.line_dedup import line_dedup
from rankfold.llm.mixing import mixed_documents
from rankfold.llm.simhash import simhash_dedup
from rankfold.llm.toxicity import score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents; n_chars as of the text that is left."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("long")} if text != "text" else {}
    return df.select(*(changed.get(c, F.col(c)).alias(c) for c in COLUMNS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on these texts and labels, doesn't predict to be toxic."""
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(score_toxicity(docs.select(*COLUMNS), machine).filter("predicted = 0"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that at least ten documents share; documents whose text goes whole stay, empty."""
    return _documents(line_dedup(docs.select(*COLUMNS)), "kept_text")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _documents(simhash_dedup(docs.select(*COLUMNS)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _documents(mixed_documents(docs.select(*COLUMNS)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned 32-bit integers)."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("simhash", simhash),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: learning, SimHash and BPE are beyond SQL
ORACLE_SQL: str | None = None
