"""Scoring pairs with any scorer: requests of a query's documents, bounded concurrency, retries, and what failed ones give."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (question, documents) to a whole number for each document
Score = Callable[[str, list[str]], list[int]]
#: made once a task
Scorer = Callable[[], Score]
_words = re.compile(r"[^ \t\n\x0b\f\r]+").findall


class Unavailable(Exception):
    """What a scorer raises if a later try may do."""


def word_overlap(question: str, documents: list[str]) -> list[int]:
    """The deterministic default: 1 to 10 by the share of the question's distinct words that a document has."""
    asked = set(_words(question.lower()))
    return [1 + 9 * len(asked & set(_words(d.lower()))) // max(1, len(asked)) for d in documents]


def tried(score: Score, question: str, documents: list[str], retries: int, wait: float) -> list[int]:
    """A request, again after ``wait``, twice ``wait`` and so on while the scorer is unavailable, ``retries`` times."""
    for k in range(retries + 1):
        try:
            got = score(question, documents)
        except (Unavailable, ConnectionError, TimeoutError):
            if k == retries:
                raise
            time.sleep(wait * 2**k)
            continue
        if len(got) != len(documents):
            raise ValueError(f"{len(got)} scores for {len(documents)} documents")
        return [max(1, min(10, int(x))) for x in got]
    raise AssertionError("no try")


def score_pairs(
    pairs: DataFrame, make: Scorer = lambda: word_overlap, size: int = 20, at_once: int = 4, retries: int = 3, wait: float = 0.5, fail_fast: bool = True, parts: int | None = None,
) -> DataFrame:
    """(query_idx, doc_id, llm_score, failed) of pairs (query_idx, doc_id, question, text): scores in tenths.

    A task sends requests of at most ``size`` documents of one query and question, ``at_once`` at the same time; so a scorer
    sees ``parts`` * ``at_once`` requests at most. A scorer that is unavailable is asked again after a growing
    wait. What fails for good stops the job with ``fail_fast``; else the request's documents get 0, are marked,
    and count as not scored for a later run. Scores are cut to 1..10. Pairs without a query, a document or a text
    aren't sent and aren't returned. Pairs are dealt by hash of both ids, so that no query is in one task; a
    request's documents are those of a query that meet there, in order of doc_id, and a task that is run again
    sends the same ones.
    """
    sent = pairs.filter("query_idx is not null and doc_id is not null and text is not null").select(F.col("query_idx").cast("long"), F.col("doc_id").cast("string"), F.coalesce("question", F.lit("")).alias("question"), "text")
    parts = parts or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "query_idx", "doc_id").sortWithinPartitions("query_idx", "question", "doc_id", "text")

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[tuple[str, str]]]]:
        query, question, held = None, "", []
        for batch in batches:
            for q, d, asked, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((q, asked) != (query, question) or len(held) == size):
                    yield query, question, held
                    held = []
                query, question = q, asked
                held.append((d, text))
        if held:
            yield query, question, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()

        def one(request: tuple[int, str, list[tuple[str, str]]]) -> pa.RecordBatch:
            query, question, documents = request
            try:
                scores, failed = tried(score, question, [t for _, t in documents], retries, wait), False
            except Exception:
                if fail_fast:
                    raise
                scores, failed = [0] * len(documents), True
            n = len(documents)
            columns = [pa.array([query] * n, pa.int64()), pa.array([d for d, _ in documents]), pa.array([s / 10 for s in scores]), pa.array([failed] * n)]
            return pa.RecordBatch.from_arrays(columns, names=["query_idx", "doc_id", "llm_score", "failed"])

        with ThreadPoolExecutor(at_once) as pool:
            waiting = []
            for request in requests(batches):
                waiting.append(pool.submit(one, request))
                if len(waiting) >= 2 * at_once:
                    yield waiting.pop(0).result()
            while waiting:
                yield waiting.pop(0).result()

    return dealt.mapInArrow(run, "query_idx long, doc_id string, llm_score double, failed boolean")


def strict_scores(reply: str | None, n: int) -> bool:
    """Whether a reply is a JSON list of n whole numbers from 1 to 10, or an object with one under scores, and nothing else."""
    import json

    try:
        found = json.loads(reply or "")
    except ValueError:
        return False
    found = found.get("scores") if isinstance(found, dict) else found
    return isinstance(found, list) and len(found) == n and all(isinstance(x, int) and 1 <= x <= 10 for x in found)
