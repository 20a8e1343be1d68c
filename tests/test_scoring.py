"""Scorers that fail, for a time or for good, and contexts."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.functions.vectorise import hashed_words, with_vectors
from rankfold.operators import contexts as C
from rankfold.operators import scoring as S


@pytest.fixture
def pairs(spark):
    rows = [(q, f"d{i}", f"what is word{q} and word{i % 7}", f"text word{i % 7} of word{i % 3} here") for q in range(4) for i in range(25)]
    return spark.createDataFrame([*rows, (None, "d", "q", "t"), (1, None, "q", "t"), (1, "none", "q", None), (9, "e", None, "t")], "query_idx long, doc_id string, question string, text string")


def facts(df):
    return sorted((r.query_idx, r.doc_id, r.llm_score) for r in df.collect())


def flaky(times=2, every=3):
    """Fails so often for each request of which a document's number is divisible by ``every``."""

    def make():
        seen, lock = {}, threading.Lock()

        def score(question, documents):
            with lock:
                seen[question, tuple(documents)] = n = seen.get((question, tuple(documents)), 0) + 1
            if n <= times and hash(len(documents) + len(question)) % every == 0:
                raise S.Unavailable("later")
            return S.word_overlap(question, documents)

        return score

    return make


def test_a_scorer_that_fails_for_a_time_gives_the_same_facts(pairs):
    want = facts(S.score_pairs(pairs))
    assert len(want) == 101 and all(0.1 <= s <= 1 for _, _, s in want)
    for size, parts in ((1, 3), (7, 2), (20, 1)):
        assert facts(S.score_pairs(pairs, flaky(), size=size, parts=parts, wait=0.001)) == want


def test_what_fails_for_good_stops_the_job_or_gives_zeros(pairs):
    def make():
        def score(question, documents):
            if question.startswith("what is word2"):
                raise ConnectionError("down")
            return S.word_overlap(question, documents)

        return score

    with pytest.raises(Exception, match="down"):
        S.score_pairs(pairs, make, retries=1, wait=0.001).collect()
    rows = S.score_pairs(pairs, make, retries=1, wait=0.001, fail_fast=False).collect()
    assert {r.query_idx for r in rows if r.failed} == {2} and all((r.llm_score == 0) == r.failed for r in rows)
    with pytest.raises(Exception, match="1 scores for"):
        S.score_pairs(pairs, lambda: lambda q, ds: [5], size=3, parts=1).collect()
    assert {r.llm_score for r in S.score_pairs(pairs, lambda: lambda q, ds: [99] * len(ds)).collect()} == {1.0}


def test_no_more_than_so_many_requests_at_once(pairs, tmp_path):
    def make():
        lock, state = threading.Lock(), {"now": 0}

        def score(question, documents):
            import time

            with lock:
                state["now"] += 1
                if state["now"] > 3:
                    raise ValueError("too many")
            time.sleep(0.005)
            with lock:
                state["now"] -= 1
            return [1] * len(documents)

        return score

    assert S.score_pairs(pairs, make, size=1, at_once=3, parts=2).count() == 101


def test_strict_replies():
    assert S.strict_scores("[1, 10]", 2) and S.strict_scores('{"scores": [3]}', 1)
    assert not any(S.strict_scores(t, 2) for t in (None, "", "[1]", "[1, 11]", "[1, 0]", "[1, 2.0]", '["1", 2]', "x [1, 2]", '{"answer": [1, 2]}', "3"))


def test_contexts_equal_a_plain_loop(spark, sf_dir):
    make = hashed_words(16)
    docs = with_vectors(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), "text"), make)
    texts = [(1, docs.filter("d = 7").first().text), (2, "nothing of this"), (3, ""), (4, None), (5, docs.filter("d = 9").first().text[:80])]
    asked = spark.createDataFrame(texts, "q long, question string")
    rows = docs.orderBy("d").collect()
    m = np.array([r.embedding for r in rows], np.float64)
    got = {r.q: r for r in C.contexts(docs, asked, make, k=6, threshold=0.4, most=3).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and (got[4].n, got[4].context) == (0, "")
    for q, text in texts:
        if text is not None:
            v = make()([text])[0].astype(np.float32).astype(np.float64)
            norm = np.linalg.norm(m, axis=1) * np.linalg.norm(v)
            s = np.round(np.divide(m @ v, norm, out=np.zeros(len(m)), where=norm > 0), 6)
            near = np.lexsort((np.arange(len(s)), -s))[:6]
            kept = [i for i in near if s[i] >= 0.4][:3]
            assert got[q].n == len(kept) and got[q].context == "\n\n".join(rows[i].text for i in kept)
    with pytest.raises(ValueError):
        C.retrieve(docs, asked, make, similarity="l2")
