"""Prompts, answers and contexts as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from rankfold.functions.parsing import word_overlap

#: most characters of a document's raw text that stand for its contexts
MOST_RAW = 8000


def id_int(c: Column) -> Column:
    """The id as a whole number; null if it is none."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))


def prompt(question: Column, context: Column) -> Column:
    asked = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), asked)).otherwise(asked)


def _leaves(x: object) -> list[str]:
    if isinstance(x, str):
        return [x.strip()] if x.strip() else []
    if isinstance(x, (int, float)):
        return [str(x)]
    inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return [leaf for i in inner for leaf in _leaves(i)]


@pandas_udf(StringType())
def contexts(text: pd.Series) -> pd.Series:
    """The texts at any depth of a JSON document's contexts (else context), a blank line between; else the raw text's start.

    Depth is not bounded, which column functions can't follow. Null and blank texts give ''.
    """

    def one(t: str | None) -> str:
        raw = (t or "").strip()
        try:
            found = json.loads(raw)
        except ValueError:
            return raw[:MOST_RAW]
        if not isinstance(found, dict):
            return raw[:MOST_RAW]
        inner = found.get("contexts")
        return "\n\n".join(_leaves(found.get("context") if inner is None else inner)) or raw[:MOST_RAW]

    return text.map(one)


#: fixed values: most characters of a document in a prompt
MOST_IN_PROMPT = 4000


def relevance_prompt(question: Column, documents: Column) -> Column:
    """Asks for the relevance of each of an array of documents, from 1 to 10, as a JSON list; null documents are empty."""
    n = F.size(documents).cast("string")
    cut = lambda d: F.left(F.coalesce(d, F.lit("")), F.lit(MOST_IN_PROMPT))
    items = F.transform(documents, lambda d, i: F.concat(F.lit("--- ITEM "), (i + 1).cast("string"), F.lit(" ---\n"), cut(d)))
    return F.concat(
        F.lit("Say how relevant each item is to the query, from 1 (not at all) over 2 (words in common), 4 (same field), 6 (same topic)\nand 8 (much of it) to 10 (it holds the answer). Reply with "),
        n, F.lit(" whole numbers in the order of the items, as a JSON list and nothing else.\n\nQUERY:\n"), F.coalesce(question, F.lit("")), F.lit("\n\n"), F.array_join(items, "\n\n"), F.lit("\n"),
    )


def answer(output: Column, question: Column) -> Column:
    """The answer in a model's output to ``question``, by the first that there is:

    what follows the first "Answer:" up to the next, its quoted part if it starts with a quote, cut before
    "Question:", and at its first quote if it ends in one and "Question" or "Q"; the first sentence after the question; the first quoted text that isn't in the question; the first
    100 characters without the question; "No answer generated". Null outputs and questions count as empty.
    """
    o, q = F.coalesce(output, F.lit("")), F.coalesce(question, F.lit(""))
    said = F.trim(F.element_at(F.split(o, "Answer:"), 2))
    quoted = F.when(said.rlike('(?s)^"[^"]*"'), F.regexp_extract(said, '^"([^"]*)"', 1)).otherwise(said)
    cut = F.trim(F.split(quoted, "Question:")[0])
    cut = F.when(cut.endswith('" Question') | cut.endswith('" Q'), F.split(cut, '"')[0]).otherwise(cut)  # the start of a next one
    labelled = F.when(o.contains("Answer:"), F.trim(cut))
    at = F.instr(o, F.trim(q))
    rest = F.trim(F.concat(F.substring(o, F.lit(1), at - 1), F.substring(o, at + F.length(F.trim(q)), F.length(o))))
    sentence = F.when((at > 0) & (F.trim(F.split(rest, r"\.")[0]) != ""), F.trim(F.split(rest, r"\.")[0]))
    texts = F.filter(F.regexp_extract_all(o, F.lit('"([^"]*)"'), F.lit(1)), lambda x: (F.trim(x) != "") & ~F.contains(F.lower(q), F.lower(x)))
    left = F.left(F.trim(F.when(q != "", F.replace(o, q, F.lit(""))).otherwise(o)), F.lit(100))
    return F.coalesce(labelled, sentence, F.trim(F.get(texts, F.lit(0))), F.nullif(left, F.lit("")), F.lit("No answer generated"))


def best_answer(rows: DataFrame, score: Column | None = None) -> DataFrame:
    """Hill climbing over (q, question, place, answer, ...): (q, place, answer, score, n), the best answer of each question.

    By ``score``, else by word overlap with the question; the first in place wins ties; blank answers don't count, but in n.
    """
    s = word_overlap(F.col("question"), F.col("answer")) if score is None else score
    valid = F.coalesce(F.trim("answer") != "", F.lit(False))
    row = F.when(valid, F.struct(s.alias("score"), (-F.col("place")).alias("back"), F.col("answer")))
    best = rows.groupBy("q").agg(F.max(row).alias("b"), F.count("*").alias("n"))
    return best.select("q", (-F.col("b.back")).alias("place"), "b.answer", "b.score", "n")


def found_by_id(wanted: DataFrame, corpus: DataFrame, keys: tuple[str, ...] = ("pubid", "PMID", "pid", "id", "doc_id")) -> DataFrame:
    """(q, d, matched): the corpus row of each (q, id), by its own id d, else by the first of ``keys`` in its metadata.

    ``corpus`` is (d, meta map<string,string>); ids compare trimmed and in lower case; ties go to the smaller d.
    One equality join on each row's few names instead of one for each key.
    """
    norm = lambda c: F.lower(F.trim(c))
    names = F.array(F.struct(F.lit(0).alias("p"), F.col("d").cast("string").alias("id")), *(F.struct(F.lit(i + 1).alias("p"), F.try_element_at("meta", F.lit(k)).alias("id")) for i, k in enumerate(keys)))
    named = corpus.select("d", F.inline(names)).filter("id is not null").select("d", "p", norm(F.col("id")).alias("id"))
    asked = wanted.select("q", norm(F.col("id").cast("string")).alias("id")).filter("id <> ''")
    hit = asked.join(named, "id").groupBy("q").agg(F.min(F.struct("p", "d")).alias("m"))
    how = F.get(F.array(F.lit("own id"), *(F.lit(k) for k in keys)), F.col("m.p"))
    return hit.select("q", F.col("m.d").alias("d"), how.alias("matched"))
