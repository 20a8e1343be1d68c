"""Scalar text functions as columns: ids, normalisation, score parsing, responses, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: ASCII punctuation
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: fixed values: keys that may hold a document's id, in order, and a list of scores
ID_KEYS = ("PMID", "pubid", "pid", "id", "doc_id")
SCORE_KEYS = ("scores", "answer", "answers", "result", "results", "values", "output")
SUFFIX = "...[truncated]"


def norm_id(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def truth_id(json: Column) -> Column:
    """The first id among ID_KEYS, each also in lower case; '' without."""
    return norm_id(F.coalesce(*(F.get_json_object(json, f"$.{k}") for key in ID_KEYS for k in (key, key.lower())), F.lit("")))


def norm_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), r"\s+", " "))


def clamp(c: Column, low: int = 1, high: int = 10) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(low))))


def _whole(x: Column) -> Column:
    """An element of a JSON list as a whole number, by its own type: numbers without their fraction, true as 1, texts of digits; else null."""
    kind, text = F.schema_of_variant(x), F.trim(F.try_variant_get(x, "$", "string"))
    digits = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double").try_cast("int"))
    return F.when(kind == "STRING", digits).when(kind == "BOOLEAN", (text == "true").cast("int")).otherwise(number)


def _ints(json: Column) -> Column:
    """Whole numbers of a JSON list; other elements are left out; null if it is no list or has none."""
    listed = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    found = F.filter(F.transform(listed, _whole), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def fit(scores: Column, n: Column | int, low: int = 0, high: int = 10, pad: int = 0) -> Column:
    """Clamped, padded or cut to n."""
    kept = F.transform(F.coalesce(scores, F.array().cast("array<int>")), lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return F.slice(F.concat(kept, F.array_repeat(F.lit(pad), n)), F.lit(1), F.lit(n))


def parse_scores(text: Column, n: Column | int) -> Column:
    """The scores of a reply: a JSON list; a list under SCORE_KEYS; the first [...]; or else numbers from 1 to 10 in the text."""
    t = F.trim(text)
    lists = [F.when(t.startswith("["), _ints(t)), *(_ints(F.get_json_object(t, f"$.{k}")) for k in SCORE_KEYS), _ints(F.regexp_extract(t, r"\[[\s\S]*?\]", 0))]
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"\b(10|[1-9])\b"), F.lit(1)), lambda x: x.cast("int"))
    return fit(F.coalesce(*lists, numbers), n)


def live_scores(scores: Column, n: int) -> Column:
    """Clamped to 1..10; missing ones are 1."""
    return fit(scores, n, 1, 10, 1)


def single_score(text: Column) -> Column:
    """The first number from 1 to 10, over 10; 0.0 without one."""
    return F.coalesce(F.regexp_extract(text, r"\b(10|[1-9])\b", 1).try_cast("double") / 10.0, F.lit(0.0))


_REPLY = (
    "text string, choices array<struct<message:struct<content:string>>>, prompt_feedback struct<block_reason:string>, "
    "candidates array<struct<content:struct<parts:array<struct<text:string>>>,finish_reason:string>>"
)


def _object(json: Column) -> Column:
    return F.when(json.startswith("{"), json)


def _body(json: Column) -> Column:
    """The response's body if that is an object, else the response itself; null if that is none."""
    return F.from_json(F.coalesce(_object(F.get_json_object(json, "$.response.body")), _object(F.get_json_object(json, "$.response"))), _REPLY)


def reply_text(json: Column) -> Column:
    """The reply's text in any of three shapes, of all candidates line by line; null without one."""
    body = _body(json)
    parts = F.flatten(F.filter(F.transform(body["candidates"], lambda c: c["content"]["parts"]), lambda p: p.isNotNull()))
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
    return F.coalesce(body["text"], F.get(body["choices"], F.lit(0))["message"]["content"], F.when(F.size(texts) > 0, F.array_join(texts, "\n")))


def response_text(json: Column) -> Column:
    """``reply_text``, '' without one."""
    return F.coalesce(reply_text(json), F.lit(""))


def blocked(json: Column) -> Column:
    """No response, a stated reason of a block, or any candidate that ended for safety or by a block."""
    body = _body(json)
    reason = F.upper(F.coalesce(body["prompt_feedback"]["block_reason"], F.lit("")))
    ended = F.exists(body["candidates"], lambda c: F.coalesce(F.upper(c["finish_reason"]).rlike("SAFETY|BLOCK"), F.lit(False)))
    return body.isNull() | ~reason.isin("", "BLOCK_REASON_UNSPECIFIED") | F.coalesce(ended, F.lit(False))


def truncated(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(SUFFIX))).otherwise(c)


def word_overlap(question: Column, answer: Column) -> Column:
    """The share of the question's distinct words that the answer has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(question), words(answer))) / F.greatest(F.size(words(question)), F.lit(1))


def source_type(c: Column, local: list[str] | None = None) -> Column:
    """What a source names; ``local`` are the paths that are there, which the caller lists."""
    here = c.isin(local) if local else F.lit(False)
    return F.when(c.rlike(r"^\w+:\w+$"), "huggingface_dataset_with_config").when(c.rlike(r"^\w+$"), "huggingface_dataset").when(c.rlike(r"^https?://[^/]+/.*"), "url").when(~c.rlike("^https?://") & here, "local_path").otherwise("invalid")


def allowed_url(c: Column, hosts: list[str]) -> Column:
    return F.coalesce(c.startswith("https://") & F.parse_url(c, F.lit("HOST")).isin(hosts), F.lit(False))


def verdict(original: Column, optimized: Column) -> Column:
    """Optimized, Original, or Tie if they differ by under 0.001, or under 0.01 and 5 percent."""
    d = F.abs(optimized - original)
    close = d / F.greatest(F.abs(original), F.abs(optimized), F.lit(1e-6)) < 0.05
    return F.when((d < 0.001) | ((d < 0.01) & close), "Tie").when(optimized > original, "Optimized").otherwise("Original")


def consensus(votes: list[Column]) -> tuple[Column, Column]:
    """The commonest vote and its share; ties go to Original, then Optimized."""
    n = {v: sum((F.when(x == v, 1).otherwise(0) for x in votes), F.lit(0)) for v in ("Original", "Optimized", "Tie")}
    best = F.when((n["Original"] >= n["Optimized"]) & (n["Original"] >= n["Tie"]), "Original").when(n["Optimized"] >= n["Tie"], "Optimized").otherwise("Tie")
    return best, F.greatest(*n.values()) / len(votes)


def final_decision(judge: Column, agreed: Column, confidence: Column, weight: float = 0.7) -> Column:
    return F.when((judge != agreed) & (F.lit(weight) > confidence), judge).otherwise(agreed)


def judge_text(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.contains("optimized"), "Optimized").when(t.contains("original"), "Original").when(t.contains("tie"), "Tie").when(t.contains("optim"), "Optimized").when(t.contains("origin"), "Original").otherwise("Tie")


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dd %dh %dm %ds", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
