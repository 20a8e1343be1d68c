"""Replies to scoring requests: from lines of replies to scores, states of requests and counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.functions import parsing as P
from rankfold.operators.pool import update_scores

SUBMITTED, SUCCEEDED, MISSING = "submitted", "succeeded", "missing"


class Synced(NamedTuple):
    results: DataFrame  #: as given, with the scores of the replies
    requests: DataFrame  #: as given, with new states
    counts: DataFrame  #: one row: lines, bad_lines, skipped, updated


def reply_lines(lines: DataFrame) -> DataFrame:
    """(seq, json, custom_id, bad) of lines (seq, value), without blank ones.

    A line is bad unless it is a JSON object with a response (null is one) and an id under custom_id, key or id.
    """
    rows = lines.select("seq", F.trim("value").alias("json")).filter("json <> ''")
    fields = F.from_json("json", "map<string,string>")
    key = F.coalesce(*(F.nullif(F.get_json_object("json", f"$.{k}"), F.lit("")) for k in ("custom_id", "key", "id")))
    bad = ~F.coalesce(F.map_contains_key(fields, "response"), F.lit(False)) | key.isNull()
    return rows.withColumn("custom_id", key).withColumn("bad", bad)


def _scores(n: Column) -> tuple[Column, Column]:
    """A line's n scores, and whether it gives none: a block, or nothing but zeros."""
    blocked = P.blocked(F.col("json"))
    read = F.when(blocked, F.array_repeat(F.lit(0), n)).otherwise(P.parse_scores(P.reply_text(F.col("json")), n))
    return read, ~F.exists(read, lambda x: x != 0)


def sync(results: DataFrame, requests: DataFrame, lines: DataFrame, overwrite: bool = False) -> Synced:
    """Put the replies' scores (tenths) into ``results`` (query_idx, doc_id, llm_score, ...).

    ``requests`` are (custom_id, query_idx, doc_ids, status), custom_id unique. Unless ``overwrite``, a request
    whose documents all have a score is skipped and counts as succeeded; so of several replies the first stands
    where all documents are in ``results``, and the last where not or with ``overwrite``. A reply without scores
    gives zeros and makes its request missing, as does no reply to a submitted one. Lines of unknown requests and
    requests without documents change nothing. A document in two requests takes the later line. Empty tables
    give empty tables.
    """
    parsed = reply_lines(lines)
    asked = requests.select("custom_id", "query_idx", F.transform("doc_ids", P.norm_id).alias("doc_ids")).filter(F.size("doc_ids") > 0)
    pairs = asked.select("custom_id", "query_idx", F.size("doc_ids").alias("n"), F.explode("doc_ids").alias("doc_id"))
    have = results.select("query_idx", "doc_id", F.col("llm_score").isNotNull().cast("int").alias("set"))
    state = pairs.join(have, ["query_idx", "doc_id"], "left").groupBy("custom_id").agg(
        (F.count("set") == F.max("n")).alias("whole"), (F.coalesce(F.sum("set"), F.lit(0)) == F.max("n")).alias("done")
    )
    good = parsed.filter(~F.col("bad")).select("custom_id", "seq", "json")
    read = good.join(asked, "custom_id")
    scores, none = _scores(F.size("doc_ids"))
    read = read.select("custom_id", "query_idx", "doc_ids", "seq", scores.alias("scores"), none.alias("none")).join(state, "custom_id")
    line = F.struct("seq", "query_idx", "doc_ids", "scores", "none")
    replied = read.groupBy("custom_id", "whole", "done").agg(F.min_by(line, "seq").alias("first"), F.max_by(line, "seq").alias("last"), F.bool_or("none").alias("any_none"), F.count("*").alias("n"))
    stands, skip = (F.lit(False), F.lit(False)) if overwrite else (F.col("whole"), F.col("done"))
    replied = replied.select(
        "custom_id", skip.alias("skip"), F.when(stands, F.col("first")).otherwise(F.col("last")).alias("r"),
        F.when(stands, F.col("first.none")).otherwise(F.col("any_none")).alias("none"),
        F.when(skip, F.col("n")).when(stands, F.col("n") - 1).otherwise(0).alias("skipped"),
    )
    taken = replied.filter(~F.col("skip"))
    new = taken.select("r.query_idx", "r.seq", F.inline(F.arrays_zip(F.col("r.doc_ids").alias("doc_id"), F.col("r.scores").alias("v"))))
    new = new.select("query_idx", "doc_id", (F.col("v") / 10.0).alias("new_score"), "seq")
    states = replied.select("custom_id", F.when(F.col("skip") | ~F.col("none"), SUCCEEDED).otherwise(MISSING).alias("new_status"))
    after = requests.join(states, "custom_id", "left").withColumn("status", F.coalesce("new_status", F.when(F.col("status") == SUBMITTED, MISSING).otherwise(F.col("status")))).drop("new_status")
    updated = new.join(results.select("query_idx", "doc_id"), ["query_idx", "doc_id"], "left_semi").agg(F.count("*").alias("updated"))
    seen = parsed.agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad_lines"))
    skipped = replied.agg(F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return Synced(update_scores(results, new), after, seen.crossJoin(skipped).crossJoin(updated))  # three single rows


def pilot_scores(text: Column, n: Column | int) -> Column:
    """The pilot's reading: the first [...], or else the text, as a list whose odd entries are 0; or else numbers from 1 to 10."""
    t = F.trim(text)
    listed = F.from_json(F.coalesce(F.nullif(F.regexp_extract(t, r"\[[\s\S]*?\]", 0), F.lit("")), t), "array<string>")
    whole = F.when(t.rlike(r"\[[\s\S]*?\]") | t.startswith("["), F.transform(listed, lambda x: F.coalesce(x.try_cast("double").try_cast("int"), F.lit(0))))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"\b(10|[1-9])\b"), F.lit(1)), lambda x: x.cast("int"))
    return P.fit(F.coalesce(whole, numbers), n)


def sync_pilot(results: DataFrame, requests: DataFrame, lines: DataFrame) -> DataFrame:
    """``results`` with the first score of each reply for its request's first document; always overwrites, the last line stands.

    A line that is no JSON stops the job. Lines without custom_id, of unknown requests or of requests without documents change nothing.
    """
    rows = lines.select("seq", F.trim("value").alias("json")).filter("json <> ''")
    rows = rows.withColumn("custom_id", F.get_json_object(F.parse_json("json").cast("string"), "$.custom_id"))
    first = requests.select("custom_id", "query_idx", P.norm_id(F.get("doc_ids", F.lit(0))).alias("doc_id")).filter("doc_id <> ''")
    new = rows.join(first, "custom_id").select("query_idx", "doc_id", "seq", (F.get(pilot_scores(P.reply_text(F.col("json")), 1), F.lit(0)) / 10.0).alias("new_score"))
    return update_scores(results, new)


def retry_requests(again: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored request lines (custom_id, json) to send again, each once, and the custom_ids that have none."""
    lines = index.groupBy("custom_id").agg(F.min("json").alias("json"))
    return lines.join(again, "custom_id", "left_semi"), again.join(lines, "custom_id", "left_anti")
