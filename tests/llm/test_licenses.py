"""The gates of licence rules, and windows against whole texts."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankfold.llm import licenses

RULES = licenses.rules()


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data(), st.sampled_from(RULES))
def test_every_match_holds_its_gates_and_is_no_wider_than_the_windows(data, rule):
    _, _, _, word, own, phrase = rule
    text = data.draw(st.from_regex(re.compile(phrase.removeprefix("(?<= )").removesuffix("(?= )"), re.ASCII), fullmatch=True))
    assert word in text and (not own or any(g in text for g in own))
    assert len(text.split()) <= licenses.widest()


def brute(text):
    """Every rule on the whole text, and suppression by comparing all pairs."""
    s = " " + re.sub(licenses.GAP, " ", text).strip().lower() + " "
    at = lambda i: s[:i].count(" ") - 1
    found = [(at(m.start()), at(m.end()) + 1, r[2], k, r[0]) for k, r in enumerate(RULES) for m in re.finditer(r[5], s)]
    over = lambda a, b: b[4] <= a[4] and b[0] <= a[0] and b[1] >= a[1] and (b[:2] != a[:2] or (b[4], b[3]) < (a[4], a[3]))
    return sorted((*a, a[4] == 0 or not any(over(a, b) for b in found)) for a in found)


def test_windows_find_what_whole_texts_hold(spark):
    far = "plain words without any of them " * 30
    texts = [
        far + "Licensed under the Apache License, Version 2.0 and the MIT license" + far + "copyright (c) 2001, 2002, 2003 license: BSD 3-clause" + far,
        "mit license " * 40 + far + "cc by " * 60, "license " * 500, far + "Distributed under the terms of the GNU General Public License version 3 license",
        "SPDX-License-Identifier: GPL-3.0-only", "no part of this book may be reproduced" + far * 50 + "all rights reserved", far, "",
        "dual licensed under mit license or apache software license version 2 0 license is zlib", "x " * 50_000 + "cc by nc sa 4.0 international",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted(tuple(d) for d in r.detections) for r in licenses.license_scan(rows).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_a_text_of_ten_megabytes(spark):
    rows = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word " * 98 + "cc by "), 20_000).alias("text"))
    (r,) = licenses.license_scan(rows).select("n_words", F.size(F.filter("detections", lambda d: d.priority == 0)).alias("n")).collect()
    assert (r.n_words, r.n) == (2_000_000, 20_000)
