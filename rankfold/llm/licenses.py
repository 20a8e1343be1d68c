"""License scans: ordered signature rules with containment suppression. Native throughout."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold.llm.common import ascii_lower, id_and_text, let

#: the characters that stand between words, where A-Z may not be lower-cased yet
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: fixed values of the contract
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label: the licence's name, as a regex over words
NAMES = {
    "mit": "mit",
    "mit-0": "mit no attribution|mit 0",
    "apache-2.0": "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?",
    "apache-1.1": "apache(?: software)?(?: license)?(?: version)? 1 1",
    "apache": "apache(?: software)?",
    "bsd-2-clause": "(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2 clause",
    "bsd-3-clause": "(?:3 clause|three clause|new|modified|revised) bsd|bsd 3 clause",
    "bsd-4-clause": "(?:4 clause|four clause|original) bsd|bsd 4 clause",
    "bsd": "bsd(?: style)?",
    "0bsd": "zero clause bsd|0bsd",
    "isc": "isc|internet systems consortium",
    "gpl-2.0": "gnu general public license(?: version)? 2(?: 0)?|(?:gnu )?gpl(?: version)? ?v?2(?: 0)?",
    "gpl-3.0": "gnu general public license(?: version)? 3(?: 0)?|(?:gnu )?gpl(?: version)? ?v?3(?: 0)?",
    "gpl": "gnu general public|gnu gpl|gpl",
    "lgpl-2.1": "(?:gnu )?(?:lesser|library) general public license(?: version)? 2(?: 1)?|(?:gnu )?lgpl(?: version)? ?v?2(?: 1)?",
    "lgpl-3.0": "(?:gnu )?lesser general public license(?: version)? 3(?: 0)?|(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?",
    "lgpl": "(?:gnu )?(?:lesser|library) general public|(?:gnu )?lgpl",
    "agpl-3.0": "(?:gnu )?affero general public license(?: version)? 3(?: 0)?|(?:gnu )?agpl(?: version)? ?v?3(?: 0)?",
    "agpl": "(?:gnu )?affero general public|(?:gnu )?agpl",
    "gfdl": "gnu free documentation|gfdl",
    "mpl-2.0": "mozilla public license(?: version)? 2(?: 0)?|mpl ?v?2(?: 0)?",
    "mpl-1.1": "mozilla public license(?: version)? 1 1|mpl 1 1",
    "mpl": "mozilla public|mpl",
    "epl-2.0": "eclipse public license(?: version| v)? 2(?: 0)?|epl 2(?: 0)?",
    "epl-1.0": "eclipse public license(?: version| v)? 1(?: 0)?|epl 1(?: 0)?",
    "epl": "eclipse public|epl",
    "cddl": "common development and distribution|cddl",
    "cpl": "common public|cpl",
    "eupl": "european union public|eupl",
    "artistic-2.0": "artistic license(?: version)? 2(?: 0)?",
    "artistic": "artistic|perl artistic",
    "zlib": "zlib(?: libpng)?",
    "libpng": "libpng",
    "boost": "boost(?: software)?|bsl 1 0",
    "unlicense": "unlicense|the unlicense",
    "wtfpl": "do what the fuck you want to public|wtfpl",
    "python": "python(?: software foundation)?|psf",
    "php": "php",
    "ruby": "ruby",
    "postgresql": "postgresql",
    "openssl": "openssl",
    "x11": "x11|mit x11",
    "ncsa": "university of illinois ncsa(?: open source)?|ncsa",
    "ms-pl": "microsoft public|ms pl",
    "ms-rl": "microsoft reciprocal|ms rl",
    "ofl": "sil open font|ofl",
    "odbl": "open (?:data commons open )?database|odbl",
    "odc-by": "open data commons attribution|odc by",
    "pddl": "public domain dedication and license|pddl",
    "ogl": "open government|ogl",
    "gplv2-classpath": "gpl(?: version)? 2 with(?: the)? classpath exception",
    "sspl": "server side public|sspl",
    "busl": "business source|busl",
    "elastic": "elastic",
    "commons-clause": "commons clause",
    "cc0": "cc0(?: 1 0)?|creative commons zero|cc zero",
    "cc-by-nc-nd": "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
    "cc-by-nc-sa": "cc by nc sa|creative commons attribution non ?commercial share ?alike",
    "cc-by-nc": "cc by nc|creative commons attribution non ?commercial",
    "cc-by-nd": "cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?",
    "cc-by-sa": "cc by sa|creative commons attribution share ?alike",
    "cc-by": "cc by|creative commons attribution",
    "creative-commons": "creative commons",
}

VERSION = "(?: (?:version|v|ver))?(?: v?[0-9]+(?: [0-9]+)?)?"
#: priority, confidence, the word that a text must hold, and the phrase around a name
SHAPES = (
    (1, 1.0, "spdx", "spdx license identifier (?:{name})(?: only| or later)?"),
    (2, 0.9, "licen", "(?:re|dual )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: international| unported)?(?: licen[sc]e)?" + VERSION + "(?: international| unported)?"),
    (2, 0.9, "licen", "(?:distributed|released|available|published|redistributed) under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: international| unported)? licen[sc]e" + VERSION),
    (3, 0.7, "licen", "(?:{name}) licen[sc]e" + VERSION),
    (3, 0.7, "licen", "licen[sc]e (?:is )?(?:{name})" + VERSION),
)
#: priority, confidence, label, the word that a text must hold, phrase: notices that name no licence, and names distinct enough alone
NOTICES = (
    (4, 0.5, "copyright", "copyright", "copyright(?: c)?(?: [0-9]{4}){1,8}"),
    (4, 0.5, "reserved", "reserved", "(?:some|no) rights reserved"),
    (4, 0.6, "public-domain", "domain", "(?:in|into|to) the public domain"),
    (4, 0.6, "public-domain", "domain", "public domain (?:dedication|mark|work|notice)"),
    (4, 0.6, "warranty", "warrant", "without warrant(?:y|ies) of any kind"),
    (4, 0.6, "warranty", "warrant", "provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)"),
    (4, 0.6, "permissive", "permission", "permission is hereby granted free of charge(?: to any person)?"),
    (4, 0.6, "permissive", "permission", "permission to use copy modify and(?: or)? distribute"),
    (4, 0.6, "permissive", "redistribut", "redistributions? (?:and use )?(?:in|of) source(?: code)?(?: and binary forms)?"),
    (4, 0.6, "proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)"),
    (4, 0.6, "proprietary", "reproduc", "no part of this (?:work|publication|document|book) may be reproduced"),
    (4, 0.6, "copyleft", "copyleft", "copyleft(?: license)?"),
    (4, 0.5, "gpl", "gpl", "gnu gpl|gplv[123]|gpl [123](?: 0)?"),
    (4, 0.5, "cc-by-nc-nd", "cc", "cc by nc nd" + VERSION),
    (4, 0.5, "cc-by-nc-sa", "cc", "cc by nc sa" + VERSION),
    (4, 0.5, "cc-by-nc", "cc", "cc by nc" + VERSION),
    (4, 0.5, "cc-by-nd", "cc", "cc by nd" + VERSION),
    (4, 0.5, "cc-by-sa", "cc", "cc by sa" + VERSION),
    (4, 0.5, "cc0", "cc", "cc0(?: 1 0)?"),
)


def literals(name: str) -> list[str]:
    """What a match of ``name`` must hold, one for each of its alternatives: its longest part that is always there."""
    while "(" in name:  # groups, the innermost first: their bars don't part the name
        name = re.sub(r"\(\?:[^()]*\)\??", "\0", name)
    return [max(re.split(r"\0|.\?", a), key=len).strip() for a in name.split("|")]


def widest() -> int:
    """The most words that a match of any rule can have: every space of a rule parts two, and one group comes up to eight times."""
    return max(r[-1].count(" ") + (8 if "{1,8}" in r[-1] else 0) for r in rules()) + 1


def rules() -> list[tuple[int, float, str, str, list[str], str]]:
    """Every rule, in order: (priority, confidence, label, keyword, own gates, regex over words with one space between them).

    A match holds the keyword, and one of the own gates if there are any.
    """
    base = [(0, 0.8, label, phrase.split()[0] if phrase != "all rights reserved" else "reserved", [], phrase) for phrase, label in BASE.items()]
    named = [(p, s, label, word, literals(name), shape.replace("{name}", name)) for p, s, word, shape in SHAPES for label, name in NAMES.items()]
    notices = [(p, s, label, word, [], phrase) for p, s, label, word, phrase in NOTICES]
    return [(*r[:5], f"(?<= )(?:{r[5]})(?= )") for r in (*base, *named, *notices)]


def _literal(rows: list[dict], fields: str) -> Column:
    """An array of structs, folded to a constant when planned; one expression, as a call for each value would take seconds."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _cuts(words: Column, r: Column) -> Column:
    """A text's words cut before each match of rule ``r``: number of the cut, words in the piece, words of its match."""
    marked = F.regexp_replace(words, r.phrase, F.lit("\x01$0\x02"))
    cut = lambda p, i: F.struct(
        r.rule.alias("rule"), i.alias("cut"), _spaces(p).alias("words"), (_spaces(F.substring_index(p, "\x02", 1)) + 1).alias("long")
    )
    return let(F.split(marked, "\x01"), lambda ps: F.filter(F.transform(ps, cut), lambda x: F.size(ps) > 1))


def _windows(words: Column, keywords: list[str], reach: int) -> Column:
    """The stretches of an array of words that can hold a match: (first, text), up to ``reach`` words about those with a keyword.

    Stretches that overlap or touch are one, so a match lies whole in just one of them.
    """
    held = "|".join(keywords)
    places = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(held), i)), lambda i: i.isNotNull())

    def joined(at: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(at) - 1)
        near = lambda j, k: F.coalesce(F.get(at, j) - F.get(at, k) <= 2 * reach + 1, F.lit(False))
        firsts = F.transform(F.filter(each, lambda j: ~near(j, j - 1)), lambda j: F.get(at, j))
        lasts = F.transform(F.filter(each, lambda j: ~near(j + 1, j)), lambda j: F.get(at, j))
        return F.arrays_zip(firsts.alias("a"), lasts.alias("b"))

    def text(x: Column) -> Column:
        first = F.greatest(x.a - reach, F.lit(0))
        return F.struct(first.alias("first"), F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, x.b + reach + 1 - first), " "), F.lit(" ")).alias("text"))

    return let(places, lambda at: F.when(F.size(at) > 0, F.transform(joined(at), text)))


def license_scan(docs: DataFrame) -> DataFrame:
    """Scan whole texts for licence phrases: doc_id, n_words, detections, score, one row for each of ``docs``.

    detections is an array of (start, end, label, rule, priority, kept) in order; places are words, counted
    from 0, ends are exclusive. A rule runs only on texts that hold its keyword, there only on the words about
    keywords, as far as the longest match reaches, and only if they hold what its own name must hold. A
    detection is suppressed if one of the same or a higher priority (a lower number) contains it; of equal
    intervals that of the first rule stays. Base rules are never suppressed. score is the largest confidence
    among what is kept, 0 without.

    A null or empty text has no words and no detections; every row, repeated ones and null ids too, is scanned
    by itself; other columns are not returned. An empty table gives an empty table. Texts are never shuffled:
    the cuts of a text, as numbers, are dealt by the row's number, and three windows and a sum share that deal.
    """
    every = rules()
    keywords = sorted({r[3] for r in every})
    parted = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), GAP, " "))
    rows = id_and_text(docs).select("doc_id", F.monotonically_increasing_id().alias("rid"), parted.alias("s"))
    table = _literal([{"rule": k, "word": r[3], "own": r[4], "phrase": r[5]} for k, r in enumerate(every)], "rule int, word string, own array<string>, phrase string")

    def cuts(s: Column) -> Column:
        runs = lambda r: F.contains(s, r.word) & ((F.size(r.own) == 0) | F.exists(r.own, lambda g: F.contains(s, g)))
        return F.flatten(F.transform(F.filter(table, runs), lambda r: _cuts(s, r)))

    held = lambda low: F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in keywords)), let(F.split(low, " "), lambda ws: _windows(ws, keywords, widest() - 1)))
    found = F.transform(let(ascii_lower(F.col("s")), held), lambda w, k: F.struct(k.alias("window"), w.first.alias("first"), cuts(w.text).alias("cuts")))
    n_words = F.when(F.col("s") == "", 0).otherwise(_spaces(F.col("s")) + 1).cast("long")
    rows = rows.select("rid", "doc_id", n_words.alias("n_words"), F.explode_outer(found).alias("w"))
    parts = rows.select("rid", "doc_id", "n_words", "w.window", "w.first", F.explode_outer("w.cuts").alias("c")).select("rid", "doc_id", "n_words", "window", "first", "c.*").repartition("rid")
    ahead = Window.partitionBy("rid", "rule", "window").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.col("first") + F.sum("words").over(ahead) - 1).withColumn("end", F.col("start") + F.col("long"))
    table_of = _literal([{"priority": r[0], "confidence": r[1], "label": r[2]} for r in every], "priority int, confidence double, label string")
    pick = lambda name: table_of[F.col("rule")][name]
    found = F.col("cut") > 0
    parts = parts.withColumn("start", F.when(found, F.col("start"))).withColumn("end", F.when(found, F.col("end")))
    parts = parts.withColumn("priority", F.when(found, pick("priority")))
    longer = Window.partitionBy("rid").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") <= p, F.col("end"))).over(longer) for p in range(max(r[0] for r in every) + 1)]
    parts = parts.withColumn("reach", F.array(*reach)[F.col("priority")])
    kept = (F.col("priority") == 0) | F.col("reach").isNull() | (F.col("reach") < F.col("end"))
    one = F.struct("start", "end", pick("label").alias("label"), "rule", "priority", kept.alias("kept"))
    return parts.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), one))).alias("detections"),
        F.coalesce(F.max(F.when(F.col("start").isNotNull() & kept, pick("confidence"))), F.lit(0.0)).alias("score"),
    ).drop("rid")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base, kept = F.filter("detections", lambda d: d.priority == 0), F.filter("detections", lambda d: d.kept)
    starts = F.transform(base, lambda d: d.start)
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d.label))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), names(base).alias("base_labels"), names(kept).alias("labels"), "score",
    )


def _values() -> str:
    """The rules for SQL, whose regexes can't look about: blanks are doubled there, and a match takes one on either side."""
    rows = ((k, r[0], r[1], r[2], r[3], r[5].removeprefix("(?<= )").removesuffix("(?= )").replace(" ?", "(?:  )?").replace(" ", "  ").replace("    ", "  ")) for k, r in enumerate(rules()))
    return ", ".join(f"({k}, {p}, {c}, '{label}', '{word}', '{phrase}')" for k, p, c, label, word, phrase in rows)


SQL = {
    "op2_license_scan": rf"""
WITH rules(rule, priority, confidence, label, word, phrase) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS r, replace(' ' || trim(regexp_replace(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) || ' ', ' ', '  ') AS s FROM documents),
p AS (SELECT r, rule, priority, confidence, label, string_split(regexp_replace(s, ' (' || phrase || ') ', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS ps
      FROM d JOIN rules ON contains(s, word)),
c AS (SELECT * EXCLUDE ps, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p WHERE len(ps) > 1),
n AS (SELECT *, len(regexp_extract_all(piece, '[^ \x02]+')) AS words, len(regexp_extract_all(string_split(piece, chr(2))[1], '[^ ]+')) AS long FROM c),
m AS (SELECT r, rule, priority, confidence, label, "start", "start" + long AS "end"
      FROM (SELECT *, sum(words) OVER (PARTITION BY r, rule ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "start" FROM n) WHERE i > 1),
k AS (SELECT *, priority = 0 OR NOT EXISTS (
        SELECT 1 FROM m AS o WHERE o.r = m.r AND o.priority <= m.priority AND o."start" <= m."start" AND o."end" >= m."end"
        AND (o."start" < m."start" OR o."end" > m."end" OR o.priority < m.priority OR o.rule < m.rule)) AS kept FROM m)
SELECT any_value(doc_id) AS doc_id, any_value(len(regexp_extract_all(s, '[^ ]+'))) AS n_words, count(*) FILTER (priority = 0) AS n_base,
       min("start") FILTER (priority = 0)::BIGINT AS first_word, max("start") FILTER (priority = 0)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (priority = 0), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kept), '') AS labels,
       coalesce(max(confidence) FILTER (kept), 0)::DOUBLE AS score
FROM d LEFT JOIN k USING (r) GROUP BY r
"""
}
