"""Quality rules: clean line by line, then reject documents that lose too much. Native throughout."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import SPACE, WORD, carried, let, words_of

NOT_SYMBOL = r"[^#*$%&|<>]+"
PLAIN = r"""[\p{L}\p{M}\p{N}\x20\x09-\x0D.,;:!?'"()\-]+"""
NOT_SEPARATOR = "[^|>»·•]+"
MENU = r"^(?:home|menu|log ?in|sign ?in|sign ?up|next|previous|back to top|share this|skip to content)\W*$"
PHRASES = (
    "cookie", "terms of use", "terms of service", "privacy policy", "click here", "read more", "subscribe", "newsletter",
    "enable javascript", "all rights reserved", "page not found",
)
MARKUP = ("lorem ipsum", "javascript:", "{{", "}}", "</")
#: what a finished line ends with, and what a cut one ends with
ENDS, CUT = ".!?…:;\"'’”»)]。！？", ("...", "…")
#: a short line; how many of them, one behind the other, are a list of links; how long a line with a stock phrase is
SHORT, SHORT_WORDS, ROW, PHRASE_WORDS = 40, 3, 4, 15


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in the text.

    Windows are compared by 64 bits of hash of their words' hashes. They are sorted with their places only if
    two are equal; the places of equal neighbours, in order, then cover the words. All steps are O(n log n).
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    def places(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j).h == F.get(s, k).h, F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j).i))

    def covered(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(window), lambda n, j: n + F.least(F.lit(window), F.get(p, j) - F.get(p, j - 1)))

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(let(ordered, places), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) <= window, 0).otherwise(let(windows(h), count)))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(x)) for x in parts))


def line_fails(line: Column, most_symbols: float) -> Column:
    """A line fails by punctuation (too many symbols, or cut off), as navigation (a row of short items, or a menu's word)."""
    symbols = F.length(F.regexp_replace(line, PLAIN, ""))
    row = let(F.length(F.regexp_replace(line, NOT_SEPARATOR, "")), lambda n: (n >= 2) & (F.length(line) <= 40 * (n + 1)))
    menu = (F.length(line) <= 24) & F.lower(line).rlike(MENU)
    cut = reduce(or_, (F.endswith(line, F.lit(x)) for x in CUT))
    return (symbols > most_symbols * F.length(line)) | row | menu | cut


def is_boilerplate(line: Column) -> Column:
    """Markup anywhere, or a stock phrase in a line of PHRASE_WORDS words or fewer: longer ones are prose about it."""
    return let(F.lower(line), lambda x: any_of(x, MARKUP) | any_of(x, PHRASES) & (F.size(words_of(x)) <= PHRASE_WORDS))


def is_finished(line: Column) -> Column:
    return (line != "") & F.contains(F.lit(ENDS), F.substring(line, -1, 1))


def is_short(line: Column) -> Column:
    """One to SHORT_WORDS words, SHORT characters at most, and no mark at the end."""
    return (F.length(line) <= SHORT) & (line != "") & ~is_finished(line) & (F.size(words_of(line)) <= SHORT_WORDS)


def later_copies(lines: Column) -> Column:
    """Of each line, whether two lines before it, with words, are equal to it: sorted by hash and place, then put back."""

    def told(s: Column) -> Column:
        back = lambda x, j: F.struct(x.i.alias("i"), ((x.h != 0) & F.coalesce(F.get(s, j - 2).h == x.h, F.lit(False))).alias("third"))
        return F.transform(F.sort_array(F.transform(s, back)), lambda x: x.third)

    hashes = F.transform(lines, lambda x, i: F.struct(F.when(x == "", 0).otherwise(F.xxhash64(x)).alias("h"), i.alias("i")))
    return let(F.sort_array(hashes), told)


def failing(text: Column, most_symbols: float) -> Column:
    """Of each line of a text, in order, whether it fails.

    Rules on one line: ``line_fails`` and ``is_boilerplate``. Rules on its text: a short line without a mark at its
    end fails where finished lines have over half of the characters, or if it stands in ROW or more of its kind; a
    line fails that two lines before it are equal to. Blanks at the ends of lines don't count. Steps are O(n log n).
    """

    def rows(short: Column) -> Column:
        at = lambda i: F.coalesce(F.get(short, i), F.lit(False))
        starts = F.transform(short, lambda x, i: reduce(and_, (at(i + k) for k in range(ROW))))
        return let(starts, lambda s: F.transform(short, lambda _, i: reduce(or_, (F.coalesce(F.get(s, i - k), F.lit(False)) for k in range(ROW)))))

    def told(lines: Column) -> Column:
        chars = lambda xs: F.length(F.array_join(xs, ""))
        mostly = 2 * chars(F.filter(lines, is_finished)) > chars(lines)
        short = F.transform(lines, is_short)
        by_text = let(short, lambda s: F.when(F.exists(s, lambda x: x), F.when(mostly, s).otherwise(rows(s))))
        copies = F.when(F.size(lines) > 2, later_copies(lines))
        stock = let(F.lower(text), lambda t: any_of(t, MARKUP + PHRASES))
        here = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(False))
        several = F.struct(by_text.alias("a"), copies.alias("b"), stock.alias("c"))
        return let(several, lambda m: F.transform(lines, lambda x, i: line_fails(x, most_symbols) | (m.c & is_boilerplate(x)) | here(m.a, i) | here(m.b, i)))

    return let(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE))), told)


def quality(docs: DataFrame, min_words: int = 10, most_repeats: int = 20, most_symbols: float = 0.2, most_lost: float = 0.5) -> DataFrame:
    """Judge whole texts and clean them.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text to the
    columns of ``docs``; columns of these names are replaced. base_failed: fewer than ``min_words`` words, or
    over ``most_repeats`` percent of them in repeated 5-word windows. Otherwise lines that fail (see ``failing``)
    are removed, and a text that loses over ``most_lost`` of its characters on lines is not kept. clean_text has the lines that are left. A null or empty text has no words, so it fails. Rows are
    judged one by one: repeated rows alike, null ids too. An empty table gives an empty table. No rows are
    shuffled.
    """
    own = carried(docs)
    text = F.coalesce(own.at("text"), F.lit(""))

    def judged(t: Column) -> Column:
        with_word = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        return let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
                let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                let(failing(t, most_symbols), lambda bad: F.length(F.array_join(F.filter(F.split(t, "\n"), lambda x, i: F.get(bad, i)), ""))).alias("lost"),
                (F.length(t) - F.size(F.split(t, "\n")) + 1).alias("chars"),
            ),
        )

    rows = own.df.select("*", F.explode(F.array(let(text, judged))).alias("j"))
    failed = (F.col("j.n_words") < min_words) | (100 * F.col("j.n_repeat_words") > most_repeats * F.col("j.n_words"))
    whole = F.col("j.lost") <= most_lost * F.col("j.chars")
    clean = let(failing(text, most_symbols), lambda bad: F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.get(bad, i)), "\n"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return own.back(
        rows, **{n: F.col(f"j.{n}") for n in names}, base_failed=failed, kept=~failed & whole, clean_text=F.when(F.col("j.lost") == 0, text).otherwise(clean)
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _any_sql(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(x), '{p}')" for p in parts) + ")"


_PLAIN_SQL, _ENDS_SQL = PLAIN.replace("'", "''"), ENDS.replace("'", "''")
SQL = {
    "op3_quality": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
      FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, range(5) AS x(k) WHERE n >= 2 GROUP BY r),
l AS (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM w),
x AS (SELECT r, i, l, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
e AS (SELECT *, x <> '' AS has, x <> '' AND contains('{_ENDS_SQL}', right(x, 1)) AS finished, len(regexp_extract_all(x, '{WORD}')) AS nw,
             length(regexp_replace(x, '{NOT_SEPARATOR}', '', 'g')) AS seps FROM x),
s AS (SELECT *, length(x) <= {SHORT} AND has AND NOT finished AND nw <= {SHORT_WORDS} AS short,
             2 * coalesce(sum(length(x)) FILTER (finished) OVER (PARTITION BY r), 0) > sum(length(x)) OVER (PARTITION BY r) AS mostly,
             has AND row_number() OVER (PARTITION BY r, x ORDER BY i) > 2 AS third FROM e),
t AS (SELECT *, count(*) FILTER (short) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {ROW - 1} FOLLOWING) = {ROW} AS starts FROM s),
b AS (SELECT *, length(regexp_replace(x, '{_PLAIN_SQL}', '', 'g')) > 0.2 * length(x) OR (seps >= 2 AND length(x) <= 40 * (seps + 1))
                OR (length(x) <= 24 AND regexp_matches(lower(x), '{MENU}')) OR {" OR ".join(f"x LIKE '%{c}'" for c in CUT)}
                OR {_any_sql(MARKUP)} OR ({_any_sql(PHRASES)} AND nw <= {PHRASE_WORDS}) OR (short AND mostly) OR third
                OR bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {ROW - 1} PRECEDING AND CURRENT ROW) AS bad FROM t),
m AS (SELECT r, count(*) FILTER (has) - count(DISTINCT l) FILTER (has) AS n_dup_lines, sum(length(l)) AS chars,
             coalesce(sum(length(l)) FILTER (bad), 0) AS lost FROM b GROUP BY r),
q AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost, chars
      FROM w JOIN m USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.5 * chars AS kept FROM f
"""
}
