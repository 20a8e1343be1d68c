"""The line rules of the quality operator against a plain version, line by line."""

import random
import re

from rankfold.llm import quality as Q
from tests.llm.test_operators import SCHEMA, row

BLANK = " \t\n\x0b\x0c\r"
PROSE = "One sentence of some eight words ends here."
LINES = [
    PROSE, "A sentence that was cut off in the ...", "Another one that stops…", "Heading", "Two words", "a heading of four words", "Home | About | Contact", "sign in >>", "menu", "",
    " \t ", "We use cookies.", "Cookies are baked by my aunt each Sunday, and then the whole family of twelve sits down to eat them.", "<b>bold</b> text.", "### *** $$$ ###", "Refrain.", "REFRAIN.",
    "“Quoted.”", "Ende。", "\x0bpadded.\r", "x" * 60,
]


def brute(text):
    lines = [x.strip(BLANK) for x in text.split("\n")]
    finished = [x != "" and x[-1] in Q.ENDS for x in lines]
    short = [x != "" and len(x) <= 40 and not f and len(re.findall(r"[^\x20\x09-\x0D]+", x)) <= 3 for x, f in zip(lines, finished)]
    mostly = 2 * sum(len(x) for x, f in zip(lines, finished) if f) > sum(map(len, lines))
    out = []
    for i, x in enumerate(lines):
        low, seps = x.lower(), len(re.findall("[|>»·•]", x))
        bad = sum(not (c.isalnum() or c in " \t\n\x0b\x0c\r.,;:!?'\"()-") for c in x) > 0.2 * len(x) or (seps >= 2 and len(x) <= 40 * (seps + 1))
        bad |= len(x) <= 24 and re.match(Q.MENU.replace(r"\W", r"[\W]"), low) is not None
        bad |= x.endswith(("...", "…")) or any(p in low for p in Q.MARKUP) or (any(p in low for p in Q.PHRASES) and len(x.split()) <= 15)
        bad |= x != "" and lines[:i].count(x) >= 2
        bad |= short[i] and (mostly or any(all(short[k : k + 4]) and len(short[k : k + 4]) == 4 for k in range(max(0, i - 3), i + 1)))
        out.append(bad)
    return out


def test_line_rules_equal_a_plain_version(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ["", "\n", "a\nb\nc\nd", "a\nb\nc", "a\nb\n\nc\nd", f"{PROSE}\nHeading\n{PROSE}", "no marks at all in this text\nHeading", "w.\n" * 9]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.clean_text, r.base_failed, r.kept) for r in Q.quality(docs).collect()}
    for i, t in enumerate(texts):
        bad, lines = brute(t), t.split("\n")
        lost = sum(len(x) for x, b in zip(lines, bad) if b)
        assert got[i][0] == (t if not lost else "\n".join(x for x, b in zip(lines, bad) if not b)), t
        assert got[i][2] == (not got[i][1] and lost <= 0.5 * sum(map(len, lines))), t


def test_prose_about_cookies_and_headings_stay_harmless(spark):
    prose = "\n".join(["A title", LINES[12], PROSE, "Cookies were found to be good by everyone of the twelve who had come to sit down at the table."])
    links = "\n".join(f"link {i}" for i in range(40))
    got = {r.doc_id: r for r in Q.quality(spark.createDataFrame([row(1, prose), row(2, links)], SCHEMA)).collect()}
    assert got[1].kept and got[1].clean_text == prose.split("\n", 1)[1]
    assert not got[2].base_failed and not got[2].kept and got[2].clean_text == ""


def test_ten_megabytes_of_failing_lines(spark):
    """Different lines that fail, and one line many times: work in proportion to the text but for sorting."""
    text = "\n".join(f"Home {i} | About {i} | Contact {i}" for i in range(250_000)) + "\nthe same line again." * 100_000
    out = Q.quality(spark.createDataFrame([row(1, text)], SCHEMA)).select("kept", "clean_text", "n_dup_lines").first()
    assert (out.kept, out.clean_text, out.n_dup_lines) == (False, "the same line again.\nthe same line again.", 99_999)
