"""The prefix trie against a plain one, on rows of every odd kind and with blocks of three turns."""

import hashlib
import random
import re
import zlib

import pytest

from rankfold.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv int, digest int, n int, words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, every=20, borrow=4):
    """Tries as dictionaries by whole sequences of turns."""
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            name = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, name, role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    new = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % borrow
        base = c - int(c / every) * every
        new[c] = tuple(turns.get(c - base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in new.items():
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {k: [s for s in members if len(s) == len(k) + 1 and s[:-1] == k] for k in members}
    out = []
    for k in members:
        below = [s for s in members if s[: len(k)] == k]
        saved = sum((len(members[s]) - 1) * len(WORDS.findall(s[-1][1])) for s in below if s)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), sum(not kids[s] for s in below), saved, sha))
    return sorted(out)


def odd_rows():
    rng = random.Random(7)
    rows, extra = [], ("x", 1, 2, 3, "y")
    texts = ["", None, "one", "two words", "three\twords here", " \x0b", "ünï códe 漢字"]
    for c in [*range(0, 45), 60, 61, 79, 101, 119, -3, -20, -41, 1 << 40]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts), *extra))
    for c in range(200, 215):  # equal conversations, longer than several blocks
        rows += [(c, t, "user", f"turn {t // 2}", *extra) for t in range(17)]
    rows += rows[:9] + [(None, 0, "user", "nobody's", *extra), (None, None, None, None, *extra)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = odd_rows()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == sorted(plain(rows), key=lambda r: (r[0], r[1]))


def test_one_conversation_of_many_turns_and_a_long_text(spark):
    rows = [(7, t, "user", "w " * (200_000 if t == 3 else 1), "x", 1, 2, 3, "y") for t in range(3000)]
    rows += [(8, t, "user", "w ", "x", 1, 2, 3, "y") for t in range(2)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = {c: sum(1 for k in got if k[0] == c) for c in (7, 8)}
    h7, h8 = (zlib.crc32(str(c).encode()) % 4 for c in (7, 8))
    shared = max(0, min(3000 - h7, 2 - h8))
    assert n[7] == 3001 - h7 and n[8] == max(0, 2 - h8) - shared
    assert got[7, 0].parent_conv_id is None and got[7, 3000 - h7].n_children == 0 and all(got[7, d].n_children >= 1 for d in range(3000 - h7))


def test_a_node_with_more_ends_than_an_arrow_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(c, 0, "user", "same", "x", 1, 2, 3, "y") for c in range(100)] + [(c, 1, "user", "more", "x", 1, 2, 3, "y") for c in range(0, 100, 3)]
        got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == plain(rows)


def test_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_sql(same):
    same(prefix_trie.op11_prefix_trie, prefix_trie.SQL["op11_prefix_trie"])
