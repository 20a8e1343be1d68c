import random

import numpy as np
import pyarrow as pa
import pytest

from rankfold.llm import substring_dedup as S
from rankfold.llm import words
from tests.llm.test_operators import SCHEMA, row


def blocks(text):
    """Paragraphs, line by line: (first word, words)."""
    lines = [x.split() for x in (text or "").encode().lower().split(b"\n")]
    full = [i for i, x in enumerate(lines) if x]
    blank = bool(full) and not all(lines[full[0] : full[-1]])
    out, at, prev = [], 0, None
    for i, words in enumerate(lines):
        if words and blank and prev:
            out[-1][1].extend(words)
        elif words:
            out.append((at, list(words)))
        at, prev = at + len(words), words
    return out


def brute(rows):
    """All pairs of paragraphs; then the runs of repeated ones."""
    items = []
    for i, t in rows:
        items += [(i, at, a, w, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))) for at, (a, w) in enumerate(blocks(t)) if len(w) >= 5]
    root = list(range(len(items)))
    for a in range(len(items)):
        for b in range(a):
            x, y = items[a][4], items[b][4]
            if root[a] != root[b] and (items[a][3] == items[b][3] or len(x & y) / len(x | y) >= 0.8):
                m, n = sorted((root[a], root[b]))
                root = [m if r == n else r for r in root]
    size, first = {}, {}
    for r, (i, at, *_) in zip(root, items):
        size[r] = size.get(r, 0) + 1
        first[r] = min(first.get(r, (1 << 60, 0)), (i, at))
    out = []
    for i in {x[0] for x in items}:
        own = [(x, r) for x, r in zip(items, root) if x[0] == i and size[r] > 1]
        run = S.lengths([(x[2], x[2] + len(x[3])) for x, _ in own])
        out += [(i, x[1], x[2], len(x[3]), first[r][0], n, first[r] != (i, x[1]) and n >= 15) for (x, r), n in zip(own, run)]
    return sorted(out)


def texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    base = [some(60) for _ in range(6)]
    rows = [(900, None), (901, ""), (902, "short line"), (903, "same " * 3000), (904, "SAME\n" * 3000), (905, "a b c d e\n" * 4 + " \n")]
    for i in range(60):
        copy = list(base[i % 6])
        if i % 3:
            copy[rng.randrange(60)] = "changed"
        sep, mid = ("\n", " ") if i % 5 else ("\n \t\n", "\n")
        rows.append((i, sep.join((" ".join(some(rng.randrange(30))), " ".join(copy[:20]) + mid + " ".join(copy[20:]).title(), "\t".join(some(30)), " ".join(base[0][:7])))))
    rows += [(700 + i, " ".join(some(200))) for i in range(20)]
    return rows


def test_substring_dedup_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.at, r.start, r.words, r.keep_doc, r.run, r.removed) for r in S.substring_dedup(docs).collect())
    assert got == brute(rows)
    removed = {x[0] for x in got if x[-1]}
    assert set(range(6, 60, 3)) <= removed and len(removed) > 18  # an edit parts a line of 20 words from its like
    assert not removed & set(range(700, 720))
    chunked = sorted((r.doc_id, r.at, r.start, r.words, r.keep_doc, r.run, r.removed) for r in S.substring_dedup(docs, most=2).collect())
    assert chunked == got
    listed, S.LISTED = S.LISTED, 1
    try:
        assert sorted((r.doc_id, r.at, r.start, r.words, r.keep_doc, r.run, r.removed) for r in S.substring_dedup(docs, most=3).collect()) == got
    finally:
        S.LISTED = listed
    assert S.substring_dedup(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"x{i}" for i in range(80))
    docs = spark.createDataFrame([row(i, t) for i, t in [(1, text), (1, text), (None, text), (None, "other line\n" + text)]], SCHEMA)
    out = S.substring_dedup(docs).collect()
    assert {(r.doc_id, r.removed) for r in out} == {(1, False), (None, True)}
    assert {r.keep_doc for r in out} == {1}


def test_words_and_paragraphs_of_a_column_equal_those_of_its_texts():
    rng = random.Random(1)
    some = lambda: "".join(rng.choice(["a", "B", "ab", "é", "\n", "\n\n", " ", "\t", "x y", " \n "]) for _ in range(rng.randrange(25)))
    for _ in range(500):
        column = [rng.choice([None, "", some(), some()]) for _ in range(rng.randrange(1, 6))]
        got = words.Words(pa.array(["left out", *column], pa.string()).slice(1))
        flat = [w for t in column for w in (t or "").encode().lower().split()]
        assert np.diff(got.first).tolist() == [len((t or "").encode().split()) for t in column]
        assert len(set(zip(flat, got.hashes.tolist()))) == len(set(flat)) == len(set(got.hashes.tolist()))
        want = [(k, at, int(got.first[k]) + a, int(got.first[k]) + a + len(w)) for k, t in enumerate(column) for at, (a, w) in enumerate(blocks(t))]
        assert list(zip(*(x.tolist() for x in got.paragraphs()))) == want


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000)) + " " + "long" * 500
    whole = words.Words(pa.array([text])).hashes
    monkeypatch.setattr(words, "CHUNK", 64)
    assert (words.Words(pa.array([text])).hashes == whole).all() and len(set(whole.tolist())) == 98


def test_a_sketch_holds_all_that_was_put_in(spark):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 500).tolist()
    sketch = words.Sketch(spark.createDataFrame([(v,) for v in values], "h long"), 1 << 16)
    assert sketch.may_hold(np.array(values).view(np.uint64)).all()
    assert sketch.may_hold(np.random.default_rng(2).integers(0, 1 << 62, 10000).astype(np.uint64)).mean() < 0.02


@pytest.mark.parametrize("percent, least", [(1, 0.95), (2, 0.94), (3, 0.9), (5, 0.75)])
def test_recall_of_edited_passages(spark, percent, least):
    """Passages of 100 words amid others, some of whose words are changed in the copy: the share of their words that the query takes."""
    rng, rows = random.Random(percent), []
    some = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    for i in range(80):
        passage = some(100)
        edited = [w if rng.random() * 100 >= percent else "edited" + w for w in passage]
        rows += [(2 * i + k, " ".join(some(20) + p + some(25))) for k, p in enumerate((passage, edited))]
    got = {r.doc_id: r.spans for r in S.removals(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA), S.QUERY_WORDS).collect()}
    gone = [(a, b) for i in range(80) for a, b in (map(int, x.split("-")) for x in filter(None, got.get(2 * i + 1, "").split(",")))]
    assert sum(b - a for a, b in gone) / 8000 >= least and all(20 <= a and b <= 120 for a, b in gone)
    assert all(got.get(2 * i, "") == "" for i in range(80))


def test_bridges_only_where_both_sides_follow_one_other_text(spark):
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(50000)}" for _ in range(n)]
    a, b, c = some(20), some(20), some(9)
    texts = [
        [*a, *c, *b],  # 1: the first text
        [*some(5), *a, *some(7), *b],  # 2: an edit of seven words, and two words fewer
        [*a, *some(31), *b],  # 3: too much between
        [*b, *some(9), *a],  # 4: the other way round
        [w for k in range(8) for w in [f"r{k}"] * 40],  # 5: words that repeat, no copy
        [*some(9), *a, *some(60)],  # 6: a stock phrase
    ]
    docs = spark.createDataFrame([row(i + 1, " ".join(w)) for i, w in enumerate(texts)], SCHEMA)
    got = {r.doc_id: [tuple(x) for x in r.bridges] for r in S.passages(docs).collect()}
    assert got.pop(2) == [(25, 32)] and not any(got.values())
    gone = {r.doc_id: r.spans for r in S.removals(docs, S.QUERY_WORDS).collect() if r.spans}
    assert gone == {2: "5-52"}
    assert {r.doc_id for r in S.removals(docs).collect() if r.k} == {2, 3, 4, 5, 6}


def test_bridges_of_columns():
    """Nulls and empty lists among rows, and one line whose distances differ by more than an edit."""
    span, line = lambda a, b: a * 2**32 + b, lambda name, far: name * 2**32 + far % 2**32
    spans = pa.array([[span(40, 60), span(0, 20)], [], [span(5, 25), span(30, 50)], [span(5, 25), span(30, 50)], [span(5, 25), span(30, 50)]], pa.list_(pa.int64()))
    lines = pa.array([[line(-7, -3), line(-7, 2)], [], [line(7, 0), line(8, 0)], [line(7, 0), line(7, 31)], [line(7, -40), line(7, -40)]], pa.list_(pa.int64()))
    got = S._bridges(spans, lines).to_pylist()
    assert [[(x["start"], x["stop"]) for x in r] for r in got] == [[(20, 40)], [], [], [], [(25, 30)]]
    assert S._bridges(spans[:0], lines[:0]).to_pylist() == []


def brute_passages(rows):
    """Every gram against the first place of its like, word by word."""
    first, out = {}, {}
    texts = sorted({(i is None, i or 0, S.xxhash.xxh64_intdigest(t) - (1 << 63), t, i) for i, t in rows if t})
    for last, i, rid, t, own in texts:
        w, gone = t.encode().lower().split(), set()
        for a in range(len(w) - 14):
            at = first.setdefault(tuple(w[a : a + 15]), (last, i, rid, a))
            if at != (last, i, rid, a):
                gone |= set(range(max(a, at[3] + 15) if at[:3] == (last, i, rid) else a, a + 15))
        if gone:
            out[own, rid] = gone
    return out


def test_exact_passages_equal_brute_force(spark):
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    base, rows = [some(n) for n in (14, 15, 16, 20, 25, 40)], texts()
    rows += [(2000 + i, " ".join([*some(rng.randrange(40)), *base[i % 6], *base[(i * 7 + 1) % 6], *some(rng.randrange(40))])) for i in range(60)]
    rows += [(3000 + p, " ".join((some(p) * 60)[: 22 + 3 * p])) for p in range(1, 18)] + [rows[-1], (None, rows[-2][1])]
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(4)
    got = {(r.doc_id, r.rid): {k for a, b in r.spans for k in range(a, b)} for r in S.exact_passages(docs).collect()}
    assert got == brute_passages(rows)
    assert S.exact_passages(docs.limit(0)).count() == 0


def test_short_lines_and_edited_lines_are_removed_whole(spark):
    """Of lines of 15 to 50 words that repeat amid others, every word goes; lines with one word edited go as near copies."""
    rng, rows, want = random.Random(9), [], {}
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for n in (15, 20, 25, 30, 50):
        for sep in ("\n", " "):
            line, i = some(n), len(rows)
            rows += [(i + k, sep.join(map(" ".join, (some(40), line, some(40))))) for k in range(2)]
            want[i + 1] = f"40-{40 + n}"
    line = some(60)
    for at in (0, 30, 59):
        rows.append((len(rows), "\n".join(map(" ".join, (some(40), line, some(40))))))
        line = [*line[:at], "edited", *line[at + 1 :]]
    got = {r.doc_id: r.spans for r in S.removals(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)).collect()}
    assert {i: got.get(i) for i in want} == want
    for i in (21, 22):  # a near paragraph may reach a word beyond the line
        a, b = map(int, got[i].split("-"))
        assert a <= 40 and 100 <= b <= 105


def test_repeated_hashes_equal_a_count(spark, monkeypatch):
    """Hashes in many rows and buckets, one of them in every row, dealt out a few at a time."""
    rng = random.Random(3)
    values = [[7, *(rng.randrange(-(1 << 63), 1 << 63) >> rng.choice((0, 54)) for _ in range(rng.randrange(20)))] for _ in range(200)]
    monkeypatch.setattr(S, "DEALT", 16)
    rows = spark.createDataFrame([(v,) for v in values], "v array<long>").repartition(5)
    got = [r.h for r in S.repeated_hashes(rows, lambda piece: np.asarray(piece.column(0).flatten()).view(np.uint64)).collect()]
    flat = [v for vs in values for v in vs]
    assert sorted(got) == sorted(v for v in set(flat) if flat.count(v) > 1) and len(got) > 50
    assert S.repeated_hashes(rows.limit(0), lambda piece: np.zeros(0, np.uint64)).count() == 0


def test_copies_are_not_looked_up_gram_by_gram(spark, monkeypatch):
    """What only whole copies share has one kind of run for each seed: no gram of it is dealt out."""
    made, real = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: made.setdefault(name, []).append(out := real(df, name)) or out)
    monkeypatch.setattr(S, "dropped", lambda df: None)
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    docs = spark.createDataFrame([row(i, text) for i in range(6)], SCHEMA)
    assert {(r.doc_id, tuple(map(tuple, r.spans)), tuple(r.keeps)) for r in S.exact_passages(docs).collect()} == {(i, ((0, 300),), (0,)) for i in range(1, 6)}
    assert made["gram-firsts"][0].count() == 0 and made["known-runs"][0].count() > 20


def test_runs_are_short_where_shingles_overlap_their_like():
    rng = random.Random(1)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [" ".join([*some(20), *(some(d) * 14)[: 8 + d], *some(20)]) for d in (1, 3, 5, 7, 8) for _ in range(40)]
    first, sizes, seeds, hashes = S.grams(words.Words(pa.array(texts)))
    assert len(first) == len(sizes) == len(seeds) and sizes.sum() == len(hashes) and sizes.max() == S.SEED


def test_texts_go_on_from_batch_to_batch():
    """Runs of a few texts in batches of any size give the rows that one batch gives."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(4), rng.randrange(3), *(rng.randrange(n) for n in (60, 255, 3, 60))) for _ in range(150))
    rows = [(*r[:5], max(0, r[2] - r[5] % 4) if r[4] == r[1] else r[5]) for r in rows]  # first ones of a text's own stand before
    columns = {
        "doc_id": pa.array([n for _, n, *_ in rows]), "rid": pa.array([r for r, *_ in rows], pa.int64()), "name": pa.array([n for _, n, *_ in rows]),
        "start": pa.array([r[2] for r in rows], pa.int32()), "mask": pa.array([r[3] + 1 + (S.OWN if r[4] == r[1] else 0) for r in rows], pa.int32()),
        "fdoc": pa.array([r[4] or None for r in rows], pa.int64()), "fid": pa.array([r[4] for r in rows]), "fname": pa.array([r[4] for r in rows]), "fstart": pa.array([r[5] for r in rows], pa.int32()),
    }
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    told = lambda batches: [r for b in S._of_texts(iter(batches)) for r in b.to_pylist()]
    want = told([whole])
    assert len(want) == 12 and any(r["spans"] for r in want) and any(r["keeps"] for r in want) and any(r["kept"] for r in want)
    for size in (1, 2, 5, 13, 60):
        assert told([whole.slice(k, size) for k in range(0, 150, size)] + [whole.slice(0, 0)]) == want
    assert told([]) == [] == told([whole.slice(0, 0)])
