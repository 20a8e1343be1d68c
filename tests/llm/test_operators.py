"""Each operator against brute force on a table of edge cases, and on an empty one."""

import hashlib
import os
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from rankfold.llm import bpe, common, exact_dedup, licenses, line_dedup, mixing, pii, quality, simhash, toxicity
from rankfold.llm.components import components
from rankfold.llm.queries import SQL

low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word another third. " * 4000
TEXTS = [
    None, "", " \t\n", "One two three four five six seven eight nine ten eleven.", "ONE two three four five six seven eight nine ten eleven.", "É À Straße ÄÖ İK",
    "Shared line\nown 1\n\n shared LINE \x0b", "shared line", "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License, version 3.", LONG,
    "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (555) 010-9999 x", "Home | About | Contact\n" + "### *** $$$ " * 6, "ü" * 5000, "\x1c\x85 a\r\nb", "cc by cc by nc sa",
]
#: extra columns whose names clash with the operators' own
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` int, h1 int, size string, kept string, rid int, k int, spans int, c0 int, score string"


def row(i, t, source="s"):
    return (i, t, "en", source, len(t or ""), 1, 2, "x", "y", 3, 4, 5, 6, "z")


ROWS = [row(i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(TEXTS)] + [row(100 + i, f"shared line\nn {i}") for i in range(12)]
ROWS += [row(100, "shared line\nn 0"), row(None, "no id"), row(None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return sorted(((tuple(r)) for r in df.select(*columns).collect()), key=repr)


def test_small_tables_against_sql(same):
    from rankfold.llm.queries import QUERIES

    for name, sql in SQL.items():
        same(QUERIES[name], sql)


def test_line_dedup(docs, empty):
    keys = [[x.strip(" \t\n\x0b\x0c\r") for x in low(r[1]).split("\n")] for r in ROWS]
    often = {k for ks in keys for k in set(ks) if k and sum(k in set(o) for o in keys) >= 10}
    want = []
    for r, ks in zip(ROWS, keys):
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if k not in often]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.line_dedup(docs, batches=3)
    assert often == {"shared line"} and bag(out, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=repr)
    assert set(docs.columns) < set(out.columns) and line_dedup.line_dedup(empty).count() == 0


def test_line_runs_count_over_batches(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3)
    for _ in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "h1 long, h2 long, n long"))
    runs.add(spark.createDataFrame([(3, 3, 2)], "h1 long, h2 long, n long"))
    assert bag(runs.frequent(), "h1") == [(1,), (2,)] and len(runs.levels) >= 2 and all(len(x) < 2 for x in runs.levels)


@pytest.mark.parametrize("keep, pick", [("largest", max), ("smallest", min)])
def test_exact_dedup(docs, empty, keep, pick):
    groups = {}
    for r in ROWS:
        groups.setdefault(low(r[1]), []).append(r[0])
    best = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = [(r[0], best[t], len(groups[t]), r[0] == best[t], sha(t)) for r in ROWS for t in [low(r[1])]]
    assert bag(exact_dedup.exact_dedup(docs, keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty, keep).count() == 0


def test_license_scan(docs, empty):
    got = {}
    for r in licenses.license_scan(docs).collect():
        base = [(d.start, d.label) for d in r.detections if d.priority == 0]
        got.setdefault(r.doc_id, []).append((r.n_words, base))
        assert 0 <= r.score <= 1 and all(d.kept for d in r.detections if d.priority == 0)
        kept = [d for d in r.detections if d.kept and d.priority]
        assert not any(a is not b and a.start <= b.start and b.end <= a.end and a.priority <= b.priority and (a.start, a.end) != (b.start, b.end) for a in kept for b in kept)
    for r in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r[1]))
        base = sorted((i, v) for p, v in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (len(w), base) in [(n, sorted(b)) for n, b in got[r[0]]]
    text = next(r for r in licenses.license_scan(docs.filter("doc_id = 8")).collect())
    assert {d.label for d in text.detections if d.kept} == {"cc-by", "cc-by-nc", "reserved", "gpl"}
    assert licenses.license_scan(empty).count() == 0 and len(licenses.rules()) > 200


def repeated(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    return len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)})


def test_quality(docs, empty):
    want = []
    for r in ROWS:
        t = r[1] or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        n = repeated(w)
        failed = len(w) < 10 or 100 * n > 20 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), n, failed))
    out = quality.quality(docs)
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert {r.doc_id: r.clean_text for r in out.filter("doc_id in (3, 11)").collect()} == {3: TEXTS[3], 11: ""}
    assert not out.filter("kept and base_failed").count() and quality.quality(empty).count() == 0


def brute_fingerprint(t):
    w = WORDS.findall(low(t))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_sparks_hash(spark):
    assert [simhash.fingerprint(t) for t in TEXTS] == [brute_fingerprint(t) for t in TEXTS]
    got = spark.createDataFrame([(t,) for t in TEXTS if t], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h % (1 << 64) == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in got)


def brute_components(fps, most):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


@pytest.mark.parametrize("hot", [200_000, 10])
def test_trie_join_finds_the_components_of_all_pairs(spark, hot):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in (0, 1, 2, 3, 4, 5, 6)} | {0, 15, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.near(spark, spark.createDataFrame([(f,) for f in signed], "fp long"), 4, hot=hot)
    found = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(fps, 4)
    mine = [found.get(f, f) for f in signed]
    pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]}
    assert pairs(mine) == pairs(want)


def test_simhash_dedup(spark, docs, empty):
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    root = brute_components(fps, 4)
    least = {c: min((r[0] for r, x in zip(ROWS, root) if x == c and r[0] is not None), default=None) for c in root}
    classes = simhash.classes(spark, simhash.fingerprints(docs), 4)
    assert bag(classes, "doc_id", "component_id") == sorted(((r[0], least[c]) for r, c in zip(ROWS, root)), key=repr)
    out = simhash.simhash_dedup(docs)
    assert out.columns == docs.columns and sorted({r.doc_id for r in out.collect()} - {None}) == sorted(x for x in set(least.values()) if x is not None)
    assert simhash.simhash_dedup(empty).count() == 0 and simhash.classes(spark, simhash.fingerprints(empty), 4).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs, parts=5).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    total = sum(len(WORDS.findall(r[1] or "")) for r in ROWS)
    assert len(out) == len(ROWS) and sum(r[0].target for r in by.values()) == pytest.approx(min(total, 3 * total))
    for rows in by.values():
        assert sum(r.size for r in rows) == rows[0].source_size and rows[0].target <= 3 * rows[0].source_size
        assert abs(sum(r.copies * r.size for r in rows) - rows[0].target) <= 2 * max(r.size for r in rows) and all(0 <= r.copies <= 3 for r in rows)
    again = mixing.mix_sources(docs.repartition(7), parts=3).collect()
    key = lambda r: repr((r.doc_id, r.text, r.source, r.copies))
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)


def test_mixing_takes_every_repeated_row_by_itself(spark, tmp_path):
    import duckdb

    ten = "one two three four five six seven eight nine ten"
    rows = [(None, ten, "a")] * 500 + [(7, ten, "b")] * 90 + [(i, "w " * (i % 9), "b") for i in range(40)] + [(None, None, None), (None, "x y", None)] * 20 + [(i, "z " * 3000, "c") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.mix_sources(docs, keep=["doc_id", "source"]).collect()
    for name in ("a", "b", "c", None):
        own = [r for r in out if r.source == name]
        assert len(own) == sum(r[2] == name for r in rows)
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= max(r.size for r in own)
    got = mixing.op8_mixing(spark, str(tmp_path)).collect()
    sql = duckdb.sql(mixing.SQL["op8_mixing"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    plain = lambda rows: sorted((tuple(None if v is None else round(float(v), 6) for v in r) for r in rows), key=repr)
    assert plain(got) == plain(sql)


def test_targets_share_the_excess_again(spark):
    sizes = {"a": 10, "b": 500, "c": 490, "d": 0, None: 100}
    left, total, targets = dict(sizes), sum(sizes.values()), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(["a", "b", "c", "d", None])}
    while left:
        share = {s: (total - sum(targets.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] >= 3 * sizes[s]]
        targets |= {s: 3 * sizes[s] for s in over} if over else share
        left = {s: v for s, v in left.items() if s in over or over} if over else {}
        left = {s: v for s, v in left.items() if s not in over}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(targets)


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_equals_tiktoken_and_goes_back(docs, empty, vocabulary):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(vocabulary), special_tokens={})
    out = bpe.bpe_encode(docs, vocabulary, public_tokenizers.PATTERN)
    want = []
    for r in ROWS:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), sha(r[1] or "")))
    assert bag(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bag(bpe.bpe_decode(out, vocabulary, public_tokenizers.PATTERN), "doc_id", "text") == sorted(((r[0], r[1] or "") for r in ROWS), key=repr)
    assert bpe.bpe_encode(empty, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_of_any_length(vocabulary):
    import random

    ranks = bpe.load_ranks(vocabulary)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(1)
    texts = ["".join(rng.choice("ab  \n\tÀé中😀'sтllre12!?　\x85\x1c") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["ab" * 3000, " " * 999, "the" * 11]
    assert [list(memoryview(x).cast("I")) for x in codec.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
    assert [codec.one.encode(t.encode()) for t in ("thth" * 7, "hello")] == [library.encode_ordinary(t) for t in ("thth" * 7, "hello")]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    def ok(k, m):
        d = re.sub("[^0-9]", "", m[0])
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]

    return {k: [m.span() for m in re.finditer(p, t) if ok(k, m)] for k, p in PATTERNS.items()}


def test_pii(docs, empty):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.@-+ ()0123456789\né55") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts + [t or "" for t in TEXTS])
    found = pii.find_pii(docs)
    want = [(r[0], *map(len, s.values()), pii.listed([(k, a, b) for k in pii.KINDS for a, b in s[k]])) for r in ROWS for s in [brute_spans(r[1] or "")]]
    assert bag(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base") == sorted(want, key=repr)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) and "[EMAIL]" in clean.filter("doc_id = 10").first().text
    assert pii.find_pii(empty).count() == 0 and pii.sanitise(empty).count() == 0
    assert pii.masked("Kim LTD said so", "generalise:0:3,generalise:4:7,generalise:8:12,remove:13:15") == "[NAME] [ACRONYM] [TERM] "


def test_secrets():
    key = "AKIA" + "ABCD1234" * 2
    texts = {f"use {key} now": [key], "password=hunter22, then": ["hunter22"], 'my token: "0123456789abcdef" x': ["0123456789abcdef"], "a secret plan": [], "X" + key: [], "token=short": [], "": []}
    assert {t: [t[a:b] for a, b in pii.secrets(t)] for t in texts} == texts
    assert len(pii.secrets(f"api_key = {'k' * 40}; " * 50_000)) == 50_000


def test_terms_that_reveal_an_entity_are_found(spark):
    rows = [(i, f"Zoltan writes a@b.co here {i}") for i in range(3)] + [(5, "copied with c@d.co"), (6, "copied with c@d.co")] + [(10 + i, f"the {w} writes here") for i, w in enumerate(["x", "y", "z"] * 10)]
    got = {r.doc_id: r.terms for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "remove:0:6" and got[10] == "" and got[5] == "" and pii.masked(rows[0][1], "email:14:20,remove:0:6") == " writes [EMAIL] here 0"


def test_toxicity_held_out(spark, sf_dir):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(words) for _ in range(30)] + ["people"] * group + ["trash"] * insult
        rng.shuffle(text)
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(group and insult)))  # toxic only together
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, machine).collect()}
    held = [i for i in range(1500) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    right = [out[i].predicted == labels[i][2] for i in held]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in out.values())


def test_a_pair_whose_terms_tell_nothing_alone(spark):
    """Either word stands in half of the toxic and half of the clean documents; both together in toxic ones alone."""
    import random

    rng, rows, labels = random.Random(7), [], []
    for i in range(1200):
        toxic, first = i % 4 == 0 or i % 4 == 1, i % 4 in (0, 2)
        own = (["aaa", "bbb"] if first else []) if toxic else (["aaa"] if first else ["bbb"])
        rows.append((i, " ".join(own + [f"w{rng.randrange(400)}" for _ in range(12)])))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    at = {t: int(np.flatnonzero(machine.columns == h)[0]) for t in ("aaa", "bbb") for h in toxicity.hashed_terms(t)}
    assert abs(machine.w[list(at.values())]).max() < 0.2 and machine.v[at["aaa"]] @ machine.v[at["bbb"]] > 1
    z = lambda *ws: machine.score({h for w in ws for h in toxicity.hashed_terms(w)})
    assert z("aaa", "bbb") > max(z("aaa"), z("bbb"))
    held = [(i, t) for i, t in rows if i % 4 in (0, 2, 3) and not __import__("zlib").crc32(str(i).encode()) % 5]
    scores = [machine.score(toxicity.hashed_terms(t)) for _, t in held]
    pos, neg = [s for (i, _), s in zip(held, scores) if i % 4 == 0], [s for (i, _), s in zip(held, scores) if i % 4]
    assert np.mean([p > q for p in pos for q in neg]) > 0.9


def test_the_machine_scores_as_its_definition():
    rng = np.random.default_rng(3)
    m = toxicity.FactorizationMachine(np.array([2, 5, 9, 11], np.int32), 0.3, rng.normal(size=4), rng.normal(size=(4, 3)))
    for own in ({2, 5, 11}, {9}, {1, 3}, set(), {2, 5, 9, 11, 40}):
        at = [k for k, c in enumerate(m.columns.tolist()) if c in own]
        z = m.w0 + sum(m.w[k] for k in at) + sum(m.v[a] @ m.v[b] for i, a in enumerate(at) for b in at[i + 1 :])
        assert abs(m.score(own) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(15)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    assert out.count() == len(ROWS) and not out.filter("score is null or predicted not in (0, 1)").count()
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 0.01


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 0 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ascii_lower_leaves_other_letters(spark):
    t = "ABC ÀÉ İ ß Z"
    assert spark.createDataFrame([(t,)], "t string").select(common.ascii_lower(F.col("t"))).first()[0] == low(t)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == p.COLUMNS and docs.count()
        if name != "mixing":
            assert docs.count() <= before.count() and docs.count() == docs.select("doc_id").distinct().count()
    assert p.run(spark, sf_dir).count() == docs.count() and os.path.exists(common.shared_dir(spark))


def test_components_of_a_star_and_a_path(spark):
    """One component of 200,000 nodes about a hub, one path, and edges with null ends, which are left out."""
    hub = spark.range(1, 200_000).select(F.lit(7_000_000).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.range(300_000, 300_100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    none = spark.createDataFrame([(None, 1), (5, None), (None, None)], "a long, b long")
    got = components(hub.unionAll(path).unionAll(none)).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, 200_000), (300_000, 101)]
