"""Pipeline stages on nulls, repeated rows, empty tables, extra columns, and tables that a stage empties; operators on texts of megabytes."""

import hashlib

import pytest

from rankfold.llm import licenses, line_dedup, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, fp string, rid int"


def row(i, t, source="s", lang="en"):
    return (i, t, lang, source, len(t or ""), "x", "y", "z", "w", 3)


ROWS = [row(0, None), row(1, ""), row(2, "alpha beta gamma delta " * 30, None), row(3, "alpha beta gamma delta " * 30, "t", None), row(None, "one two three\nfour"), row(5, "ü \x0b\n\n ß")]
ROWS += [row(i, f"shared line\nown words {i} and {i * 7} more") for i in range(10, 24)] + [row(10, "shared line\nown words 10 and 70 more"), (30, "no other columns", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as p

    folder = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, 1, int(i in (12, 15))) for i in range(10, 24)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return p, folder


def run(spark, stages, name, docs):
    p, folder = stages
    out = dict(p.STAGES)[name](spark, docs, folder)
    assert name == p.STAGES[-1][0] or out.columns == p.COLUMNS
    return out.collect()


def test_every_stage_takes_an_empty_table(spark, stages):
    for name, _ in stages[0].STAGES:
        assert run(spark, stages, name, spark.createDataFrame([], SCHEMA)) == []


def test_toxicity_keeps_rows_as_they_are(spark, stages, docs):
    out = run(spark, stages, "toxicity", docs)
    assert {tuple(r) for r in out} <= {r[:5] for r in ROWS}
    assert len(out) >= len(ROWS) - 3  # two rows are labelled toxic, and at most their likes go


def test_line_dedup_keeps_every_row(spark, stages, docs):
    out = run(spark, stages, "line_dedup", docs)
    assert len(out) == len(ROWS)
    texts = sorted((r.doc_id, r.text) for r in out if r.doc_id is not None and 10 <= r.doc_id < 30)
    assert texts == sorted((r[0], r[1].split("\n")[1]) for r in ROWS if r[0] is not None and 10 <= r[0] < 30)
    assert all(r.n_chars == len(r.text) for r in out)


def test_simhash_keeps_one_of_each_group(spark, stages, docs):
    out = run(spark, stages, "simhash", docs)
    ids = [r.doc_id for r in out]
    assert 2 in ids and 3 not in ids and 0 in ids and 1 not in ids
    assert {tuple(r) for r in out} <= {r[:5] for r in ROWS}


def test_mixing_takes_only_given_rows(spark, stages, docs):
    out = run(spark, stages, "mixing", docs)
    assert out and {tuple(r) for r in out} <= {r[:5] for r in ROWS}
    assert sorted(map(str, out)) == sorted(map(str, run(spark, stages, "mixing", docs.repartition(2))))


def test_encoding_gives_every_row_back(spark, stages, docs):
    out = run(spark, stages, "bpe", docs)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == sorted((str(r[0]), sha(r[1])) for r in ROWS)


MEGA = ("Plain words stand here in a line of their own, as they do.\nshared line\n" * 60_000) + "Licensed under CC BY 4.0. All rights reserved.\nmail a@b.co from 1.2.3.4\n"


def test_texts_of_megabytes(spark, tmp_path):
    assert len(MEGA) > 4_000_000
    docs = spark.createDataFrame([(1, MEGA), *((i, "shared line\nrest") for i in range(2, 12))], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = lambda op: op(spark, str(tmp_path)).filter("doc_id = 1").first()
    lines, words = MEGA.split("\n"), MEGA.split()
    kept = "\n".join(x for x in lines if x != "shared line")
    got = first(line_dedup.op1_line_dedup)
    assert (got.n_lines, got.n_dropped, got.kept_sha256) == (len(lines), 60_000, hashlib.sha256(kept.encode()).hexdigest())
    got = first(quality.op3_quality)
    assert (got.n_words, got.word_chars, got.n_symbols, got.base_failed) == (len(words), sum(map(len, words)), 0, True)
    assert got.n_dup_lines == 2 * 60_000 - 2 and got.n_repeat_words >= 60_000 * 14 - 10
    got = first(licenses.op2_license_scan)
    assert (got.n_base, got.base_labels, got.last_word - got.first_word) == (2, "cc-by,reserved", 4)
    got = first(pii.op10_pii)
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 0, 0)
