"""PII: patterns find protected entities; corpus co-occurrence finds terms that reveal them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import carried, id_and_text, per_batch, per_row, stored
from rankfold.llm.words import Sketch

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only start where a run of digits starts, and runs are never given back, so each is linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile("[A-Za-z\x80-\U0010ffff]{2,}")
#: secrets by their public formats, or as the value that a telling name is given
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?P<value>[^\s\"',;]{8,}+)"
)
#: one of these stands in every secret, case apart
TELLING = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "aiza", "eyj", "private key", "passw", "secret", "token", "api")
_TERMS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
#: bits of the sketches of told terms and of copied texts
SKETCH = 1 << 24

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """As the pattern's leftmost matches: the local part is the run before an @ that no match has taken."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _byte(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    digits = lambda m: NOT_DIGIT.sub("", m[0])
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits(m)) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def secrets(text: str) -> list[Span]:
    """Keys, tokens and passwords; of a named value only the value. No two overlap."""
    folded = low(text)
    if not any(w in folded for w in TELLING):
        return []
    return [m.span("value") if m["value"] else m.span() for m in SECRET.finditer(text)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode())
    return h - (1 << 64) if h >> 63 else h


def low(text: str) -> str:
    return text.encode().lower().decode()


def tokens(text: str) -> set[bytes]:
    """The distinct terms of a text, those in entities too, and single letters."""
    return set(text.encode().translate(_TERMS).split())


def clear_terms(text: str, spans: list[Span]) -> Iterator[tuple[bytes, int, int]]:
    """(term, start, end): every term of a text that no entity overlaps."""
    taken = sorted(spans)
    at = past = 0
    for m in TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            past, at = max(past, taken[at][1]), at + 1
        if past <= m.start():
            yield m[0].encode().lower(), m.start(), m.end()


def terms_of(text: str, spans: list[Span]) -> set[bytes]:
    if spans:
        return {t for t, _, _ in clear_terms(text, spans)}
    return {t for t in tokens(text) if len(t) > 4 or len(t.decode()) > 1}


def _signed(term: bytes) -> int:
    h = xxhash.xxh64_intdigest(term)
    return h - (1 << 64) if h >> 63 else h


ROW = "n_email long, n_ip long, n_card long, n_phone long, base string, n_secret long, secrets string, ents array<long>, terms array<long>"


def entity_row(text: str | None) -> tuple:
    text = text or ""
    found = base_spans(text)
    flat, more = [(k, s, e) for k in KINDS for s, e in found[k]], [("secret", s, e) for s, e in secrets(text)]
    ents = sorted({_hash(f"{k}:{low(text[s:e])}") for k, s, e in flat + more})
    terms = sorted(map(_signed, terms_of(text, [(s, e) for _, s, e in flat + more]))) if ents else []
    return (*(len(found[k]) for k in KINDS), listed(flat), len(more), listed(more), ents, terms)


def _spans(text: str) -> list[Span]:
    return [x for spans in base_spans(text).values() for x in spans] + secrets(text)


def term_documents(keyed: DataFrame, most: int = 500_000) -> DataFrame:
    """(t, nt): in how many distinct texts each term stands outside entities; ``keyed`` has text and k, its hash.

    Counts are summed up in each task before the shuffle. Only texts with copies, told by a sketch of fixed size
    that may hold a few others, send their terms one by one, with k, so that copies count once.
    """
    copies = Sketch(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            t = [xxhash.xxh64_intdigest(x) for x, _ in counts]
            columns = [pa.array(t, pa.uint64()).view(pa.int64()), pa.array([k for _, k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["t", "k", "n"])

        for batch in batches:
            ks = batch.column(1).to_numpy()
            for text, k, copied in zip(batch.column(0), ks.tolist(), copies.may_hold(ks.view(np.uint64)).tolist()):
                text = text.as_py() or ""
                own = k if copied else None
                for t in terms_of(text, _spans(text)):
                    key = (t, own)
                    counts[key] = 1 if copied else counts.get(key, 0) + 1
                if len(counts) >= most:
                    yield out()
                    counts = {}
        if counts:
            yield out()

    found = keyed.select("text", "k").mapInArrow(run, "t long, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n"))
    return found.groupBy("t").agg(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(1)).alias("nt"))


def _occurrences(keyed: DataFrame, kind: str, told: DataFrame) -> DataFrame:
    """(doc_id, k, t, s, e): every occurrence of a told term outside entities, and of the few that share a bit of its hash.

    Tasks hold a sketch of the told terms of fixed size; what it lets through is joined with them.
    """
    sketch = Sketch(told.select("t"), SKETCH)

    def make() -> Callable[..., Iterator[tuple]]:
        table, mask = sketch.held.value, SKETCH - 1

        def told_maybe(t: bytes) -> bool:
            b = xxhash.xxh64_intdigest(t) & mask
            return bool(table[b >> 3] >> (b & 7) & 1)

        def run(ids: list, ks: list, texts: list) -> Iterator[tuple]:
            for doc_id, k, text in zip(ids, ks, texts):
                hits = {t for t in tokens(text or "") if told_maybe(t)}
                if hits:
                    yield from ((doc_id, k, _signed(t), s, e) for t, s, e in clear_terms(text, _spans(text)) if t in hits)

        return run

    return per_batch(keyed, f"doc_id {kind}, k long, t long, s int, e int", make)


def find_pii(docs: DataFrame, support: int = 2, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """One row for each row of ``docs``: doc_id, k (hash of the text), n_email, n_ip, n_card, n_phone, base, n_secret, secrets, terms.

    base lists the pattern spans as kind:start:end, secrets those of keys and passwords, terms those of the
    method, as generalise:... or remove:.... A protected entity c is the lower-cased text of a pattern span or a
    secret; a term t is two letters or more, outside all entities. Both are counted over distinct whole texts, as
    copies are no evidence: with D of them, PMI(c; t) = log2(D * docs(c, t) /
    (docs(c) * docs(t))) says how many of the IC(c) = log2(D / docs(c)) bits of the entity the term gives away.
    A term is told to be generalised from ``generalise`` * IC(c) on, and removed from ``remove`` * IC(c) on, for
    any entity that it stands together with in at least ``support`` texts; every occurrence of it is then
    treated, in all documents, the stronger way.

    As docs(c, t) is at most docs(c) and docs(t), only entities in ``support`` documents and terms in
    ``support`` to D ** (1 - generalise) * docs(c) ** generalise of them can pass; only those are paired.

    A null text is empty and has no spans; each row counts as a document, repeated rows and null ids too, and
    rows that repeat id and text get equal results. An empty table gives an empty table.
    """
    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text")

    def make() -> Callable[..., tuple]:
        return lambda doc_id, k, text: (doc_id, k, *entity_row(text))

    base = per_row(keyed, f"doc_id {kind}, k long, {ROW}", make).withColumn("row", F.monotonically_increasing_id())
    base = stored(base, "pii-entities")
    n_docs = float(max(base.select("k").distinct().count(), 1))
    own = base.filter(F.size("ents") > 0).dropDuplicates(["k"])
    held = own.select("row", F.explode("ents").alias("c"))
    entities = stored(held.groupBy(F.col("c").alias("ec")).agg(F.count("*").alias("nc")).filter((F.col("nc") >= support) & (F.col("nc") < n_docs)), "pii-shared")
    held = stored(held.join(entities, F.col("c") == F.col("ec")).select("row", "c", "nc"), "pii-held")
    room = lambda nc: n_docs ** (1 - generalise) * F.pow(nc.cast("double"), F.lit(generalise)) * 1.000001
    widest = held.groupBy(F.col("row").alias("wr")).agg(room(F.max("nc")).alias("room"))
    most = held.agg(room(F.max("nc")).alias("m")).first()["m"] or 0.0
    rare = stored(term_documents(keyed).filter((F.col("nt") >= support) & (F.col("nt") <= most)), "pii-rare-terms")
    terms = own.join(widest, F.col("row") == F.col("wr")).select(F.col("row").alias("tr"), "room", F.explode("terms").alias("x"))
    terms = terms.join(rare, F.col("x") == F.col("t")).filter(F.col("nt") <= F.col("room")).select("tr", "t", "nt")
    pairs = held.join(terms, (F.col("row") == F.col("tr")) & (F.col("nt") <= room(F.col("nc"))))
    pairs = pairs.groupBy("c", "t", "nc", "nt").agg(F.count("*").alias("nct")).filter(F.col("nct") >= support)
    ic = F.log2(F.lit(n_docs) / F.col("nc"))
    pmi = F.log2(F.col("nct") * F.lit(n_docs) / (F.col("nc").cast("double") * F.col("nt")))
    action = F.when(pmi >= remove * ic, "remove").when(pmi >= generalise * ic, "generalise")
    told = pairs.select(F.col("t").alias("told"), action.alias("action")).filter("action is not null").groupBy("told").agg(F.max("action").alias("action"))
    told = stored(told, "pii-told")
    occ = _occurrences(keyed, kind, told.withColumnRenamed("told", "t")).withColumn("rid", F.col("doc_id").cast("string"))
    spans = occ.join(told, F.col("t") == F.col("told")).groupBy("rid", "k", "s", "e").agg(F.max("action").alias("action"))
    spans = spans.groupBy("rid", "k").agg(F.array_sort(F.collect_list(F.struct("action", "s", "e"))).alias("spans"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x.action, x.s.cast("string"), x.e.cast("string"))), ",")
    spans = spans.select(F.col("rid").alias("srid"), F.col("k").alias("sk"), text.alias("terms"))
    out = base.drop("ents", "terms", "row").withColumn("rid", F.col("doc_id").cast("string"))
    out = out.join(spans, F.col("rid").eqNullSafe(F.col("srid")) & (F.col("k") == F.col("sk")), "left")
    return out.select("doc_id", "k", "n_email", "n_ip", "n_card", "n_phone", "base", "n_secret", "secrets", F.coalesce("terms", F.lit("")).alias("terms"))


def general(term: str) -> str:
    """What a term is generalised to: the kind of word that it is."""
    if term[:1].isupper():
        return "[ACRONYM]" if len(term) > 1 and term.isupper() else "[NAME]"
    return "[TERM]"


def masked(text: str, spans: str) -> str:
    """Pattern spans and secrets become [KIND], generalised terms [NAME], [ACRONYM] or [TERM], removed terms nothing; of spans that overlap the first stands."""
    parts = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, free = [], 0
    for s, e, k in parts:
        if s >= free:
            out += [text[free:s], "" if k == "remove" else general(text[s:e]) if k == "generalise" else f"[{k.upper()}]"]
        free = max(free, -e)
    return "".join((*out, text[free:]))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with text sanitised; every other column and row as it was."""
    own = carried(docs)
    found = find_pii(docs, **options).distinct()
    found = found.select(F.col("doc_id").alias("fid"), "k", F.concat_ws(",", *(F.when(F.col(c) != "", F.col(c)) for c in ("base", "secrets", "terms"))).alias("spans"))
    t = own.at("text")
    rows = own.df.withColumn("x", F.xxhash64(F.coalesce(t, F.lit(""))))
    rows = rows.join(found, F.col(own.at("doc_id")).eqNullSafe(F.col("fid")) & (F.col("x") == F.col("k")), "left").select(*own.df.columns, "spans")
    at = own.df.columns.index(t)

    def make() -> Callable[..., tuple]:
        def row(*v) -> tuple:
            new = masked(v[at], v[-1]) if v[at] and v[-1] else v[at]
            return (*v[:at], new, *v[at + 1 : -1])

        return row

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.df.schema)
    return own.back(per_row(rows, schema, make))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.concat_ws(",", *(F.when(F.col(c) != "", F.col(c)) for c in ("base", "secrets", "terms")))
    private = F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_secret")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), "n_secret", private.alias("n_private"))


SQL: dict[str, str] = {}
