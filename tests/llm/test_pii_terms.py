import math
import random

from rankfold.llm import pii


def brute(rows):
    """Over distinct texts; their copies get the same."""
    texts = list(dict.fromkeys(t for _, t in rows))
    got = dict(zip(texts, brute_distinct([(t, t) for t in texts]).values()))
    return {i: got[t] for i, t in rows}


def brute_distinct(rows):
    held, terms = [], []
    for _, t in rows:
        spans = [(k, s, e) for k, x in pii.base_spans(t).items() for s, e in x]
        held.append({(k, t[s:e].lower()) for k, s, e in spans})
        terms.append([(m[0].lower(), m.start(), m.end()) for m in pii.TERM.finditer(t) if all(m.end() <= s or m.start() >= e for _, s, e in spans)])
    sets, n, action = [{x[0] for x in ts} for ts in terms], len(rows), {}
    count = lambda f: sum(map(f, range(n)))
    for c in set().union(*held):
        nc = count(lambda i: c in held[i])
        for t in set().union(*(sets[i] for i in range(n) if c in held[i])):
            nct = count(lambda i: c in held[i] and t in sets[i])
            pmi, ic = math.log2(nct * n / (nc * count(lambda i: t in sets[i]))), math.log2(n / nc)
            if nct >= 2 and ic > 0 and pmi >= 0.75 * ic:
                action[t] = max(action.get(t, ""), "remove" if pmi >= 0.95 * ic else "generalise")
    return {i: ",".join(f"{a}:{s}:{e}" for a, s, e in sorted((action[x], s, e) for x, s, e in ts if x in action)) for (i, _), ts in zip(rows, terms)}


def test_terms_equal_brute_force_over_whole_documents(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ör") for b in "bcdfghjklmnpqrst"]
    mails = ["zoltan@b.co", "mary@c.org", "+1 (555) 010-9999"]
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(40))]
        for k, m in enumerate(mails):
            if i % 7 == k:
                w += [f"own{'xyz'[k]}\n", *rng.sample(words, 12), m]
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"Zoltan Kovacs\n{'plain words far off ' * 30}\nzk@b.co {i}") for i in range(3)] + [(110 + i, "copied words with twice@b.co") for i in range(4)] + [(200, "we met kovacs today")]
    got = {r.doc_id: r.terms for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert "remove:0:6" in got[100] and ":7:13" in got[200]  # a line above and far off; without the entity


def test_a_long_span_is_remembered_in_texts_of_many_spans():
    """The mail's local part holds twelve addresses; the words of its domain are no terms, however many spans there are."""
    mail = ".".join(["1.2.3.4"] * 12) + "@inner.domain.org near"
    many = "5.6.7.8 " * 300 + mail + " 5.6.7.8"
    assert len(pii._spans(many)) > 300
    assert [{t for t, _, _ in pii.clear_terms(x, pii._spans(x))} for x in (mail, many)] == [{b"near"}] * 2
