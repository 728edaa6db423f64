import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import pii_bootstrap as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            keep = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if keep:
                out.append((m.start(), k, m.end(), kind))
    return tuple(sorted(out))


HARD = [
    "a@b.c_d@e.f x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0255.1.1.1 256.1.1.1 1.2.3.00001", "4111 1111-1111 1111", "x41111111111111111y 5 4111111111111111 5",
    "+1 (988) 555-2485. +44 20 7946 0958-", "é 🙂 bob@x.io", "5 -4111111111111111", "4111--1111 11111111 1111", "a.b.c@x-.y.-z", "-@-.-", "+1" * 10, "", None,
    "1" * 30_000, "a" * 20_000 + "@", "9 " * 2000, "1.2.3.4 " * 300, "4111111111111111 " * 50,
]


def test_base_spans_match_the_plain_expressions(spark, odd_rows):
    rows = list(enumerate(HARD)) + [(1000 + i, r[1]) for i, r in enumerate(odd_rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "row": F.lit(2), "spans": F.lit(3), "whole": F.lit(4)}).repartition(3)
    found, base, every = P.with_spans(df)
    got = Counter((r.doc_id, tuple(tuple(s) for s in r["b"])) for r in found.select("doc_id", F.col(base).alias("b")).collect())
    assert got == Counter((i, brute(t)) for i, t in rows)
    assert set(df.columns) < set(found.columns)


def seeded(spark):
    right = [f"customer reference is {u}@x{i}.io thanks" for i, u in enumerate("abcdefghi")]
    rows = right + ["customer reference is kim77.at.w.dk thanks", "customer reference is kim77.at.w.dk", "the reference was kim88.at.w.dk", "order of the zz1234567 day", "order of the d@e.fr day", "of the people, of the day, of the town 9"]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("most", [200_000, 0])
def test_confident_patterns_discover_identifiers(spark, monkeypatch, most):
    monkeypatch.setattr(P, "BROADCAST_ROWS", most)
    found, base, every = P.with_spans(seeded(spark))
    got = {r.doc_id: [tuple(s) for s in r["s"]] for r in found.select("doc_id", F.col(every).alias("s")).collect()}
    assert got[9] == [(22, 0, 35, "email")] == got[10]
    assert got[11] == [] and got[12] == [] and got[14] == []
    assert all(len(got[i]) == 1 for i in range(9))
    redacted = {r.doc_id: r.text for r in P.redact(seeded(spark)).collect()}
    assert redacted[0] == "customer reference is [email] thanks" == redacted[9] and redacted[12] == "order of the zz1234567 day"


def test_redaction_joins_overlaps(spark):
    df = spark.createDataFrame([("a 4111111111111111 b c@d.e",), (None,)], "text string")
    assert [r.text for r in P.redact(df).collect()] == ["a [card] b [email]", None]
    spans = F.expr("array(named_struct('start', 2L, 'ord', 0, 'end', 6L, 'kind', 'x'), named_struct('start', 4L, 'ord', 1, 'end', 8L, 'kind', 'y'), named_struct('start', 8L, 'ord', 1, 'end', 9L, 'kind', 'z'))")
    assert spark.range(1).select(P.redacted(F.lit("0123456789"), spans).alias("t")).first().t == "01[x][z]9"


def test_empty(none):
    assert P.redact(none).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_confidence_counts_occurrences_in_texts_without_identifiers(spark, monkeypatch, most):
    monkeypatch.setattr(P, "BROADCAST_ROWS", most)
    rows = [f"order code is {u}@x{i}.io thanks" for i, u in enumerate("abcdefgh")] + ["order code is zz1234567 now", "order code is zz7654321 now"]
    few = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    many = spark.createDataFrame(list(enumerate(rows + ["order code is unknown today"] * 90)), "doc_id long, text string").repartition(3)
    spans = lambda df: {r.doc_id: len(r["s"]) for r in (lambda f: f[0].select("doc_id", F.col(f[2]).alias("s")))(P.with_spans(df)).collect()}
    assert spans(few)[8] == spans(few)[9] == 1  # 8 of 10
    got = spans(many)  # 8 of 100
    assert got[8] == got[9] == 0 and all(got[i] == 1 for i in range(8))


def test_long_texts_are_read_and_rewritten_whole(spark):
    """Spans in many blocks, over their edges, and more of them than are added up at once; further identifiers beside them."""
    import random

    r = random.Random(6)
    parts = [r.choice(["10.0.0.%d" % r.randrange(300), "é" * r.randrange(9), "+1 (%s) 555-0143" % ("2" * 3), "a%d@b.org" % r.randrange(99), "4111 1111 1111 1111", "no %s" % ("x" * r.randrange(300))]) for _ in range(4000)]
    text = " ".join(parts)
    assert len(text) > 20 * P.BLOCK
    df = spark.createDataFrame([(1, text), (2, "🙂" * (P.BLOCK - 3) + " 1.2.3.4"), (3, "y" * 3 * P.BLOCK)], "doc_id long, text string")
    found, base, every = P.with_spans(df)
    got = {row.doc_id: row for row in found.select("doc_id", "text", F.col(base).alias("base"), F.col(every).alias("every")).collect()}
    redacted = {row.doc_id: row.text for row in P.redact(df).collect()}
    for row in got.values():
        assert tuple((s.start, s.ord, s.end, s.kind) for s in row.base) == brute(row.text)
        out, at = "", 0
        for s in row.every:
            if s.start >= at:
                out += row.text[at : s.start] + f"[{s.kind}]"
            at = max(at, s.end)
        assert redacted[row.doc_id] == out + row.text[at:]


def test_long_identifiers_and_distant_words(spark):
    """A candidate has any length, and its two words may stand far before it."""
    code = lambda i: f"KEY-{i}-" + "q" * 100
    rows = [(i, f"the access key {' ' * 200}user{i}@mail.org") for i in range(8)] + [(100 + i, f"the access key {' ' * 200}{code(i)}") for i in range(2)]
    found, base, every = P.with_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {row.doc_id: [(s.start, s.end, s.kind) for s in row.every] for row in found.select("doc_id", F.col(every).alias("every")).collect()}
    assert all(got[100 + i] == [(215, 215 + len(code(i)), "email")] for i in range(2))
