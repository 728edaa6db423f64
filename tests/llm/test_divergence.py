import random
from collections import Counter, defaultdict

import pytest

from quillmesh.llm import source_divergence as D


def brute(rows):
    """Plain Python over (text, lang, source)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        found = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in D.TERM.findall(text))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        shares = {}
        for s in [*sources, None]:
            own = {t: counts[lang, s][t] if s is not None else sum(counts[lang, x][t] for x in sources) for t in kept}
            total = sum(own.values())
            shares[s] = {t: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for t, n in own.items()}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            parts = {"pair": [(x, sum(far(shares[s][t], shares[x][t]) for t in kept)) for x in sources if x != s], "term": [(t, far(shares[s][t], shares[None][t])) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ranked) if part == "pair" or k < 10]
    return sorted(out)


def audit(spark, rows):
    df = spark.createDataFrame([(i, t, la, s, 1, "x", 2) for i, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, value int")
    return sorted(map(tuple, D.divergence(df.repartition(4)).collect()))


def made(seed, n, sources, vocabulary):
    r = random.Random(seed)
    words = ["".join(r.choice("abcXYZéßΩ") for _ in range(r.randint(1, 5))) for _ in range(vocabulary)]
    rows = []
    for _ in range(n):
        s = r.randrange(sources)
        own = [w for k, w in enumerate(words) if (k * 7 + s) % max(1, min(sources, k % 13)) == 0 or k < 5] or words
        rows.append((" ".join(r.choice(own) + r.choice(["", ".", "1", "'s", "\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de"]), f"s{s}"))
    return rows


@pytest.mark.parametrize("light, tile, sources, held", [(6, 64, 128, 200_000), (2, 4, 3, 50), (0, 8, 2, 7), (99, 64, 128, 1000)])
def test_equals_plain_sums(spark, monkeypatch, light, tile, sources, held):
    """Whatever the split into heavy and light, tiles and blocks of groups."""
    for name, v in (("LIGHT", light), ("TILE", tile), ("SOURCES", sources), ("HELD", held), ("PAIRS", 40)):
        monkeypatch.setattr(D, name, v)
    rows = made(1, 300, 9, 70)
    assert audit(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = made(2, 120, 4, 20) + [(None, None, None), ("", "en", "s0"), ("only rare words here", "fr", "a"), ("1 2 3", "fr", "b"), (None, "fr", None), ("x " * 50_000, "en", "s1")]
    rows += [("Same Text É", "xx", "a")] * 10 + [("", "xx", "b"), ("same", "xx", "c")]
    got = audit(spark, rows)
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "fr"} == {0}
    assert [r for r in got if r[:3] == ("xx", "a", "term")] and not [r for r in got if r[0] == "fr" and r[2] == "term"]


def test_ties_go_by_bytes(spark):
    rows = [("b a é z " * 3, "en", "x")] * 10 + [("q", "en", "y")] * 10
    assert [r[3] for r in audit(spark, rows) if r[1:3] == ("x", "term")] == sorted(["a", "b", "z", "é"], key=str.encode)


def test_empty_table(spark):
    assert audit(spark, []) == []


def test_words():
    assert D.words("Don't STOP-now É\x7fx") == ["don", "t", "stop", "now", "É", "x"]
