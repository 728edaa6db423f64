import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmesh.llm import simhash_dedup as S


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return Counter((d, p, least.get(r)) for (d, _), p, r in zip(rows, prints, roots))


def test_rows_match_brute_force(odd, odd_rows):
    got = S.near_duplicates(odd.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == brute([r[:2] for r in odd_rows])


def test_no_link_is_lost_in_dense_groups(spark):
    """Fingerprints that differ by few bits fill buckets of more than two members; chains join what is far apart."""
    import random

    r, prints = random.Random(4), set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            x ^= 1 << r.randrange(64)
            x ^= (1 << r.randrange(64)) * r.randrange(2)
    prints |= {r.getrandbits(64) for _ in range(40)} | {0, 1, 3, 7, 15, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    from quillmesh.llm.components import components

    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.node: r.root for r in components(S.links(fps)).collect()}
    want = {}
    for p, root in zip(signed, brute_components(prints)):
        want.setdefault(root, []).append(p)
    assert {p: got.get(p, p) for p in signed} == {p: min(c) for c in want.values() for p in c}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_keepers(rows):
    """(id, text) of the row that stays of each component of texts of similarity 0.8."""
    texts = sorted({t or "" for _, t in rows})
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    at, groups = {t: i for i, t in enumerate(texts)}, {}
    for d, t in rows:
        groups.setdefault(top(at[t or ""]), set()).add((d is None, d or 0, hashlib.md5((t or "").encode()).digest(), d, t or ""))
    return sorted((min(g)[3:] for g in groups.values()), key=repr)


def test_one_row_of_each_group_stays(odd, odd_rows):
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == brute_keepers([r[:2] for r in odd_rows])


def test_rows_are_told_apart_by_id_and_text(spark, odd):
    r = random.Random(8)
    a, b, c = (" ".join(f"{n}{r.randrange(99)}" for _ in range(50)) for n in "abc")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "fr", "s", 1), (6, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (7, b + " end", "en", "s", 1)]
    kept = S.deduplicated(spark.createDataFrame(rows, odd.schema).withColumn("kept_text", F.lit("clash")))
    assert sorted(((r.doc_id, r.text, r.kept_text) for r in kept.collect()), key=repr) == sorted([(5, a, "clash"), (5, b, "clash"), (None, c, "clash")], key=repr)


def test_recall_of_similar_texts(spark):
    """Words replaced at random: the share of pairs of each similarity whose two texts meet."""
    r, rows, sets = random.Random(21), [], []
    words = ["".join(r.choice(["an", "be", "ti", "on", "sh", "re"]) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(80, 300))]
        v = list(w)
        for _ in range(r.randint(1, max(1, len(w) // 45))):
            v[r.randrange(len(v))] = r.choice(words)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        sets.append(len(x & y) / len(x | y))
    found = S.similar(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("root").count().where("count = 2").count()
    kept = {r.doc_id for r in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(900))
    by = {}
    for i, s in enumerate(sets):
        by.setdefault(min(19, int(s * 20)), []).append(2 * i + 1 not in kept)
    share = {k / 20: (round(sum(v) / len(v), 3), len(v)) for k, v in sorted(by.items())}
    print(share)
    same = sum(rows[2 * i][1] == rows[2 * i + 1][1] for i in range(900))  # one text, no pair
    assert found + same == sum(sum(v) for v in by.values())
    assert all(not any(v) for k, v in by.items() if k < 16)
    assert share[0.8][0] >= 0.9 and share[0.85][0] > 0.97 and share[0.9][0] > 0.99 and share[0.95][0] > 0.99


def test_empty_table(none):
    assert S.near_duplicates(none).count() == 0 and S.deduplicated(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 254, 255, 256, 70_000])
def test_long_texts_are_counted_whole(n):
    text = " ".join(f"w{i * i % 977}" for i in range(n))
    assert S.fingerprint(text.encode()) == brute_print(text)


@pytest.mark.parametrize("listed", [S.LISTED, 1])
def test_no_pair_of_similar_texts_is_left_out(spark, monkeypatch, listed):
    """Pairs just above the threshold, many of them beyond the reach of the segments, beside texts that share most of their words with all others."""
    monkeypatch.setattr(S, "LISTED", listed)
    r, texts = random.Random(5), []
    line = " ".join(f"c{i}" for i in range(60))
    for i in range(150):
        w = [f"w{r.randrange(4000)}" for _ in range(r.randint(20, 120))]
        n, v = len(w) - 4, list(w)
        for k in range(max(1, n // 45)):  # each change takes five of n shingles: 40 of 360 leave 0.8
            v[2 + k * (len(w) // max(1, n // 45))] = f"x{r.randrange(4000)}"
        texts += [" ".join(w), " ".join(v), f"{line} {' '.join(w[:8])}"]
    sets = [shingles(t) for t in texts]
    got = {bytes(x.text): x.root for x in S.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = [got[hashlib.md5(t.encode()).digest()] for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    assert len(linked) > 120 and all(at[i] == at[j] for i, j in linked)
    parent = list(range(len(texts)))
    for i, j in linked:  # no more is joined than what links join
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert len(set(parent)) == len(set(at))


def test_parities_rule_out_what_is_far_and_nothing_else(spark, monkeypatch):
    """Texts that share a rare line are paired by it; of them only the similar ones are read again, and a fold never rules out a similar pair."""
    r, texts = random.Random(9), []
    for i in range(40):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 300, 1500]))]
        texts += [" ".join(w), " ".join(w[:-1] + ["end"])]
    hashes = [S.shingle_set(t.encode()) for t in texts]
    marks = [(len(h), S.parities(h, 1 << max(255, len(h) - 1).bit_length()).tobytes()) for h in hashes]
    sets = [shingles(t) for t in texts]
    may = [[S.alike(*x, *y, 0.8) for y in marks] for x in marks]
    like = lambda n, m: min(n, m) >= 0.8 * max(n, m)
    assert all(may[i][j] == similar(sets[i], sets[j]) for i in range(80) for j in range(80) if like(marks[i][0], marks[j][0]))
    for k in range(1, 200):  # two widths: 256 and 512 shingles and more, of which k differ
        x, y = (np.random.default_rng(k).integers(0, 2**63, n, dtype=np.uint64) for n in (250, 290))
        y[:250] = x
        assert S.alike(250, S.parities(x, 256).tobytes(), 290, S.parities(y, 512).tobytes(), 0.8)
    line = " ".join(f"rare{i}" for i in range(6))
    rows = [(i, f"{line} " + " ".join(f"a{i}x{k}" for k in range(50))) for i in range(60)]
    given, links = [], S._links
    monkeypatch.setattr(S, "_links", lambda rows, pairs, *a: given.append(pairs.count()) or links(rows, pairs, *a))
    assert S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
    assert given[-1] == 0
