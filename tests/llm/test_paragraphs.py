import random

import numpy as np
import pytest

from quillmesh.llm import paragraph_dedup as P


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def test_words_are_what_splitting_gives(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("aAbB\u00e9\u2003 \t\n\r\x0b\x0c.") for _ in range(r.randrange(200))).encode() for _ in range(60)] + [b"", b" \n ", b"x" * 700, b"x" * 699 + b"y", b"X" * 700]
    for piece in (P.PIECE_BYTES, 50):
        monkeypatch.setattr(P, "PIECE_BYTES", piece)
        h, text, line = P.words_of(texts)
        want = [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
        assert text.tolist() == [i for i, _ in want]
        assert len(set(h.tolist())) == len({w for _, w in want}) == len(set(zip(h.tolist(), (w for _, w in want))))
        firsts = [k == 0 for t in texts for x in t.split(b"\n") for k in range(len(x.split()))]
        assert line.tolist() == firsts


def test_anchors_lie_dense_and_apart():
    r = np.random.default_rng(1)
    sizes = (1, 5, 19, 20, 21, 100, 1000)
    h = [r.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    got = P.anchors(np.concatenate(h), np.repeat(np.arange(len(sizes)), sizes))
    base = 0
    for x, n in zip(h, sizes):
        mine, w = got[(got >= base) & (got < base + n)] - base, min(P.EVERY, n)
        least = {j + int(np.argmin(x[j : j + w])) for j in range(n - w + 1)}
        assert set(mine.tolist()) <= least and (np.diff(mine) >= P.APART).all()
        assert all(min(abs(mine - i)) < P.APART for i in least)
        base += n
    same = P.anchors(np.zeros(100_000, np.uint64), np.zeros(100_000, np.int64))
    assert len(same) > 10_000 and (np.diff(same) >= P.APART).all() and np.diff(same).max() < 2 * P.APART
    assert len(P.anchors(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0


def test_passages_of_51_words_are_found_at_any_place():
    r = random.Random(2)
    for _ in range(200):
        passage = words(r, 51)
        a, b = (" ".join(words(r, r.randint(0, 40)) + passage + words(r, r.randint(0, 40))) for _ in range(2))
        x, y = (set(P.digests(P.paragraphs([t.encode()])[2]).tolist()) for t in (a, b))
        assert x & y


def test_lines_are_paragraphs_in_any_surroundings():
    r = random.Random(12)
    for _ in range(100):
        own = words(r, r.randint(24, 40))
        a, b = ("\n".join(" ".join(x) for x in (words(r, r.randint(1, 40)), own, words(r, r.randint(1, 40)))) for _ in range(2))
        x, y = (set(P.digests(P.paragraphs([t.encode()])[2]).tolist()) for t in (a, b))
        assert x & y


def test_bands_and_subsets():
    r = np.random.default_rng(3)
    e = P.elements(r.integers(0, 2**63, (300, P.ELEMENTS)).astype(np.uint64))
    near = e.copy()
    near[:, 0] = r.integers(0, 2**63, 300).astype(np.uint64)
    near[:, 5] = r.integers(0, 2**63, 300).astype(np.uint64)
    hit = (P.band_keys(e) == P.band_keys(P.elements(near))).any(axis=1).mean()
    assert hit > 0.93 and P.COMMON == 18
    same = P.elements(np.array([[7] * P.ELEMENTS, [7] * (P.ELEMENTS - 1) + [8]], np.uint64))
    assert len(set(same[0].tolist())) == P.ELEMENTS and len(set(same[0].tolist()) & set(same[1].tolist())) == P.ELEMENTS - 1


@pytest.mark.parametrize("small", [8, 1])
def test_rows_match_brute_force(spark, monkeypatch, small):
    """Links of near copies, in small buckets and in large ones, against all pairs."""
    monkeypatch.setattr(P, "SMALL", small)
    r = random.Random(5)
    base, docs = words(r, 30), []
    for i in range(40):
        w = list(base)
        w[r.choice([0, 1, 27, 28, 29])] = f"edit{r.randrange(6)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(words(r, 60))) for i in range(20)]
    docs += [(200, docs[-1][1]), (201, " ".join(words(r, 30)) + " " + docs[-2][1].upper()), (202, None), (203, ""), (204, "one two"), (None, docs[-1][1]), (205, "the " * 400), (205, "the " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    texts = P.documents(df)
    row, word, e = P.paragraphs([(t or "").encode() for _, t in docs])
    at = {}
    for x, i, j in zip(P.digests(e).view(np.int64).tolist(), row.tolist(), word.tolist()):
        at.setdefault(x, []).append((i, j))
    d = dict(zip(P.digests(e).view(np.int64).tolist(), (set(x.tolist()) for x in e)))
    want = {(a, b) for a in d for b in d if a < b and len(d[a] & d[b]) >= 18}
    links = P.near_links(texts.select("t"), P.colliding(texts))
    got = {(min(x), max(x)) for x in links.collect()} if links is not None else set()
    assert got <= want

    def parts(edges):
        top = {x: x for x in d}
        for _ in d:
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        return top

    # paragraphs that only overlap each other in one text don't repeat each other, and needn't be linked
    overlapping = {(a, b) for a, b in want if not any(i != k or abs(j - m) >= P.WORDS for i, j in at[a] for k, m in at[b])}
    assert len(want - overlapping) > 30 and parts(got | overlapping) == parts(want)
    spans = P.repeats(df.withColumnRenamed("text", "t0").selectExpr("*", "t0 as text", "1 as kept")).collect()
    flagged = {x.doc_id for x in spans}
    assert set(range(40)) <= flagged and {118, 119, 200, 201, None} <= flagged
    assert not flagged & set(range(100, 118)) and not flagged & {202, 203, 204}
    for cluster in {x.cluster for x in spans}:
        assert len({(x.keeper_doc) for x in spans if x.cluster == cluster}) == 1
    assert sum(x.kept for x in spans if x.doc_id == 119) == 1 and not any(x.kept for x in spans if x.doc_id in (200, 201))
    assert all(x.end_word - x.first_word >= P.WORDS for x in spans)


def test_empty(none):
    assert P.repeats(none).count() == 0


def test_edited_passages_link_wherever_their_stretches_start(spark):
    r = random.Random(8)
    docs = []
    for i in range(1500):
        a = words(r, 60)
        b = list(a)
        b[r.randrange(60)] = "edited"
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    want = set()
    for x, y in zip(docs[::2], docs[1::2]):
        own = []
        for text in (x[1], y[1]):
            e = P.paragraphs([text.encode()])[2]
            own.append(dict(zip(P.digests(e).view(np.int64).tolist(), (set(s.tolist()) for s in e))))
        one, other = own
        apart = lambda a, b: not (a in one and b in one) and not (a in other and b in other)
        want |= {(min(a, b), max(a, b)) for a in one for b in other if a != b and len(one[a] & other[b]) >= P.COMMON and apart(a, b)}
    texts = P.documents(spark.createDataFrame(docs, "doc_id long, text string"))
    links = P.near_links(texts.select("t"), P.colliding(texts))
    got = {(min(x), max(x)) for x in links.collect()}
    assert len(want) > 100 and len(got & want) >= 0.95 * len(want), (len(got & want), len(want))


def test_every_exact_copy_within_a_text_counts(spark):
    r = random.Random(9)
    p, gaps = words(r, 60), [words(r, 30) for _ in range(7)]
    own = gaps[0] + p + gaps[1] + p + gaps[2] + p + gaps[3]
    docs = [(1, " ".join(own)), (2, " ".join(gaps[4] + p + gaps[5] + p + gaps[6]))]
    for rows, want in ((docs[:1], {(1, 120), (1, 210)}), (docs, {(1, 120), (1, 210), (2, 30), (2, 120)})):
        spans = P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        removed = [(x.doc_id, x.first_word, x.end_word) for x in spans if not x.kept]
        assert len(removed) == len(want)
        assert all(any(d == doc and at - 2 <= a and b <= at + 62 for doc, at in want) for d, a, b in removed)
        assert {(d, at) for d, a, b in removed for doc, at in want if d == doc and at - 2 <= a < at + 60} == want
        assert any(x.kept and x.doc_id == 1 and 28 <= x.first_word < 90 for x in spans)


def test_rows_of_one_id_or_none_are_told_apart_by_their_texts(spark):
    r = random.Random(10)
    p, q, (a, b, c, d) = words(r, 60), words(r, 60), (words(r, 30) for _ in range(4))
    rows = [(None, " ".join(p + a)), (None, " ".join(b + q)), (None, " ".join(b + q)), (5, " ".join(c + p)), (5, " ".join(q + d)), (4, " ".join(words(r, 80)))]
    spans = P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((x.first_word, x.end_word, x.keeper_doc) for x in spans if not x.kept)
    assert {x.doc_id for x in spans if not x.kept} == {None} and {x.doc_id for x in spans if x.kept} == {5}
    assert len(removed) == 2 and all(k == 5 for _, _, k in removed)
    assert removed[0][0] < 36 and removed[0][1] <= 62 and removed[1][0] >= 28 and removed[1][1] <= 92


@pytest.mark.parametrize("least", [1, 8, 24])
def test_whole_lines_against_plain_lines(spark, least):
    """Every copy beyond the first of a repeated line of ``least`` words or more, counted without ``paragraphs``, lies in a removed span."""
    r = random.Random(least)
    common = [" ".join(words(r, n)) for n in (1, 3, 7, 8, 9, 12, 20, 23, 24, 30)]
    texts = ["\n".join(r.choice(common) if r.random() < 0.5 else " ".join(words(r, r.randint(1, 30))) for _ in range(r.randint(1, 8))) for _ in range(50)]
    texts += [common[4].upper(), f"{common[5]}\n{common[5]}", "", None]
    docs = list(enumerate(texts))
    spans = P.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), line_words=least).collect()
    places, all_ = {}, {}
    for i, t in docs:
        at = 0
        for line in (t or "").split("\n"):
            w = tuple(line.lower().split())
            if w:
                places.setdefault(w, []).append((i, at, at + len(w)))
            at += len(w)
        all_[i] = at
    covered = {(x.doc_id, k) for x in spans if not x.kept for k in range(x.first_word, x.end_word)}
    repeated = {w: p for w, p in places.items() if len(p) > 1 and len(w) >= least}
    assert len(repeated) >= 2
    for w, p in repeated.items():
        assert all((i, k) in covered for i, a, b in sorted(p)[1:] for k in range(a, b)), w
    may = {(i, k) for w, p in repeated.items() for i, a, b in p for k in range(a, b)}
    assert all(x.end_word - x.first_word >= 24 for x in spans if not x.kept and not {(x.doc_id, k) for k in range(x.first_word, x.end_word)} <= may)
