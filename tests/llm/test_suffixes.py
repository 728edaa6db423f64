import hashlib
import os
import random
import tempfile
from collections import Counter

import numpy as np
import pytest

from quillmesh.llm import external_induction as X
from quillmesh.llm import suffix_dedup as S


def padded(data, window):
    out = np.zeros(len(data) + window + 8, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out[: len(data)]


@pytest.mark.parametrize("memory, step", [(0, 3), (100, 7), (1 << 20, 1 << 16)])
def test_marks_equal_counts(monkeypatch, memory, step):
    """Whether everything fits into memory or spills after a tuple and recurs to the end."""
    monkeypatch.setattr(X, "_STEP", step)
    r = random.Random(memory)
    for _ in range(60):
        letters, n, window = r.choice([1, 2, 3, 200]), r.randint(0, 260), r.choice([1, 2, 5, 13, 200])
        data = bytes(r.randrange(1, 1 + letters) for _ in range(n))
        data = (data + data[3:20] * r.randint(0, 4) + data[: n // 2]) + b"\xff"
        counts = Counter(data[i : i + window] for i in range(len(data) - window + 1))
        with tempfile.TemporaryDirectory() as folder:
            got = np.array(X.repeated(padded(data, window), folder, window, memory))[: max(0, len(data) - window + 1)]
        assert got.tolist() == [counts[data[i : i + window]] > 1 for i in range(len(got))]


def test_suffixes_of_names_are_in_order(monkeypatch):
    r = random.Random(2)
    for letters in (2, 40, 1000):
        t = np.array([r.randrange(letters) for _ in range(500)], np.int64)
        with tempfile.TemporaryDirectory() as folder:
            got = np.array(X.Suffixes(t, folder, 16, 200, False).sorted(0)).tolist()
        assert got == sorted(range(500), key=lambda i: t[i:].tolist())


def test_queue_spills_and_keeps_its_order(tmp_path):
    q, r, want = X.SpillingQueue(str(tmp_path), 5), np.random.default_rng(1), []
    for i in range(40):
        s = r.integers(0, 6, r.integers(0, 9))
        want += [(int(c), i * 100 + k) for k, c in enumerate(s)]
        q.push(s, i * 100 + np.arange(len(s)), np.zeros(len(s), np.uint8))
    assert q.spilled > 5 and len(os.listdir(tmp_path)) > 5
    got = []
    while (c := q.least()) is not None:
        got += [(c, int(x)) for p, _ in q.pop(c) for x in p]
    assert got == sorted(want) and os.listdir(tmp_path) == []


def brute(texts):
    bodies = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if counts[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if b else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


def removals(spark, tmp_path, texts, extra="key string, spans int"):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    path = str(tmp_path / "tables")
    spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(5).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op12_suffix_dedup(spark, path).collect()}
    return [got[i] for i in range(len(texts))]


def made(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(n) for n in (150, 199, 200, 230, 900)]
    texts = [text(r.randint(0, 500)) + r.choice(shared) + text(r.randint(0, 400)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1][:300] + "!" + texts[1][300:], shared[4], shared[4][1:], shared[1], "", None, "x" * 3000, "ab" * 400, "x" * 199, "x" * 200, "é" * 150]
    return texts + [shared[3] + text(20) + shared[3], shared[2] * 3]


@pytest.mark.parametrize("hot, grams", [(4096, None), (1, None), (2, (64, 200))])
def test_equals_counting(spark, tmp_path, monkeypatch, hot, grams):
    """With anchors that are never hot, that always are, and shards of every kind."""
    monkeypatch.setattr(S, "HOT", hot)
    if grams:
        monkeypatch.setattr(S, "GRAMS", grams)
    texts = made(hot)
    assert removals(spark, tmp_path, texts) == brute(texts)


def test_small_shards_and_little_memory(spark):
    r = random.Random(4)
    base = "".join(r.choice("abc ") for _ in range(3000))
    parts = [base[a : a + 300 + a % 90] for a in range(0, 2600, 37)]
    rows = [(k % 5, k, 1, p.encode()) for k, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "key long, segment long, n long, body binary")
    every = Counter(b[i : i + 200] for _, _, _, b in rows for i in range(len(b) - 199))
    for shard, memory in ((1 << 30, 1 << 24), (2000, 64)):
        got = {r.segment: {i for a, z in r.spans for i in range(a, z)} for r in S.sorted_shards(df, shard, memory).collect()}
        for key in range(5):
            own = [(k, b) for kk, k, _, b in rows if kk == key]
            counts = Counter(b[i : i + 200] for _, b in own for i in range(len(b) - 199))
            for k, b in own:
                want, may = ({i for i in range(len(b) - 199) if c[b[i : i + 200]] > 1} for c in (counts, every))
                assert want <= got.get(k, set()) <= may


def test_empty_table(spark, tmp_path):
    assert removals(spark, tmp_path, []) == []


def test_long_texts_are_anchored_by_pieces(monkeypatch):
    r = np.random.default_rng(5)
    body = r.integers(97, 101, 5000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*S.runs(body, 64))]
    monkeypatch.setattr(S, "_PIECE", 700)
    pieces = [np.concatenate(x) for x in zip(*S.runs(body, 64))]
    spread = lambda x: np.repeat(x[2], x[1])  # noqa: E731  the anchor of each window
    assert len(spread(whole)) == 4801 and (spread(whole) == spread(pieces)).all()
