import hashlib
import random
import zlib

import pytest
from pyspark.errors import PythonException

from quillmesh.llm import media_chunks as M


def test_chunks_join_to_the_file_and_follow_content():
    r = random.Random(1)
    for n in (0, 1, 63, 64, 65, 5000, 100_000):
        media = M.wav(M.payload(bytes(r.choice(b"abc ") for _ in range(n))))
        parts = M.chunks(media)
        assert b"".join(p for _, p in parts) == media and all(len(p) <= M.MOST for _, p in parts)
        assert all(len(p) >= M.LEAST for _, p in parts[:-1]) and M.samples(media)[:n] == media[44 : 44 + n]
    a = bytes(r.randrange(256) for _ in range(60_000))
    x, y = ({d for d, _ in M.chunks(s)} for s in (a, b"shifted" + a))
    assert len(x & y) >= len(x) - 2


def test_rolling_hash_is_the_sum_over_its_window():
    data = bytes(random.Random(2).randrange(256) for _ in range(100))
    want = 0
    for i, b in enumerate(data):
        want = (want << 1) + int(M._GEAR[b]) & 0xFFFFFFFF
        assert int(M.rolling(data)[i]) == want


def test_rows(odd, odd_rows, none):
    files, store = M.stored(odd)
    assert files.where("refs > 0").count() > 0 and files.where("refs = 0").count() > 0
    assert store.count() == store.select("digest").distinct().count()
    got = M.read_back(files, store).collect()

    def want(t):
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])

    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=key) == sorted(((d, *want(t)) for d, t, *_ in odd_rows), key=key)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert M.read_back(*M.stored(none)).count() == 0


def test_a_lost_chunk_is_an_error(odd):
    files, store = M.stored(odd)
    with pytest.raises(PythonException):
        M.read_back(files, store.where("false")).collect()
