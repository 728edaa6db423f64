import os
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import piece_fst as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no public tokenizer")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def fst():
    return P.PieceTransducer(P.model_bytes())


def test_ids_and_texts_are_the_librarys(fst, library):
    r = random.Random(1)
    texts = ["", " ", "  a\t b", "Hello  world\n été", "\n\n x", "▁a", "日本語 🙂 é\r\n", "a" * 300, "<s> </s> <unk> <0x0A>", "internationalization 12345678901234567890"]
    texts += ["".join(r.choice("abcdeéß 🙂\n▁ th in") for _ in range(60)) for _ in range(300)]
    for t in texts:
        ids = fst.encode(t)
        assert ids.tolist() == library.encode(t)
        assert fst.decode(ids) == library.decode(ids.tolist()) == t.replace("▁", " ")


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_character_maps_are_the_librarys(rule):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    specs = [dict(P._fields(v)) for n, v in P._fields(made.serialized_model_proto()) if n == 3]
    mine, r = P.Normaliser(specs[0]), random.Random(2)
    texts = ["", " ", "  a\t b ", "Ｈｅｌｌｏ　Ｗörld ① ﬁ ½ e\u0301", "İSTANBUL ǅ ẞ", "▁a ▁", "a\u200bb\ufeff\r\n c", "㍿ ｶﾞ 가", "a" * 300]
    texts += ["".join(r.choice("abEÉßﬀ①ｶﾞ\u0301\u0323 \u3000\t▁ıİ½가ﷺ🙂") for _ in range(r.randint(1, 30))) for _ in range(500)]
    for trim in (0, 1):
        for prefix in (0, 1):
            made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=bool(prefix), escape_whitespaces=True, remove_extra_whitespaces=bool(trim))
            mine.prefix, mine.trim = bool(prefix), bool(trim)
            for t in texts:
                assert mine(t) == made.normalize(t), (t, trim, prefix)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 3)
    monkeypatch.setattr(P, "PAIRS", 3)
    small, text = P.PieceTransducer(P.model_bytes()), "the theory of the thing and another theory of things"
    assert small.encode(text).tolist() == library.encode(text)


def test_unigram_weights_take_the_cheapest_path():
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    import struct

    piece = lambda p, s, k=1: field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k]))
    model = piece("<unk>", 0, 2) + piece("▁", -3) + piece("a", -3) + piece("b", -3) + piece("ab", -4) + piece("▁a", -3.5) + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))
    fst = P.PieceTransducer(model)
    assert [fst.pieces[i] for i in fst.encode("ab")] == ["▁a", "b"]
    assert [fst.pieces[i] for i in fst.encode("bab")] == ["▁", "b", "ab"]


def test_rows(odd, odd_rows, none):
    got = P.encode_column(odd.withColumn("ids", F.lit("clash"))).collect()
    assert len(got) == len(odd_rows) and all(r.exact for r in got)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (120, 121))
    assert P.encode_column(none).count() == 0
    assert set(P.encode_column(none).columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "exact"}


def test_a_worker_remembers_64_mb_at_most(fst):
    assert 2 * P.REMEMBERED <= 64 << 20
    memo = P._Memo(fst)
    memo.held = P.REMEMBERED
    memo["the"], memo["of"]
    assert len(memo.elder) == 0 and len(memo) == 2 and memo.held < 1 << 10


class Sliced(str):
    """A text that counts the parts that are read of it."""

    n = 0

    def __getitem__(self, at):
        Sliced.n += 1
        return str.__getitem__(self, at)


def test_few_parts_of_a_segment_are_read(fst, library):
    """Most positions are on no path that is tried, so their arcs aren't looked up."""
    words = ["▁enberlichä", "▁tionelleeux", "▁auxtreeau", "▁edheinthntering", "▁Undverberer", "▁eresble,", "▁athaly$$$", "▁équeauxeux", "▁4311575929938279", "▁internationalization"]
    Sliced.n = 0
    for w in words:
        assert fst.shortest(Sliced(w)) == library.encode(w[1:])
    assert Sliced.n < 3 * sum(map(len, words))
    print(Sliced.n, sum(map(len, words)))
