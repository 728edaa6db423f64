"""The stages over a small corpus, each against what brute force says of its input."""

import corpus_pipeline as pipeline
import pytest
from quillmesh.llm import simhash_dedup, toxicity_grammar

from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_keepers


@pytest.fixture(scope="module")
def corpus(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    personal = [(300 + i, f"text number {i} of a@b{i}.org and 10.0.0.{i} with {'more ' * i}words", "en", "s1", 5) for i in range(5)]
    toxic = [(400 + i, f"you are an idiot and a moron, {'go ' * i}", "en", "s2", 5) for i in range(5)]
    odd.unionByName(spark.createDataFrame(personal + toxic, odd.schema)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(300 + i, 1, 0) for i in range(5)] + [(400 + i, 1, 1) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], corpus).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == columns for s in seen[:-1])
    rows = [[tuple(r) for r in s.collect()] for s in seen]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    grammar = toxicity_grammar.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    clean = [r for r in rows[0] if grammar.score(r[1])[0] < toxicity_grammar.THRESHOLD]
    assert sorted(rows[1], key=key) == sorted(clean, key=key) and not any((r[0] or 0) >= 400 for r in rows[1]) and len(rows[1]) == len(rows[0]) - 5
    assert sorted(((r[0], r[1] or "") for r in rows[2]), key=repr) == brute_keepers([r[:2] for r in rows[1]])
    assert sorted(r[0] or -1 for r in rows[3]) == sorted(r[0] or -1 for r in rows[2])
    assert not any(brute_spans(r[1]) for r in rows[3]) and any(brute_spans(r[1]) for r in rows[2])
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows[3])
    untouched = {r[0]: r[1] for r in rows[2] if not brute_spans(r[1])}
    assert all(untouched[r[0]] == r[1] for r in rows[3] if r[0] in untouched)
    assert sorted(rows[4], key=key) == sorted(rows[3], key=key)
    assert len(rows[5]) == len(rows[4]) and seen[5].where("not exact").isEmpty()


def test_run(spark, corpus):
    assert pipeline.run(spark, corpus).count() > 0


def test_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash_dedup.deduplicated(none).columns == none.columns


def test_the_mix_shows_in_the_result(spark, corpus, monkeypatch):
    monkeypatch.setattr(pipeline.pfair_mixing.schedule, "__defaults__", (None, 300, *pipeline.pfair_mixing.schedule.__defaults__[2:]))
    rows = sorted(pipeline.run(spark, corpus).collect(), key=lambda r: (r.mix_part, r.mix_row))
    assert len({(r.mix_part, r.mix_row) for r in rows}) == len(rows)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, corpus)
    due = {}
    for r in pipeline.pfair_mixing.schedule(docs).where("copy = 0").collect():
        due.setdefault((r.id, r.source), []).append((r.slot, r.before))
    places = [due[r.doc_id, r.source or ""] for r in rows]
    assert all(len(p) == 1 for p in places if p) and len({p[0][0] for p in places}) > 20
    assert [p[0] for p in places] == sorted(p[0] for p in places)


def test_clashing_columns(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for c in ("mix_slot", "mix_part", "toxicity", "kept_text", "spans", "copy"):
        docs = docs.selectExpr("*", f"'x' as {c}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.count() == pipeline.run(spark, corpus).count()
