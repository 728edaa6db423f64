"""What keeps tasks short and calls few as the input grows."""

from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmesh.functions import envelopes as E
from quillmesh.operators import canonical
from quillmesh.plans import intake, queries
from quillmesh.sources import keyed, ledger, manifest, scratch, synthetic
from quillmesh.streaming.keyed_state import Judge


def test_partitions_grow_with_rows_not_with_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    assert scratch.spread(spark.read.parquet(f"{tmp_path}/t"), 50).rdd.getNumPartitions() == 20
    assert scratch.spread(spark.read.parquet(f"{tmp_path}/t")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_plain_lines_have_the_digest_of_their_tokens(spark, monkeypatch):
    rows = ['{"b":-5,"a":"x 5,6:7","c":[1,23,"4"]}', "7", "70", '{"a":1.5}', '{"b" : 5 , "a":"q-5" , "":"" }', '"only 5"', '{"a":"\\u0041 5"}', '{"n":12345678901234567890123,"o":"0"}', "[101,100]", '{"t":true,"n":null}', '{"a":1e3}', '{"a":-0}']
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    plain = df.select(E.canonical_text(F.col("raw")).alias("c")).collect()
    monkeypatch.setattr(E, "_SHORT", -1)
    assert plain == df.select(E.canonical_text(F.col("raw")).alias("c")).collect()
    assert plain[0].c == '{"sa":"sx 5,6:7","sb":"n-5e0","sc":["n1e0","n23e0","s4"]}'


def test_a_bucket_of_event_ids_takes_two_calls_of_the_store():
    calls, held = [], {}

    def update(v):
        calls.append("update")
        held["v"] = v

    def get():
        calls.append("get")
        return held.get("v")

    judge = Judge()
    judge.init(SimpleNamespace(getValueState=lambda *_: SimpleNamespace(get=get, update=update)))
    row = lambda a, e, p: Row(arrival=a, event=e, eventId=e, channel=None, sourceId=None, payload_fp=p, errors=[])
    first = list(judge.handleInputRows((5,), iter([row(k, f"e{k % 50}", "p") for k in reversed(range(60))]), None))
    assert calls == ["get", "update"] and [r.outcome for r in first] == ["ACCEPTED"] * 50 + ["REPLAY"] * 10
    again = list(judge.handleInputRows((5,), iter([row(99, "e1", "q"), row(98, "e2", "p")]), None))
    assert calls == ["get", "update", "get"] and [(r.eventId, r.outcome, r.errors) for r in again] == [("e2", "REPLAY", []), ("e1", "REJECTED", ["EVENT_ID_CONFLICT"])]


def test_a_batch_that_is_run_again_is_not_judged_again(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(f'{{"eventId":"E{k}","channel":"WEB","submissionId":"W{k}"}}', k) for k in range(20)], "raw string, arrival long")
    first = intake.ingest(spark, lines, f"{tmp_path}/ledger", "2024-01-31", "1").collect()
    monkeypatch.setattr(intake, "canonical", None)
    again = intake.ingest(spark, lines, f"{tmp_path}/ledger", "2024-01-31", "1")
    assert sorted((r["arrival"], r["outcome"]) for r in again.collect()) == sorted((r["arrival"], r["outcome"]) for r in first)
    with pytest.raises(manifest.Refused, match="other lines"):
        intake.ingest(spark, lines.where("arrival < 19"), f"{tmp_path}/ledger", "2024-01-31", "1")


def test_each_folder_of_hash_bits_is_a_task_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 1 << 8)
    rows = spark.range(1 << 12).selectExpr("concat('k', id) as key", "'2024-01-31' as erased")
    run = keyed.write(rows, ledger.TOMBSTONES, str(tmp_path), "run", 1 << 12)
    written = [f.name.split("-")[1] for f in (tmp_path / "tombstones/run").glob("bucket=*/part-*")]
    assert run["bits"] == 4 and run["rows"] == 1 << 12 and len(written) == len(set(written)) == 16


def test_ledger_lines_are_made_once_and_queries_write_what_they_read(spark):
    data = "/root/testdata/sf0.001"
    assert all("/lines-" in f for f in synthetic.sent(spark, data).inputFiles())
    assert queries._canonical(spark, data, "arrival", "errors").columns == ["arrival", "errors"]


def test_members_are_read_by_name_in_one_pass(spark):
    raw = '{"eventId":"E1","channel":"POST","Sender":"a","sender":"b","accommodations":[],"letterNo":"L1"}'
    lines = spark.createDataFrame([(raw, 0), ("[1]", 1), ("{}", 2), ("no", 3)], "raw string, arrival long")
    apart, alike = {"POST": ("letterNo", "sender", None)}, {"POST": ("letterNo", "sender", None), "MAIL": ("letterNo", "Sender", None)}
    assert canonical.parse(lines, apart).schema["f"].dataType.typeName() == "struct"
    rows = [[(r.sourceId, r.person, r.well_formed, r.errors) for r in intake.canonical(lines, c).orderBy("arrival").collect()] for c in (apart, alike)]
    assert rows[0] == rows[1] and rows[0][0] == ("L1", '"b"', True, []) and [r[2] for r in rows[0]] == [True, False, True, False]


def test_a_plain_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"b":12,"a":["x"]}',)], "raw string").withColumn("envelope", E.parsed(F.lit('{"z":3}')))
    assert lines.select(E.canonical_text(F.col("raw"), F.col("envelope")).alias("c")).first().c == '{"sz":"n3e0"}'
