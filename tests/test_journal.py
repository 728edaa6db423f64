"""The landing directory as a data source, and replays by stream state."""

import json
import os
import threading

import pytest

from quillmesh.plans.intake import ingest, outcomes
from quillmesh.sources import inbox, journal, ledger
from quillmesh.streaming import keyed_state
from quillmesh.streaming.intake import start

from tests.test_intake import HOTLINE, PHYSICAL, REVOCATION, WEB

LINES = [HOTLINE, dict(reversed(HOTLINE.items())), HOTLINE | {"callbackWindowMinutes": 60}, "x", "", WEB, REVOCATION, {}, {}, HOTLINE, PHYSICAL | {"accommodations": ["NOPE"]}, "é "]
TEXTS = [x if isinstance(x, str) else json.dumps(x) for x in LINES]


def test_numbers_are_taken_in_the_order_of_showing(tmp_path):
    path = str(tmp_path)
    threads = [threading.Thread(target=lambda: [inbox.land(path, ["{}"]) for _ in range(20)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n in os.listdir(path) if n.endswith(".jsonl")) == [f"{i:016d}.jsonl" for i in range(80)]
    for n in os.listdir(path):
        if n.endswith(".jsonl"):
            os.remove(os.path.join(path, n))
    inbox._KNOWN.clear()  # another process, after a purge
    assert inbox.land(path, ["{}"]) == f"{80:016d}.jsonl"


def test_batch_reads_what_landed(spark, tmp_path):
    path = str(tmp_path / "in")
    assert journal.read(spark, path).collect() == []
    names = [inbox.land(path, part) for part in (TEXTS[:5], [], TEXTS[5:])]
    with open(os.path.join(path, "other.jsonl"), "w") as f:
        f.write("none of ours\n")
    rows = journal.read(spark, f"file://{path}").orderBy("arrival").collect()
    assert [r.raw for r in rows] == TEXTS and [r.file for r in rows] == [names[0]] * 5 + [names[2]] * 7
    assert [r.arrival >> journal.PLACE_BITS for r in rows] == [0] * 5 + [2] * 7
    small = spark.read.format("intake").option("partitionBytes", 1).load(path)
    assert small.rdd.getNumPartitions() == 3 and sorted(map(tuple, small.collect())) == sorted(map(tuple, rows))


def run(query):
    q = query.trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_stream_reads_each_line_once(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (TEXTS[:4], TEXTS[4:9], [], TEXTS[9:]):
        inbox.land(path, part)
        run(journal.stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    got = sorted(map(tuple, spark.read.parquet(out).select("raw", "arrival", "file").collect()))
    assert got == sorted(map(tuple, journal.read(spark, path).collect())) and len(got) == len(TEXTS)


def test_stream_into_a_ledger(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    for part in (TEXTS[:4], TEXTS[4:9], TEXTS[9:]):
        name = inbox.land(landing, part)
        run(start(spark, journal.stream(spark, landing), path, str(tmp_path / "c"), "2024-01-01"))
    want = outcomes(spark.createDataFrame(list(zip(TEXTS, range(99))), "raw string, arrival long"))
    key = lambda df: [(r.raw, r.outcome, r.errors) for r in df.orderBy("arrival").collect()]
    assert key(ledger.read(spark, path)) == key(want)
    assert name in {r.file for r in ledger.landed(spark, path).collect()}


@pytest.fixture
def stateful(spark):
    with keyed_state.rocksdb(spark) as session:
        yield session


def test_state_judges_like_the_batch_plan_and_survives_a_restart(spark, stateful, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (TEXTS[:2], TEXTS[2:8], TEXTS[8:]):  # each a new query over the same checkpoint
        inbox.land(landing, part)
        run(keyed_state.judged(journal.stream(stateful, landing)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    want = outcomes(journal.read(spark, landing).drop("file")).select("arrival", "eventId", "outcome", "errors")
    got = spark.read.parquet(out).select("arrival", "eventId", "outcome", "errors")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_state_is_seeded_from_a_ledger(spark, stateful, tmp_path):
    path, landing, out = str(tmp_path / "ledger"), str(tmp_path / "in"), str(tmp_path / "out")
    ingest(spark, spark.createDataFrame([(json.dumps(HOTLINE), 0)], "raw string, arrival long"), path, "2024-01-01", "0001")
    inbox.land(landing, [json.dumps(HOTLINE), json.dumps(HOTLINE | {"callbackWindowMinutes": 60}), json.dumps(WEB)])
    seed = ledger.table(stateful, path, ledger.IDS)
    run(keyed_state.judged(journal.stream(stateful, landing), seed).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")))
    assert [r.outcome for r in spark.read.parquet(out).orderBy("arrival").collect()] == ["REPLAY", "REJECTED", "ACCEPTED"]


def test_state_needs_its_store(spark):
    with pytest.raises(RuntimeError):
        keyed_state.judged(spark.readStream.format("rate").load().selectExpr("cast(value as string) as raw", "value as arrival"))
