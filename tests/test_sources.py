import json
import urllib.error
import urllib.request

import http.client
import os

import pytest

from quillmesh.plans.intake import ingest, outcomes
from quillmesh.sources import ledger
from quillmesh.sources.inbox import Endpoint, envelopes_of, land, read_inbox, stream_inbox
from quillmesh.streaming.intake import start

from tests.test_intake import HOTLINE, PHYSICAL, REVOCATION, WEB


def test_endpoint_lands_what_the_inbox_reads(spark, tmp_path):
    with Endpoint(str(tmp_path / "in")) as e:

        def post(body, path="/intake"):
            request = urllib.request.Request(f"http://127.0.0.1:{e.port}{path}", body.encode(), method="POST")
            try:
                with urllib.request.urlopen(request, timeout=10) as r:
                    return r.status
            except urllib.error.HTTPError as error:
                return error.code

        assert post(json.dumps(WEB, indent=2)) == 202
        assert post(json.dumps([PHYSICAL, HOTLINE])) == 202
        assert post("{") == 400 and post("{}", "/other") == 404
    rows = outcomes(read_inbox(spark, str(tmp_path / "in"))).collect()
    assert sorted(r.eventId for r in rows) == ["EV-H-001", "EV-P-001", "EV-W-001"]
    assert {r.outcome for r in rows} == {"ACCEPTED"}


def test_batch_again_leaves_one_copy_and_retention_drops_dates(spark, tmp_path):
    path = str(tmp_path / "ledger")
    land(str(tmp_path / "a"), [json.dumps(PHYSICAL)])
    land(str(tmp_path / "b"), [json.dumps(PHYSICAL), json.dumps(HOTLINE)])
    for _ in range(2):
        ingest(spark, read_inbox(spark, str(tmp_path / "a")), path, "2024-01-01", "b1")
    before = ledger.read(spark, path)
    assert before.count() == 1 and ledger.next_arrival(before) == 1
    ingest(spark, read_inbox(spark, str(tmp_path / "b")), path, "2024-01-02", "b1")
    found = {(r.eventId, r.outcome, r.ingest_date) for r in ledger.read(spark, path).collect()}
    assert found == {("EV-P-001", "ACCEPTED", "2024-01-01"), ("EV-P-001", "REPLAY", "2024-01-02"), ("EV-H-001", "ACCEPTED", "2024-01-02")}
    assert ledger.purge(spark, path, "2024-01-02") == ["2024-01-01"]
    assert ledger.read(spark, path).count() == 2


def _stream(spark, landing, path, checkpoint):
    query = start(spark, stream_inbox(spark, landing), path, checkpoint, "2024-01-01").trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_stream_equals_batch(spark, tmp_path):
    lines = [HOTLINE, dict(reversed(HOTLINE.items())), HOTLINE | {"callbackWindowMinutes": 60}, "x", WEB, REVOCATION, HOTLINE, PHYSICAL | {"accommodations": ["NOPE"]}]
    lines = [x if isinstance(x, str) else json.dumps(x) for x in lines]
    want = sorted((r.raw, r.outcome, tuple(r.errors)) for r in outcomes(spark.createDataFrame(list(zip(lines, range(9))), "raw string, arrival long")).collect())
    landing, path, checkpoint = (str(tmp_path / n) for n in ("in", "ledger", "checkpoint"))
    for part in (lines[:3], lines[3:6], lines[6:]):
        land(landing, part)
        _stream(spark, landing, path, checkpoint)
    rows = ledger.read(spark, path).collect()
    assert sorted((r.raw, r.outcome, tuple(r.errors)) for r in rows) == want
    assert sorted(r.arrival for r in rows) == list(range(8))


def test_stream_and_batch_know_each_other(spark, tmp_path):
    landing, batch, path, checkpoint = (str(tmp_path / n) for n in ("in", "batch", "ledger", "checkpoint"))
    land(landing, [json.dumps(HOTLINE)])
    _stream(spark, landing, path, checkpoint)
    land(batch, [json.dumps(HOTLINE), json.dumps(HOTLINE | {"callbackWindowMinutes": 60}), json.dumps(WEB)])
    assert sorted(r.outcome for r in ingest(spark, read_inbox(spark, batch), path, "2024-01-02", "b").collect()) == ["ACCEPTED", "REJECTED", "REPLAY"]
    land(landing, [json.dumps(WEB), json.dumps(HOTLINE | {"callbackWindowMinutes": 60}), json.dumps(PHYSICAL)])
    _stream(spark, landing, path, checkpoint)
    found = ledger.read(spark, path)
    assert [r.outcome for r in ledger.outcomes_of(found, "EV-H-001").collect()] == ["ACCEPTED", "REPLAY", "REJECTED", "REJECTED"]
    assert [r.outcome for r in ledger.outcomes_of(found, "EV-W-001").collect()] == ["ACCEPTED", "REPLAY"]
    assert ledger.next_arrival(found) == 7


def test_arrival_is_the_order_of_landing(spark, tmp_path):
    landing = str(tmp_path / "in")
    for i, lines in enumerate([[json.dumps(HOTLINE)], [json.dumps(HOTLINE | {"callbackWindowMinutes": 60})] + [json.dumps(HOTLINE | {"eventId": f"E{i}"}) for i in range(2000)], ["", "y"]]):
        name = land(landing, lines)
        os.utime(os.path.join(landing, name), (1_700_000_000 + i, 1_700_000_000 + i))
    rows = read_inbox(spark, landing).orderBy("arrival").collect()
    assert [r.arrival for r in rows] == list(range(2004))
    assert [json.loads(r.raw)["eventId"] for r in rows[1:2002]] == ["EV-H-001"] + [f"E{i}" for i in range(2000)] and [r.raw for r in rows[2002:]] == ["", "y"]
    found = {r.callbackWindowMinutes: r.outcome for r in outcomes(read_inbox(spark, landing)).where("eventId = 'EV-H-001'").collect()}
    assert found == {45: "ACCEPTED", 60: "REJECTED"}


def test_blank_event_ids_are_no_event(spark):
    lines = [json.dumps(HOTLINE | {"eventId": e, "callbackWindowMinutes": m}) for e in ("", " ", "\t", "\u00a0\n") for m in (45, 45, 60)]
    rows = outcomes(spark.createDataFrame(list(zip(lines, range(12))), "raw string, arrival long")).collect()
    assert {(r.outcome, tuple(r.errors)) for r in rows} == {("REJECTED", ("MISSING_EVENT_ID",))}


def test_landed_text_is_the_text_that_was_sent(tmp_path):
    assert envelopes_of(' {"a": 1.50,\n "b": "\u2028"} ') == ['{"a": 1.50,\n "b": "\u2028"}']
    assert envelopes_of('[ {"a":1} , 1e0,\n"x"]') == ['{"a":1}', "1e0", '"x"'] and envelopes_of("[]") == []
    for bad in ('{"eventId":"A","eventId":"B"}', '[{"a":{"b":1,"b":2}}]', '{"a": NaN}', "{} {}", "", "[1,]", "[1"):
        with pytest.raises(ValueError):
            envelopes_of(bad)
    name = land(str(tmp_path), ['{"a":\r\n1, "b": "\u2028\x85"}'])
    with open(tmp_path / name, encoding="utf-8", newline="") as f:
        assert f.read() == '{"a": 1, "b": "\u2028\x85"}\n'


@pytest.mark.parametrize("length, status", [("x", 400), ("-1", 400), (None, 411), ("99999999", 413)])
def test_lengths_that_cannot_be(tmp_path, length, status):
    with Endpoint(str(tmp_path)) as e:
        c = http.client.HTTPConnection("127.0.0.1", e.port, timeout=10)
        c.putrequest("POST", "/intake")
        if length is not None:
            c.putheader("Content-Length", length)
        c.endheaders()
        assert c.getresponse().status == status


def test_landed_files_are_purged_by_time_once_ingested(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    old, new = (land(landing, ["{}"]) for _ in range(2))
    os.utime(os.path.join(landing, old), (1_600_000_000, 1_600_000_000))
    assert ledger.purge_landing(spark, landing, "2021-01-01", path) == []
    ingest(spark, read_inbox(spark, landing), path, "2024-01-01", "0001")
    late = land(landing, ["{}"])
    os.utime(os.path.join(landing, late), (1_600_000_000, 1_600_000_000))
    assert ledger.purge_landing(spark, landing, "2021-01-01", path) == [old]
    assert {n for n in os.listdir(landing) if n.endswith(".jsonl")} == {new, late}
