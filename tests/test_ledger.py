"""The ledger's safety and the tables kept beside it."""

import json
import os
import random

import pytest

from quillmesh.operators import consent
from quillmesh.operators.validate import split
from quillmesh.plans import intake
from quillmesh.plans.intake import ingest, outcomes
from quillmesh.sources import files, keyed, ledger, manifest
from quillmesh.sources.inbox import land, stream_inbox
from quillmesh.streaming.intake import start

from tests.test_intake import HOTLINE, PHYSICAL, REVOCATION, WEB


def lines(spark, *envelopes):
    return spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e), i) for i, e in enumerate(envelopes)], "raw string, arrival long")


def held(spark, path):
    return sorted((r.eventId, r.outcome, r.ingest_date, r.batch) for r in ledger.read(spark, path).collect())


@pytest.mark.parametrize("batch", ["0001", "1e3", "2024-01-31", "null", "a/b=c %", "__HIVE_DEFAULT_PARTITION__"])
def test_any_batch_name(spark, tmp_path, batch):
    path, given = str(tmp_path / "ledger"), lines(spark, HOTLINE, WEB)
    want = [("EV-H-001", "ACCEPTED", "2024-01-01", batch), ("EV-W-001", "ACCEPTED", "2024-01-01", batch)]
    for _ in range(2):
        assert ingest(spark, given, path, "2024-01-01", batch).count() == 2
        assert held(spark, path) == want


def test_a_name_stands_for_its_lines(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ingest(spark, lines(spark, HOTLINE), path, "2024-01-01", "0001")
    for other in ((WEB,), (HOTLINE, HOTLINE), ()):
        with pytest.raises(manifest.Refused):
            ingest(spark, lines(spark, *other), path, "2024-01-01", "0001")
    ingest(spark, lines(spark, WEB), path, "2024-01-02", "0001")
    assert [r[0] for r in held(spark, path)] == ["EV-H-001", "EV-W-001"]
    with pytest.raises(ValueError):
        ingest(spark, lines(spark, WEB), path, "today", "0002")


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    ingest(spark, lines(spark, HOTLINE), path, "2024-01-01", "0001")
    before = held(spark, path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(intake.manifest, "commit", stop)
        ingest(spark, lines(spark, HOTLINE, WEB), path, "2024-01-01", "0002")
    assert held(spark, path) == before and ledger.table(spark, path, ledger.IDS).count() == 1
    assert files.names(spark, f"{path}/scratch") == []
    ingest(spark, lines(spark, HOTLINE, WEB), path, "2024-01-01", "0002")
    after = held(spark, path)
    assert after == sorted([*before, ("EV-H-001", "REPLAY", "2024-01-01", "0002"), ("EV-W-001", "ACCEPTED", "2024-01-01", "0002")])
    assert len([n for n in ledger.vacuum(spark, path) if n.startswith("rows/")]) == 1
    assert held(spark, path) == after and ledger.table(spark, path, ledger.IDS).count() == 2 and ledger.vacuum(spark, path) == []


def test_the_slower_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    path, commit = str(tmp_path / "ledger"), manifest.commit

    def late(spark, path, entry):
        monkeypatch.setattr(intake.manifest, "commit", commit)
        ingest(spark, lines(spark, WEB), path, "2024-01-01", "fast")
        return commit(spark, path, entry)

    monkeypatch.setattr(intake.manifest, "commit", late)
    with pytest.raises(manifest.Refused):
        ingest(spark, lines(spark, HOTLINE, WEB), path, "2024-01-01", "slow")
    assert held(spark, path) == [("EV-W-001", "ACCEPTED", "2024-01-01", "fast")]
    ingest(spark, lines(spark, HOTLINE, WEB), path, "2024-01-01", "slow")
    assert [r[:2] for r in held(spark, path)] == [("EV-H-001", "ACCEPTED"), ("EV-W-001", "ACCEPTED"), ("EV-W-001", "REPLAY")]


def test_two_streams_share_a_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def run(name, *envelopes):
        if envelopes:
            land(str(tmp_path / name), [json.dumps(e) for e in envelopes])
        q = start(spark, stream_inbox(spark, str(tmp_path / name)), path, str(tmp_path / f"{name}-checkpoint"), "2024-01-01").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    run("a", HOTLINE)
    run("b", WEB, HOTLINE)
    run("a", WEB | {"consent": []})
    run("a")
    assert [r[:2] for r in held(spark, path)] == [("EV-H-001", "ACCEPTED"), ("EV-H-001", "REPLAY"), ("EV-W-001", "ACCEPTED"), ("EV-W-001", "REJECTED")]
    state = manifest.latest(spark, path)
    assert sorted(state.streams.values()) == [0, 1] and state.next == 4
    stream = next(s for s, n in state.streams.items() if n == 1)
    ingest(spark, lines(spark, PHYSICAL), path, "2024-01-01", "x", (stream, 1))  # a micro-batch that is run again
    assert len(held(spark, path)) == 4


def test_a_stream_ages_by_days(spark, tmp_path):
    land(str(tmp_path / "in"), [json.dumps(HOTLINE)])
    q = start(spark, stream_inbox(spark, str(tmp_path / "in")), str(tmp_path / "ledger"), str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    (row,) = ledger.read(spark, str(tmp_path / "ledger")).collect()
    assert row.ingest_date >= "2024-06-01"


def bytes_read(spark, run):
    stats = lambda: sum(s.getBytesRead() for s in spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")
    before = stats()
    out = run()
    return stats() - before, out


def test_what_a_lookup_reads_follows_its_keys(spark, tmp_path, monkeypatch):
    """The same three keys from a table of 40,000 and of 320,000 rows, in as many runs."""
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 1 << 12)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.hadoop.vectored.io.enabled", "false")  # else nobody counts the bytes
    sizes = {}
    for n in (40_000, 320_000):
        path = str(tmp_path / str(n))
        rows = spark.range(n).selectExpr("concat('E', id) as key", "id as arrival", "sha2(cast(id as string), 256) as payload_fp", "'2024-01-01' as ingest_date")
        live = [keyed.write(rows.where(f"arrival % 4 = {k}"), ledger.IDS, path, f"r{k}", n // 4) for k in range(4)]
        keys = spark.createDataFrame([("E5",), ("E17999",), ("none",), ("none",)], "key string")
        sizes[n], found = bytes_read(spark, lambda: sorted((r.key, r.arrival) for r in keyed.find(spark, ledger.IDS, path, live, keys, 4).collect()))
        assert found == [("E17999", 17999), ("E5", 5)]
        assert sorted((r.key, r.arrival) for r in keyed.find(spark, ledger.IDS, path, live, keys, 10**6).collect()) == found
    whole, _ = bytes_read(spark, lambda: keyed.read(spark, ledger.IDS, str(tmp_path / "320000"), live).agg({"payload_fp": "max"}).collect())
    spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.hadoop.vectored.io.enabled")
    assert sizes[320_000] < 2 * sizes[40_000] and sizes[320_000] < whole / 10


def test_runs_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FANOUT", 2)
    path = str(tmp_path / "ledger")
    for i in range(5):
        ingest(spark, lines(spark, HOTLINE | {"eventId": f"E{i}"}, HOTLINE | {"eventId": "E0"}), path, "2024-01-01", f"{i}")
    state = manifest.latest(spark, path)
    assert len(state.live["ids"]) <= 3 and state.next == 10 and ledger.vacuum(spark, path) == []
    assert sorted((r.key, r.arrival) for r in ledger.table(spark, path, ledger.IDS).collect()) == [("E0", 0), ("E1", 2), ("E2", 4), ("E3", 6), ("E4", 8)]
    assert sorted(r.outcome for r in ledger.read(spark, path).collect()) == ["ACCEPTED"] * 5 + ["REPLAY"] * 5


def test_old_commits_are_put_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    for i in range(4):
        ingest(spark, lines(spark, HOTLINE | {"eventId": f"E{i}"}), path, "2024-01-01", f"{i}")
    state = manifest.latest(spark, path)
    for i in range(3):  # as other commits would follow
        state = manifest.commit(spark, path, state.following("merge"))
    monkeypatch.setattr(manifest, "KEPT", 2)
    before, rows = sorted(map(str, manifest.entries(spark, path).collect())), held(spark, path)
    with monkeypatch.context() as m:
        m.setattr(files, "remove", lambda *_: None)  # broken off before the commits go
        assert manifest.compact(spark, path, 3) == 5
    assert sorted(map(str, manifest.entries(spark, path).collect())) == before
    assert manifest.compact(spark, path, 3) == 5 and manifest.compact(spark, path, 3) == 0
    assert len(files.names(spark, f"{path}/manifest")) == 3
    assert sorted(map(str, manifest.entries(spark, path).collect())) == before and held(spark, path) == rows
    assert ingest(spark, lines(spark, HOTLINE | {"eventId": "E0"}), path, "2024-01-01", "0").count() == 1
    with pytest.raises(manifest.Refused):
        ingest(spark, lines(spark, WEB), path, "2024-01-01", "0")


def random_inbox(seed):
    r = random.Random(seed)
    scopes = ["CONTACT_CALLBACK", "CASE_SUMMARY_TRANSFER", "ACCOMMODATION_TRANSFER"]
    some = lambda: r.sample(scopes, r.randint(0, 3))
    out = [WEB | {"eventId": f"E{r.randrange(8)}", "consent": some()} for _ in range(12)]
    out += [{"eventId": f"R{r.randrange(9)}", "revokes": f"E{r.randrange(10)}", "scopes": some()} for _ in range(12)]
    r.shuffle(out)
    return out, r


@pytest.mark.parametrize("seed", range(3))
def test_views_equal_recomputing_after_any_split(spark, tmp_path, seed):
    path, (inbox, r) = str(tmp_path / "ledger"), random_inbox(seed)
    cuts = sorted(r.sample(range(len(inbox) + 1), 3))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(inbox)])):
        for _ in range(1 + k % 2):
            ingest(spark, lines(spark, *inbox[a:b]), path, "2024-01-01", f"{k}")
    accepted = split(outcomes(lines(spark, *inbox)))[0].cache()
    want = sorted((x.eventId, sorted(x.effective_consent)) for x in consent.effective(accepted).collect())
    assert sorted((x.eventId, x.effective_consent) for x in consent.effective_view(ledger.table(spark, path, ledger.CONSENT)).collect()) == want
    waiting = sorted((x.revokes, x.eventId) for x in consent.pending(accepted).collect())
    view = ledger.table(spark, path, ledger.PENDING)
    assert sorted((x.key, e) for x in view.where("resolved is null").collect() for e in x.revocations) == waiting
    assert sorted(map(str, ledger.read(spark, path).select("arrival", "outcome").collect())) == sorted(map(str, outcomes(lines(spark, *inbox)).select("arrival", "outcome").collect()))


def test_a_purge_brings_no_right_back(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ingest(spark, lines(spark, REVOCATION, HOTLINE), path, "2024-01-01", "0001")
    ingest(spark, lines(spark, WEB), path, "2024-01-02", "0002")
    assert ledger.purge(spark, path, "2024-01-02") == ["2024-01-01"] and ledger.purge(spark, path, "2024-01-02") == []
    view = {x.eventId: x.effective_consent for x in consent.effective_view(ledger.table(spark, path, ledger.CONSENT)).collect()}
    assert view == {"EV-W-001": ["ACCOMMODATION_TRANSFER"]}
    assert [r[0] for r in held(spark, path)] == ["EV-W-001"]
    with pytest.raises(manifest.Refused):
        ingest(spark, lines(spark, HOTLINE), path, "2024-01-01", "0003")
    ingest(spark, lines(spark, HOTLINE | {"callbackWindowMinutes": 60}), path, "2024-01-03", "0003")
    assert held(spark, path)[0][:2] == ("EV-H-001", "ACCEPTED")


def test_metrics_equal_a_second_scan(spark, tmp_path):
    path = str(tmp_path / "ledger")
    given = lines(spark, HOTLINE, HOTLINE, HOTLINE | {"callbackWindowMinutes": -1}, "x", "", WEB, PHYSICAL | {"accommodations": ["NOPE"], "channel": "FAX"}, REVOCATION)
    ingest(spark, given, path, "2024-01-01", "0001")
    rows = ledger.read(spark, path).collect()
    found = {r.metric: r.n for r in manifest.metrics(spark, path).collect()}
    assert found["rows"] == 8 and found["firsts"] == 4 and found["channel:other"] == 1
    for o in ("ACCEPTED", "REPLAY", "REJECTED"):
        assert found[f"outcome:{o}"] == sum(r.outcome == o for r in rows)
    assert {k[6:]: v for k, v in found.items() if k.startswith("error:") and v} == {e: sum(e in r.errors for r in rows) for e in {e for r in rows for e in r.errors}}
    assert all(found[f"channel:{c}"] == sum(r.channel == c for r in rows) for c in ("PHYSICAL", "HOTLINE", "WEB"))


def contents(folder):
    out = b""
    for top, _, names in os.walk(folder):
        for n in names:
            with open(os.path.join(top, n), "rb") as f:
                out += f.read()
    return out


def test_erasure_leaves_nothing_of_a_source(spark, tmp_path):
    path, person = str(tmp_path / "ledger"), WEB | {"eventId": "EV-SECRET", "submissionId": "S-ERASE", "applicant": "Mallory"}
    ingest(spark, lines(spark, HOTLINE, person), path, "2024-01-01", "0001")
    ingest(spark, lines(spark, WEB, {"eventId": "R1", "revokes": "EV-SECRET", "scopes": ["CASE_SUMMARY_TRANSFER"]}), path, "2024-01-01", "0002")
    ingest(spark, lines(spark, PHYSICAL), path, "2024-01-02", "0003")
    untouched = {n for n in files.names(spark, f"{path}/rows/ingest_date=2024-01-02")}
    assert ledger.erase(spark, path, "WEB", "S-ERASE", "2024-02-01") == {"rows": 2, "events": 2}
    assert held(spark, path) == [("EV-H-001", "ACCEPTED", "2024-01-01", "0001"), ("EV-P-001", "ACCEPTED", "2024-01-02", "0003"), ("EV-W-001", "ACCEPTED", "2024-01-01", "0002")]
    assert {n for n in files.names(spark, f"{path}/rows/ingest_date=2024-01-02")} == untouched
    assert not [w for w in (b"EV-SECRET", b"S-ERASE", b"Mallory") if w in contents(path)]
    assert ledger.erase(spark, path, "WEB", "S-ERASE", "2024-02-01") == {"rows": 0, "events": 0}
    ingest(spark, lines(spark, person, HOTLINE), path, "2024-02-02", "0004")
    late = ledger.read(spark, path).where("batch = '0004'").orderBy("arrival").collect()
    assert [(r.eventId, r.outcome, r.errors, r.raw is None) for r in late] == [(None, "REJECTED", ["ERASED_SOURCE"], True), ("EV-H-001", "REPLAY", [], False)]
    assert not [w for w in (b"EV-SECRET", b"S-ERASE", b"Mallory") if w in contents(path)]
    assert sorted(r.key for r in ledger.table(spark, path, ledger.IDS).collect()) == ["EV-H-001", "EV-P-001", "EV-W-001"]


def test_an_empty_ledger(spark, tmp_path):
    path = str(tmp_path / "none")
    assert ledger.read(spark, path).collect() == [] and ledger.table(spark, path, ledger.CONSENT).collect() == [] and ledger.purge(spark, path, "2024-01-01") == []
    ingest(spark, lines(spark), path, "2024-01-01", "0001")
    assert ledger.read(spark, path).collect() == [] and manifest.latest(spark, path).next == 0 and manifest.latest(spark, path).version == 0



def judged_plainly(inbox, claims):
    """Outcomes of (id, payload, own errors) in their order, by definition."""
    first, out = {}, []
    for e, payload, own in inbox:
        if e in first:
            out.append("REPLAY" if first[e] == payload else "REJECTED")
            continue
        if claims or not own:
            first[e] = payload
        out.append("REJECTED" if own else "ACCEPTED")
    return out


@pytest.mark.parametrize("claims", [True, False])
def test_both_readings_of_an_invalid_first_record(spark, tmp_path, claims):
    r, path = random.Random(7), str(tmp_path / "ledger")
    given = [(f"E{r.randrange(5)}", r.choice([10, 20, -1, -2])) for _ in range(40)]
    envelopes = [HOTLINE | {"eventId": e, "callbackWindowMinutes": m} for e, m in given]
    want = judged_plainly([(e, m, m < 0) for e, m in given], claims)
    assert [x.outcome for x in outcomes(lines(spark, *envelopes), invalid_claims=claims).orderBy("arrival").collect()] == want
    for k, (a, b) in enumerate(((0, 7), (7, 19), (19, 40))):
        ingest(spark, lines(spark, *envelopes[a:b]), path, "2024-01-01", f"{k}", invalid_claims=claims)
    assert [x.outcome for x in ledger.read(spark, path).orderBy("arrival").collect()] == want
    with pytest.raises(manifest.Refused):
        ingest(spark, lines(spark, HOTLINE), path, "2024-01-01", "other", invalid_claims=not claims)


def test_a_correction_is_linked_to_its_origin(spark, tmp_path):
    path, wrong = str(tmp_path / "ledger"), PHYSICAL | {"accommodations": ["NOPE"]}
    ingest(spark, lines(spark, wrong, "x", HOTLINE), path, "2024-01-01", "0001", invalid_claims=False)
    assert sorted((q.error, q.arrival, q.state) for q in ledger.quarantine(spark, path).collect()) == [("MALFORMED_ENVELOPE", 1, "open"), ("UNKNOWN_ACCOMMODATION", 0, "open")]
    fixes = lambda *e: spark.createDataFrame([(json.dumps(x), i, 0) for i, x in enumerate(e)], "raw string, arrival long, corrects long")
    ingest(spark, fixes(wrong | {"accommodations": ["STILL"]}), path, "2024-01-02", "0001", invalid_claims=False)
    assert {q.arrival: (q.state, q.corrected_by) for q in ledger.quarantine(spark, path).collect()} == {0: ("rejected", 3), 1: ("open", None), 3: ("open", None)}
    ingest(spark, fixes(PHYSICAL), path, "2024-01-03", "0001", invalid_claims=False)
    assert {q.arrival: (q.state, q.corrected_by) for q in ledger.quarantine(spark, path).collect()} == {0: ("accepted", 4), 1: ("open", None), 3: ("open", None)}
