"""The contract's examples, revocation and invalid cases, and the shapes that input can take."""

import hashlib
import json
import random

import pytest

from quillmesh import contract
from quillmesh.operators import consent
from quillmesh.operators.validate import split
from quillmesh.plans.intake import outcomes
from quillmesh.sources import registry

PHYSICAL = {"eventId": "EV-P-001", "channel": "PHYSICAL", "deskReceiptNo": "D-88", "accommodations": ["BRAILLE_MATERIAL"]}
HOTLINE = {"eventId": "EV-H-001", "channel": "HOTLINE", "callRef": "C-19", "callbackWindowMinutes": 45, "consent": ["CONTACT_CALLBACK"]}
WEB = {"eventId": "EV-W-001", "channel": "WEB", "submissionId": "W-71", "consent": ["CASE_SUMMARY_TRANSFER", "ACCOMMODATION_TRANSFER"]}
REVOCATION = {"eventId": "EV-W-002", "revokes": "EV-W-001", "scopes": ["CASE_SUMMARY_TRANSFER"]}


def inbox(spark, *lines):
    rows = [(x if isinstance(x, str) or x is None else json.dumps(x), i) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "raw string, arrival long")


def judged(spark, *lines):
    return [(r.outcome, r.errors) for r in outcomes(inbox(spark, *lines)).orderBy("arrival").collect()]


def test_names():
    assert contract.CANONICAL_VERSION == "intake.v1"
    assert set(contract.ACCOMMODATION_CODES) == {"BRAILLE_MATERIAL", "SIGN_INTERPRETER", "TEXT_ONLY", "STEP_FREE_ACCESS"}
    assert set(contract.CONSENT_SCOPES) == {"CONTACT_CALLBACK", "CASE_SUMMARY_TRANSFER", "ACCOMMODATION_TRANSFER"}
    assert contract.CHANNELS == {"PHYSICAL": ("deskReceiptNo", "visitor", None), "HOTLINE": ("callRef", "caller", "callbackWindowMinutes"), "WEB": ("submissionId", "applicant", None)}


def test_examples(spark):
    rows = outcomes(inbox(spark, PHYSICAL, HOTLINE, WEB)).orderBy("arrival").collect()
    assert [r.outcome for r in rows] == ["ACCEPTED"] * 3 and all(r.errors == [] for r in rows)
    assert [r.sourceId for r in rows] == ["D-88", "C-19", "W-71"]
    assert [r.callbackWindowMinutes for r in rows] == [None, 45, None]
    assert {r.canonicalVersion for r in rows} == {"intake.v1"}


def test_invalid_cases(spark):
    cases = [HOTLINE | {"eventId": "A", "callbackWindowMinutes": -1}, PHYSICAL | {"eventId": "B", "accommodations": ["NOPE"]}, HOTLINE, HOTLINE | {"callbackWindowMinutes": 60}]
    assert judged(spark, *cases) == [("REJECTED", ["NEGATIVE_CALLBACK_WINDOW"]), ("REJECTED", ["UNKNOWN_ACCOMMODATION"]), ("ACCEPTED", []), ("REJECTED", ["EVENT_ID_CONFLICT"])]


def test_replay_with_other_key_order(spark):
    turned = dict(reversed(HOTLINE.items()))
    assert judged(spark, HOTLINE, turned, json.dumps(HOTLINE, indent=None, separators=(" , ", " : "))) == [("ACCEPTED", []), ("REPLAY", []), ("REPLAY", [])]


@pytest.mark.parametrize(
    "line, errors",
    [
        ("not json", ["MALFORMED_ENVELOPE"]),
        ("", ["MALFORMED_ENVELOPE"]),
        (None, ["MALFORMED_ENVELOPE"]),
        ("[1]", ["MALFORMED_ENVELOPE"]),
        ('{"eventId": "X", "eventId": "Y"}', ["MALFORMED_ENVELOPE"]),
        ({}, ["MISSING_EVENT_ID", "UNKNOWN_CHANNEL"]),
        (WEB | {"eventId": 7}, ["MISSING_EVENT_ID", "MALFORMED_FIELD"]),
        (WEB | {"channel": "web"}, ["UNKNOWN_CHANNEL"]),
        (WEB | {"submissionId": None}, ["MISSING_SOURCE_ID"]),
        (HOTLINE | {"callbackWindowMinutes": "45"}, ["MALFORMED_FIELD"]),
        (HOTLINE | {"callbackWindowMinutes": 45.5}, ["MALFORMED_FIELD"]),
        (HOTLINE | {"callbackWindowMinutes": True}, ["MALFORMED_FIELD"]),
        (HOTLINE | {"callbackWindowMinutes": 2**31}, ["MALFORMED_FIELD"]),
        (HOTLINE | {"callbackWindowMinutes": None}, []),
        (HOTLINE | {"callbackWindowMinutes": 0}, []),
        (WEB | {"callbackWindowMinutes": -5}, ["NEGATIVE_CALLBACK_WINDOW"]),
        (PHYSICAL | {"accommodations": "TEXT_ONLY"}, ["MALFORMED_FIELD"]),
        (PHYSICAL | {"accommodations": []}, []),
        (PHYSICAL | {"accommodations": ["TEXT_ONLY", "TEXT_ONLY"]}, []),
        (WEB | {"consent": ["EVERYTHING"]}, ["UNKNOWN_CONSENT_SCOPE"]),
        (REVOCATION | {"scopes": ["EVERYTHING"]}, ["UNKNOWN_CONSENT_SCOPE"]),
        (REVOCATION, []),
        (WEB | {"extra": {"a": [1]}}, []),
        (HOTLINE | {"callbackWindowMinutes": -1, "accommodations": ["NOPE"], "callRef": ""}, ["MISSING_SOURCE_ID", "UNKNOWN_ACCOMMODATION", "NEGATIVE_CALLBACK_WINDOW"]),
    ],
)
def test_shapes(spark, line, errors):
    assert judged(spark, line) == [("REJECTED" if errors else "ACCEPTED", errors)]


def fingerprints(spark, *texts):
    rows = outcomes(inbox(spark, *texts)).orderBy("arrival").collect()
    return [r.payload_fp for r in rows]


@pytest.mark.parametrize(
    "same",
    [
        ["1", "1.0", "1e0", "100e-2", "0.1E+1", "10e-1"],
        ["0", "-0", "0.00", "0e5", "0E-9"],
        ["-12.50", "-1250e-2", "-0.125e2"],
        ["1e400", "10e399", "0.1e401"],
        ["123456789012345678901234567890.1", "1234567890123456789012345678901e-1"],
        ["[1, 2.0]", "[1.0,2]"],
        ['{"b": 1.0, "a": "x"}', '{"a":"\\u0078","b":1}'],
    ],
)
def test_equal_numbers_are_one_payload(spark, same):
    assert len(set(fingerprints(spark, *(f'{{"eventId": "E", "n": {v}}}' for v in same)))) == 1


def test_different_payloads_differ(spark):
    values = ["1", '"1"', '"n1e0"', '"s1"', "10", "1.00000000000000000001", "-1", "[1]", "null", "true", '"true"', '{"1": 1}', '"a\\"b"', '"a"', "12345678901234567890", "12345678901234567891", "[1,2]", "[2,1]", "[12]", '"1,2"', '""', '" "']
    texts = [f'{{"eventId": "E", "n": {v}}}' for v in values] + ['{"eventId": "E"}', '{"eventId": "E", "sn": 1}']
    assert len(set(fingerprints(spark, *texts))) == len(texts)


def test_digest_of_a_payload(spark):
    want = '{"scallRef":"sC-19","scallbackWindowMinutes":"n45e0","schannel":"sHOTLINE","sconsent":["sCONTACT_CALLBACK"],"seventId":"sEV-H-001"}'
    assert fingerprints(spark, HOTLINE, " not json ") == [hashlib.sha256(want.encode()).hexdigest(), hashlib.sha256(b"not json").hexdigest()]


def test_a_channel_is_a_row(spark):
    rows = [(c, *f) for c, f in contract.CHANNELS.items()] + [("POST", "letterNo", "sender", "callbackWindow")]
    channels = registry.read(spark.createDataFrame(rows, "channel string, sourceIdField string, personField string, callbackWindowField string"))
    letter = {"eventId": "L1", "channel": "POST", "letterNo": "L-5", "sender": {"name": "X"}, "callbackWindow": 20, "callRef": 7}
    found = {r.eventId: r for r in outcomes(inbox(spark, letter, letter | {"eventId": "L2", "callbackWindow": -1}, letter | {"eventId": "L3", "letterNo": 5}, HOTLINE), channels=channels).collect()}
    assert (found["L1"].sourceId, found["L1"].person, found["L1"].callbackWindowMinutes, found["L1"].outcome) == ("L-5", '{"name":"X"}', 20, "ACCEPTED")
    assert found["L2"].errors == ["NEGATIVE_CALLBACK_WINDOW"] and found["L3"].errors == ["MISSING_SOURCE_ID", "MALFORMED_FIELD"]
    assert found["EV-H-001"].callbackWindowMinutes == 45
    assert judged(spark, letter) == [("REJECTED", ["UNKNOWN_CHANNEL"])]
    for bad in ([("A", None, "p", None)], [("A", "s", "p", None), ("A", "t", "p", None)], [(None, "s", "p", None)]):
        with pytest.raises(ValueError):
            registry.read(spark.createDataFrame(bad, "channel string, sourceIdField string, personField string, callbackWindowField string"))


def test_rows_without_event_id_are_no_replays(spark):
    assert judged(spark, "x", "x", {}, {}) == [("REJECTED", ["MALFORMED_ENVELOPE"])] * 2 + [("REJECTED", ["MISSING_EVENT_ID", "UNKNOWN_CHANNEL"])] * 2


def test_person_is_kept(spark):
    row = outcomes(inbox(spark, WEB | {"applicant": {"b": 1, "a": "é"}, "visitor": "other"})).first()
    assert json.loads(row.person) == {"a": "é", "b": 1}


def test_consent_in_any_order(spark):
    lines = [WEB, REVOCATION, {"eventId": "EV-W-003", "revokes": "EV-W-001", "scopes": ["CONTACT_CALLBACK"]}, HOTLINE, {"eventId": "R", "revokes": "NONE", "scopes": ["CONTACT_CALLBACK"]}]
    for seed in range(3):
        random.Random(seed).shuffle(lines)
        accepted = split(outcomes(inbox(spark, *lines)))[0]
        effective = {r.eventId: r.effective_consent for r in consent.effective(accepted).collect()}
        assert effective == {"EV-W-001": ["ACCOMMODATION_TRANSFER"], "EV-H-001": ["CONTACT_CALLBACK"]}
        assert [r.revokes for r in consent.pending(accepted).collect()] == ["NONE"]


def test_transfer_is_gated(spark):
    with_consent = PHYSICAL | {"eventId": "E2", "consent": ["ACCOMMODATION_TRANSFER"]}
    accepted = split(outcomes(inbox(spark, PHYSICAL, with_consent, HOTLINE)))[0]
    rows = {r.eventId: r for r in consent.transferable(consent.effective(accepted)).collect()}
    assert rows["EV-P-001"].accommodations is None and rows["E2"].accommodations == ["BRAILLE_MATERIAL"]
    assert rows["EV-H-001"].callbackWindowMinutes == 45 and rows["EV-H-001"].sourceId is None


def test_every_row_has_one_outcome(spark):
    r = random.Random(5)
    lines = [r.choice([PHYSICAL, HOTLINE, WEB, REVOCATION, HOTLINE | {"callbackWindowMinutes": r.randrange(3)}, "x"]) for _ in range(60)]
    parts = split(outcomes(inbox(spark, *lines)))
    assert sum(p.count() for p in parts) == 60
    assert parts[0].groupBy("eventId").count().where("count > 1").isEmpty()


def test_replaying_a_prefix_changes_nothing(spark):
    lines = [PHYSICAL, HOTLINE, HOTLINE | {"callbackWindowMinutes": 60}, WEB]
    once = judged(spark, *lines)
    twice = judged(spark, *lines, *lines[:2])
    assert twice[:4] == once and {o for o, _ in twice[4:]} == {"REPLAY"}


def test_empty_inbox(spark):
    assert judged(spark) == []
