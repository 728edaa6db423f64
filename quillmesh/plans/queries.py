"""The registered queries: each operator over the synthetic envelopes, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import canonical as C
from quillmesh.operators import consent as K
from quillmesh.operators.idempotency import firsts
from quillmesh.operators.validate import split
from quillmesh.plans import landing_queries, ledger_queries
from quillmesh.plans.intake import canonical, ingest, outcomes
from quillmesh.sources import ledger
from quillmesh.sources.inbox import read_inbox, stream_inbox
from quillmesh.sources.scratch import folder, written
from quillmesh.sources.synthetic import SQL, inbox, sent
from quillmesh.streaming.intake import start


def _list(c: str):
    return F.array_join(F.sort_array(F.col(c)), ",").alias(c)


def _canonical(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``columns`` of the canonical rows, written once: nothing is computed for others."""
    return written(canonical(inbox(spark, sf_dir)).select(*columns), "canonical")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(inbox(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows, read from outcomes that are written once, as from a ledger."""
    return split(written(_outcomes(spark, sf_dir), "outcomes"))[0]


_FIELDS = ["arrival", "eventId", "channel", "sourceId", "person"]


def _landed(lines: DataFrame, path: str) -> str:
    lines.select("raw").write.mode("append").text(path)
    return path


def envelope_scan(spark, sf_dir):
    """The lines land as text files and are read with arrival numbers from 0, without a gap."""
    path = _landed(inbox(spark, sf_dir), folder(spark, "landing"))
    return read_inbox(spark, path).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("arrival").alias("arrivals"))


def envelope_parse(spark, sf_dir):
    return _canonical(spark, sf_dir, "arrival", "eventId", "revokes", "well_formed", "accommodations", "consent", "scopes").select("arrival", "eventId", "revokes", F.col("well_formed"), _list("accommodations"), _list("consent"), _list("scopes"))


def _adapter(channel):
    def query(spark, sf_dir):
        return C.by_channel(_canonical(spark, sf_dir, *_FIELDS, "callbackWindowMinutes"), channel).select(*_FIELDS, F.col("callbackWindowMinutes").cast("string").alias("minutes"))

    return query


def canonical_merge(spark, sf_dir):
    return _canonical(spark, sf_dir, "canonicalVersion", "channel", "sourceId", "person", "callbackWindowMinutes").groupBy("canonicalVersion", "channel").agg(F.count(F.lit(1)).alias("n"), F.count("sourceId").alias("n_source"), F.count("person").alias("n_person"), F.sum("callbackWindowMinutes").cast("string").alias("minutes"))


def source_correlation(spark, sf_dir):
    return C.correlate(_canonical(spark, sf_dir, "arrival", "eventId", "channel", "sourceId"))


#: A source ID that stands for three events.
SOURCE = "S-7"


def source_lookup(spark, sf_dir):
    rows = _canonical(spark, sf_dir, "arrival", "eventId", "channel", "sourceId")
    found = C.of_source(rows, "PHYSICAL", SOURCE).unionAll(C.of_source(rows, "HOTLINE", SOURCE)).unionAll(C.of_source(rows, "WEB", SOURCE))
    return found.select("arrival", "eventId", "channel")


def _failing(error):
    def query(spark, sf_dir):
        return _canonical(spark, sf_dir, "arrival", "eventId", "errors").where(F.array_contains("errors", error)).select("arrival", "eventId")

    return query


def error_accumulation(spark, sf_dir):
    return _outcomes(spark, sf_dir).where(F.size("errors") > 0).select("arrival", F.array_join("errors", ",").alias("errors"))


def intake_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("channel", "outcome").agg(F.count(F.lit(1)).alias("n"))


def accept_reject_split(spark, sf_dir):
    """Ledger and quarantine: the parts of the split, each described by itself."""
    described = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"), F.sum(F.size("errors")).alias("errors")) for n, p in zip(("accepted", "replays", "rejected"), split(written(_outcomes(spark, sf_dir), "outcomes")))]
    return described[0].unionAll(described[1]).unionAll(described[2])


def idempotent_replay(spark, sf_dir):
    return split(_outcomes(spark, sf_dir))[1].select("arrival", "eventId")


def conflict_detection(spark, sf_dir):
    return _outcomes(spark, sf_dir).where(F.array_contains("errors", "EVENT_ID_CONFLICT")).select("arrival", "eventId")


def payload_fingerprint(spark, sf_dir):
    rows = _canonical(spark, sf_dir, "arrival", "eventId", "payload_fp").where("eventId is not null")
    same = rows.join(firsts(rows), F.col("eventId") == F.col("event")).withColumn("same", (F.col("payload_fp") == F.col("first.payload_fp")).cast("int"))
    return same.groupBy("eventId").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_same"))


def consent_grant(spark, sf_dir):
    return K.grants(_accepted(spark, sf_dir))


def consent_revocation(spark, sf_dir):
    return K.effective(_accepted(spark, sf_dir)).select("eventId", _list("effective_consent"))


def revocation_target(spark, sf_dir):
    return K.pending(_accepted(spark, sf_dir)).select("eventId", "revokes")


def consent_gated_projection(spark, sf_dir):
    rows = K.transferable(K.effective(_accepted(spark, sf_dir)))
    return rows.select("eventId", F.col("callbackWindowMinutes").cast("string").alias("minutes"), "sourceId", "person", _list("accommodations"))


def ledger_sink(spark, sf_dir):
    path, lines = folder(spark, "ledger"), sent(spark, sf_dir)
    for _ in range(2):  # a batch that is run again leaves one copy
        ingest(spark, lines, path, "2024-01-31", "0001")
    return ledger.read(spark, path).groupBy("ingest_date", "outcome").agg(F.count(F.lit(1)).alias("n"))


def resubmission(spark, sf_dir):
    """A second day sends every line of the first again: all event IDs are known by then."""
    path, lines = folder(spark, "ledger"), sent(spark, sf_dir)
    ingest(spark, lines, path, "2024-01-31", "0001")
    return ingest(spark, lines, path, "2024-02-01", "0001").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def stream_intake(spark, sf_dir):
    """First submissions come by a batch, what follows them by a stream over landed files; the ledger holds the outcomes of all."""
    path, landing, lines = folder(spark, "ledger"), folder(spark, "landing"), sent(spark, sf_dir)
    ingest(spark, lines.where("arrival % 10 = 0"), path, "2024-01-30", "0001")
    _landed(lines.where("arrival % 10 != 0"), landing)
    query = start(spark, stream_inbox(spark, landing), path, folder(spark, "checkpoint"), "2024-01-31").trigger(availableNow=True).start()
    query.awaitTermination()
    return ledger.read(spark, path).groupBy("ingest_date", "channel", "outcome").agg(F.count(F.lit(1)).alias("n"))


def retention(spark, sf_dir):
    path, lines = folder(spark, "ledger"), sent(spark, sf_dir)
    ingest(spark, lines.where("arrival % 2 = 0"), path, "2024-01-30", "0001")
    ingest(spark, lines.where("arrival % 2 = 1"), path, "2024-01-31", "0001")
    ledger.purge(spark, path, "2024-01-31")
    return ledger.read(spark, path).groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "intake_outcomes": intake_outcomes,
    "envelope_scan": envelope_scan,
    "envelope_parse": envelope_parse,
    "adapter_physical": _adapter("PHYSICAL"),
    "adapter_hotline": _adapter("HOTLINE"),
    "adapter_web": _adapter("WEB"),
    "canonical_merge": canonical_merge,
    "source_correlation": source_correlation,
    "source_lookup": source_lookup,
    "channel_domain_check": _failing("UNKNOWN_CHANNEL"),
    "source_id_check": _failing("MISSING_SOURCE_ID"),
    "accommodation_domain_check": _failing("UNKNOWN_ACCOMMODATION"),
    "consent_scope_domain_check": _failing("UNKNOWN_CONSENT_SCOPE"),
    "callback_range_check": _failing("NEGATIVE_CALLBACK_WINDOW"),
    "malformed_envelope_check": _failing("MALFORMED_ENVELOPE"),
    "error_accumulation": error_accumulation,
    "accept_reject_split": accept_reject_split,
    "idempotent_replay": idempotent_replay,
    "conflict_detection": conflict_detection,
    "payload_fingerprint": payload_fingerprint,
    "consent_grant": consent_grant,
    "consent_revocation": consent_revocation,
    "revocation_target_check": revocation_target,
    "consent_gated_projection": consent_gated_projection,
    "ledger_sink": ledger_sink,
    "resubmission": resubmission,
    "retention": retention,
    "stream_intake": stream_intake,
} | ledger_queries.QUERIES | landing_queries.QUERIES


def _csv(c: str, name: str | None = None) -> str:
    return f"array_to_string(list_sort({c}), ',') as {name or c}"


def _error(e: str) -> str:
    return SQL + f"select arrival, eventId from lines where list_contains(own, '{e}')"


def _channel(c: str) -> str:
    return SQL + f"select arrival, eventId, channel, sourceId, person, cast(minutes as varchar) as minutes from lines where channel = '{c}'"


_PARTS = "case outcome when 'ACCEPTED' then 'accepted' when 'REPLAY' then 'replays' else 'rejected' end"

ORACLES = {
    "intake_outcomes": SQL + "select channel, outcome, count(*) as n from outcomes group by all",
    "envelope_scan": SQL + "select count(*) as n_lines, cast(count(*) * (count(*) - 1) // 2 as bigint) as arrivals from lines",
    "envelope_parse": SQL + f"select arrival, eventId, revokes, not broken as well_formed, {_csv('accommodations')}, {_csv('consent')}, {_csv('scopes')} from lines",
    "adapter_physical": _channel("PHYSICAL"),
    "adapter_hotline": _channel("HOTLINE"),
    "adapter_web": _channel("WEB"),
    "canonical_merge": SQL + "select 'intake.v1' as canonicalVersion, channel, count(*) as n, count(sourceId) as n_source, count(person) as n_person, cast(sum(minutes) as varchar) as minutes from lines group by all",
    "source_correlation": SQL + "select channel, sourceId, count(*) as n_events, arg_min(eventId, arrival) as first_event, arg_max(eventId, arrival) as last_event from lines where channel is not null and sourceId is not null group by all",
    "source_lookup": SQL + f"select arrival, eventId, channel from lines where channel in ('PHYSICAL', 'HOTLINE', 'WEB') and sourceId = '{SOURCE}'",
    "channel_domain_check": _error("UNKNOWN_CHANNEL"),
    "source_id_check": _error("MISSING_SOURCE_ID"),
    "accommodation_domain_check": _error("UNKNOWN_ACCOMMODATION"),
    "consent_scope_domain_check": _error("UNKNOWN_CONSENT_SCOPE"),
    "callback_range_check": _error("NEGATIVE_CALLBACK_WINDOW"),
    "malformed_envelope_check": _error("MALFORMED_ENVELOPE"),
    "error_accumulation": SQL + "select arrival, array_to_string(errors, ',') as errors from outcomes where len(errors) > 0",
    "accept_reject_split": SQL + f"select {_PARTS} as part, count(*) as n, min(arrival) as first, max(arrival) as last, cast(sum(len(errors)) as bigint) as errors from outcomes group by all",
    "idempotent_replay": SQL + "select arrival, eventId from outcomes where outcome = 'REPLAY'",
    "conflict_detection": SQL + "select arrival, eventId from outcomes where list_contains(errors, 'EVENT_ID_CONFLICT')",
    "payload_fingerprint": SQL + "select eventId, count(*) as n, count(*) filter (payload = p0) as n_same from placed where eventId is not null group by all",
    "consent_grant": SQL + "select eventId, unnest(consent) as scope from accepted where revokes is null and consent is not null",
    "consent_revocation": SQL + f"select eventId, {_csv('eff', 'effective_consent')} from effective",
    "revocation_target_check": SQL + "select eventId, revokes from accepted a where revokes is not null and not exists (select 1 from accepted b where b.revokes is null and b.eventId = a.revokes)",
    "consent_gated_projection": SQL
    + "select eventId, case when list_contains(eff, 'CONTACT_CALLBACK') then cast(minutes as varchar) end as minutes, case when list_contains(eff, 'CASE_SUMMARY_TRANSFER') then sourceId end as sourceId, case when list_contains(eff, 'CASE_SUMMARY_TRANSFER') then person end as person, "
    + "case when list_contains(eff, 'ACCOMMODATION_TRANSFER') then array_to_string(list_sort(accommodations), ',') end as accommodations from effective",
    "ledger_sink": SQL + "select '2024-01-31' as ingest_date, outcome, count(*) as n from outcomes group by all",
    "resubmission": SQL + "select case when eventId is null then 'REJECTED' when payload = p0 then 'REPLAY' else 'REJECTED' end as outcome, count(*) as n from placed group by all",
    "stream_intake": SQL + "select case when arrival % 10 = 0 then '2024-01-30' else '2024-01-31' end as ingest_date, channel, outcome, count(*) as n from outcomes group by all",
    "retention": SQL + "select '2024-01-31' as ingest_date, count(*) as n from outcomes where arrival % 2 = 1",
} | ledger_queries.ORACLES | landing_queries.ORACLES
