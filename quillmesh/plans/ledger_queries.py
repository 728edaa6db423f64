"""The registered queries over a ledger of three batches: revocations of odd events, then all requests, then the other revocations."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmesh.contract import CHANNELS
from quillmesh.operators import consent as K
from quillmesh.plans.intake import canonical, ingest, outcomes
from quillmesh.sources import ledger, manifest, registry
from quillmesh.sources.scratch import folder
from quillmesh.sources.synthetic import SQL, inbox, sent

#: Which synthetic lines make up each batch, and its date. The second batch is run twice.
BATCHES = {"0001": ("arrival % 10 = 3 and arrival div 10 % 2 = 1", "2024-01-30"), "1e3": ("arrival % 10 != 3", "2024-01-30"), "null": ("arrival % 10 = 3 and arrival div 10 % 2 = 0", "2024-01-31")}


def _ledger(spark: SparkSession, sf_dir: str) -> str:
    path, lines = folder(spark, "ledger"), sent(spark, sf_dir)
    for name in ("0001", "1e3", "1e3", "null"):
        which, date = BATCHES[name]
        ingest(spark, lines.where(which), path, date, name)
    return path


def batch_manifest(spark, sf_dir):
    """What was committed, with the numbers of rows and whether their arrivals follow each other without overlap."""
    path = _ledger(spark, sf_dir)
    rows = ledger.read(spark, path).groupBy("batch").agg(F.count(F.lit(1)).alias("n_read"), F.min("arrival").alias("low"), F.max("arrival").alias("high"))
    commits = manifest.entries(spark, path).where("kind = 'batch'").join(rows, "batch")
    return commits.select("ingest_date", "batch", F.col("n_rows").alias("n_committed"), "n_read", ((F.col("first") <= F.col("low")) & (F.col("high") < F.col("next"))).alias("within"))


def ingest_metrics(spark, sf_dir):
    """What each batch counted while it was written."""
    found = manifest.metrics(spark, _ledger(spark, sf_dir))
    return found.where("n > 0 and (metric like 'outcome:%' or metric like 'error:%' or metric = 'firsts')").select("batch", "metric", "n")


def seen_ids(spark, sf_dir):
    """The table of event IDs: each with the date of the batch that first had it."""
    return ledger.table(spark, _ledger(spark, sf_dir), ledger.IDS).select(F.col("key").alias("eventId"), "ingest_date")


def seen_id_lookup(spark, sf_dir):
    """A few event IDs of each kind by value, and all of those that end in 7 by a join: first payloads, as the ledger's rows have them."""
    path = _ledger(spark, sf_dir)
    state = manifest.latest(spark, path)
    some = spark.createDataFrame([(f"EV-{k}",) for k in range(40)] + [("RV-1",), ("RV-8",), ("none",)], "key string")
    many = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 10 = 7").select(F.concat(F.lit("EV-"), F.col("event_id")).alias("key"))
    found = ledger.find(spark, path, state, ledger.IDS, some, 43).select("key", F.lit("value").alias("how")).unionAll(ledger.find(spark, path, state, ledger.IDS, many, 1 << 40).select("key", F.lit("join").alias("how")))
    return found.select(F.col("key").alias("eventId"), "how")


def incremental_consent(spark, sf_dir):
    """Effective consent from the table that each batch has added to."""
    view = K.effective_view(ledger.table(spark, _ledger(spark, sf_dir), ledger.CONSENT))
    return view.select("eventId", F.array_join("effective_consent", ",").alias("effective_consent"))


def pending_revocations(spark, sf_dir):
    """Revocations that had to wait, and whether their request has come."""
    rows = ledger.table(spark, _ledger(spark, sf_dir), ledger.PENDING)
    return rows.select(F.explode("revocations").alias("eventId"), F.col("key").alias("revokes"), F.when(F.col("resolved").isNull(), "pending").otherwise("resolved").alias("state"))


#: The source that is erased, of every channel.
ERASED = "S-11"


def erasure(spark, sf_dir):
    """One source is erased on every channel; then its first day is sent again, as another batch."""
    path, lines = _ledger(spark, sf_dir), inbox(spark, sf_dir)
    for channel in ("PHYSICAL", "HOTLINE", "WEB"):
        ledger.erase(spark, path, channel, ERASED, "2024-02-01")
    own = canonical(lines).where(F.col("sourceId") == ERASED).select("raw", "arrival")
    ingest(spark, own, path, "2024-02-02", "again")
    return ledger.read(spark, path).groupBy("batch", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sourceId") == ERASED).alias("n_own"), F.count_if(F.array_contains("errors", "ERASED_SOURCE")).alias("n_refused"))


def invalid_first_frees(spark, sf_dir):
    """Outcomes where an invalid first record does not claim its event ID."""
    return outcomes(inbox(spark, sf_dir), invalid_claims=False).groupBy("channel", "outcome", F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def _quarantine(claims: bool):
    def query(spark, sf_dir):
        """Lines that were rejected for an accommodation code are corrected and sent again; what the quarantine says of each afterwards."""
        path = folder(spark, "ledger")
        ingest(spark, inbox(spark, sf_dir), path, "2024-01-31", "0001", invalid_claims=claims)
        wrong = ledger.quarantine(spark, path).where("error = 'UNKNOWN_ACCOMMODATION'")
        fixed = wrong.select(F.replace("raw", F.lit("NOT_A_CODE"), F.lit("TEXT_ONLY")).alias("raw"), "arrival", F.col("arrival").alias("corrects"))
        ingest(spark, fixed, path, "2024-02-01", "0001", invalid_claims=claims)
        return ledger.quarantine(spark, path).groupBy("ingest_date", "error", "state").agg(F.count(F.lit(1)).alias("n"), F.count("corrected_by").alias("n_corrected"))

    return query


def payload_digest(spark, sf_dir):
    """The digest of each line's payload itself."""
    return canonical(inbox(spark, sf_dir)).select("arrival", "payload_fp")


def channel_registry(spark, sf_dir):
    """Adapters from a registry table with a fourth channel, whose lines are those of event IDs that end in 7 with their channel and fields renamed."""
    rows = [(c, *f) for c, f in CHANNELS.items()] + [("POST", "letterNo", "sender", None)]
    channels = registry.read(spark.createDataFrame(rows, "channel string, sourceIdField string, personField string, callbackWindowField string"))
    own = F.col("arrival") % 100 >= 70
    renamed = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", '"channel":"WEB"', '"channel":"POST"'), '"submissionId":', '"letterNo":'), '"applicant":', '"sender":')
    lines = inbox(spark, sf_dir).withColumn("raw", F.when(own & (F.col("arrival") % 100 < 80), renamed).otherwise(F.col("raw")))
    return canonical(lines, channels).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count("sourceId").alias("n_source"), F.count("person").alias("n_person"), F.count("callbackWindowMinutes").alias("n_window"), F.sum(F.size("errors")).alias("n_errors"))


QUERIES = {"quarantine": _quarantine(True), "quarantine_freed": _quarantine(False)} | {f.__name__: f for f in (batch_manifest, ingest_metrics, seen_ids, seen_id_lookup, incremental_consent, pending_revocations, erasure, invalid_first_frees, payload_digest, channel_registry)}

_BATCH = "case when arrival % 10 <> 3 then '1e3' when arrival // 10 % 2 = 1 then '0001' else 'null' end"
_DATE = "case when arrival % 10 = 3 and arrival // 10 % 2 = 0 then '2024-01-31' else '2024-01-30' end"
_GONE = f"select eventId from lines where sourceId = '{ERASED}' and channel in ('PHYSICAL', 'HOTLINE', 'WEB')"

#: Outcomes if the first valid payload stands.
_FREED = """, valid as (select eventId, arg_min(payload, arrival) as v0, min(arrival) as begun from lines where len(own) = 0 and eventId is not null group by eventId),
freed as (select l.*, case when l.arrival > begun and payload <> v0 then list_append(own, 'EVENT_ID_CONFLICT') else own end as errors,
  case when l.arrival > begun and payload = v0 then 'REPLAY' when l.arrival > begun or len(own) > 0 then 'REJECTED' else 'ACCEPTED' end as outcome from lines l left join valid v on l.eventId = v.eventId)"""


def _fixed(judged: str, stands: str) -> str:
    """The quarantine after corrections: ``judged`` rows of the first day, ``stands`` (eventId, p0) what stands for an ID by then."""
    return f""", wrong as (select *, list_filter(own, lambda e: e <> 'UNKNOWN_ACCOMMODATION') as own2, replace(payload, 'NOT_A_CODE', 'TEXT_ONLY') as p2 from {judged} where outcome = 'REJECTED' and list_contains(errors, 'UNKNOWN_ACCOMMODATION')),
stands as ({stands}),
again as (select w.*, s.p0 as known, case when len(own2) = 0 then min(case when len(own2) = 0 then w.arrival end) over (partition by w.eventId) end as first_fix from wrong w left join stands s on w.eventId = s.eventId),
fixed as (select arrival, case when known is not null and p2 <> known then list_append(own2, 'EVENT_ID_CONFLICT') else own2 end as errors,
  case when known is not null and p2 = known then 'REPLAY' when known is not null or len(own2) > 0 then 'REJECTED' when first_fix < arrival then 'REPLAY' else 'ACCEPTED' end as outcome from again),
day1 as (select j.arrival, unnest(j.errors) as error, coalesce(lower(f.outcome), 'open') as state, f.arrival as fix from {judged} j left join fixed f on f.arrival = j.arrival where j.outcome = 'REJECTED'),
day2 as (select arrival, unnest(errors) as error from fixed where outcome = 'REJECTED')
select '2024-01-31' as ingest_date, error, state, count(*) as n, count(fix) as n_corrected from day1 group by all union all select '2024-02-01', error, 'open', count(*), 0 from day2 group by all"""


#: Canonical JSON of each line: sorted keys, an s before strings, numbers as digits and a power of ten.
_LIST = lambda c: f"'[' || array_to_string(list_transform({c}, lambda x: '\"s' || x || '\"'), ',') || ']'"
_DIGEST = f""", j as (select *, event_id, case when k = 0 then '0' when k % 10 = 0 then (k // 10) || 'e1' else k || 'e0' end as kn from (select s.*, s.arrival as ar from sent s)),
bodies as (select ar as arrival, case when event_id % 101 = 5 and ar % 10 = 0 then 'not json ' || event_id else '{{' || concat_ws(',',
  '"saccommodations":' || {_LIST("sent_acc")}, case when channel = 'WEB' then '"sapplicant":{{"sname":"sU' || user_id || '"}}' end, case when channel = 'HOTLINE' then '"scallRef":"s' || sid || '"' end,
  case when user_id % 3 = 1 and channel <> 'FAX' then '"scallbackWindowMinutes":"n' || kn || '"' end, case when channel = 'HOTLINE' then '"scaller":{{"sname":"sU' || user_id || '"}}' end, '"schannel":"s' || channel || '"',
  '"sconsent":' || {_LIST("con")}, case when channel = 'PHYSICAL' then '"sdeskReceiptNo":"s' || sid || '"' end, '"seventId":"s' || id || '"', case when channel = 'WEB' then '"ssubmissionId":"s' || sid || '"' end,
  case when channel = 'PHYSICAL' then '"svisitor":{{"sname":"sU' || user_id || '"}}' end) || '}}' end as body from j
  union all select arrival, '{{"seventId":"s' || eventId || '","srevokes":"s' || revokes || '","sscopes":' || {_LIST("scopes")} || '}}' from revoked)
select arrival, sha256(body) as payload_fp from bodies"""
_WEB7 = "case when channel = 'WEB' and arrival % 100 >= 70 and arrival % 100 < 80 then 'POST' else channel end"

ORACLES = {
    "invalid_first_frees": SQL + _FREED + " select channel, outcome, array_to_string(errors, ',') as errors, count(*) as n from freed group by all",
    "quarantine": SQL + _fixed("outcomes", "select eventId, any_value(p0) as p0 from placed where eventId is not null group by eventId"),
    "quarantine_freed": SQL + _FREED + _fixed("freed", "select eventId, v0 as p0 from valid"),
    "payload_digest": SQL + _DIGEST,
    "channel_registry": SQL + f"select {_WEB7} as channel, count(*) as n, count(sourceId) as n_source, count(person) as n_person, count(minutes) as n_window, cast(sum(len(own)) as bigint) as n_errors from lines group by all",
    "batch_manifest": SQL + f"select {_DATE} as ingest_date, {_BATCH} as batch, count(*) as n_committed, count(*) as n_read, true as within from outcomes group by all",
    "ingest_metrics": SQL + f", b as (select *, {_BATCH} as batch from outcomes) select batch, 'outcome:' || outcome as metric, count(*) as n from b group by all "
    "union all select batch, 'error:' || e, count(*) from (select batch, unnest(errors) as e from b) group by all union all select batch, 'firsts', count(distinct eventId) from b group by all having count(distinct eventId) > 0",
    "seen_ids": SQL + f"select distinct eventId, {_DATE} as ingest_date from outcomes where eventId is not null",
    "seen_id_lookup": SQL + "select distinct eventId, 'value' as how from outcomes where eventId in ('RV-1', 'RV-8') or (eventId like 'EV-%' and try_cast(substr(eventId, 4) as int) < 40) "
    "union all select distinct eventId, 'join' from outcomes where eventId like 'EV-%7'",
    "incremental_consent": SQL + "select eventId, array_to_string(list_sort(eff), ',') as effective_consent from effective",
    "pending_revocations": SQL + "select a.eventId, a.revokes, case when b.eventId is null then 'pending' else 'resolved' end as state from accepted a left join (select eventId from accepted where revokes is null) b on b.eventId = a.revokes "
    "where a.revokes is not null and (b.eventId is null or a.arrival // 10 % 2 = 1)",
    "erasure": SQL + f""", gone as ({_GONE}),
left_ as (select {_BATCH} as batch, outcome, false as refused from outcomes where coalesce(sourceId, '') <> '{ERASED}' and coalesce(revokes, '') not in (select eventId from gone)),
again as (select 'again' as batch, 'REJECTED' as outcome, true as refused from lines where sourceId = '{ERASED}')
select batch, outcome, count(*) as n, cast(0 as bigint) as n_own, count(*) filter (refused) as n_refused from (select * from left_ union all select * from again) group by all""",
}
