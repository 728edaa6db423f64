"""Synthetic envelopes from the table ``events``, for the registered queries and the bench.

They aren't intake data: they give each operator every case it tells apart, by arithmetic that
``SQL`` repeats over plain columns. An event gives one envelope; some are sent again, some with other
content, some are revoked, and some lines are no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.scratch import spread, written

_CODES = "array('BRAILLE_MATERIAL', 'SIGN_INTERPRETER', 'TEXT_ONLY', 'STEP_FREE_ACCESS', 'NOT_A_CODE')"


def _envelope(accommodations: str, turned: bool = False) -> str:
    fields = [
        "'eventId', id",
        "'channel', channel",
        "'deskReceiptNo', if(channel = 'PHYSICAL', sid, null)",
        "'callRef', if(channel = 'HOTLINE', sid, null)",
        "'submissionId', if(channel = 'WEB', sid, null)",
        "'visitor', if(channel = 'PHYSICAL', person, null)",
        "'caller', if(channel = 'HOTLINE', person, null)",
        "'applicant', if(channel = 'WEB', person, null)",
        "'callbackWindowMinutes', minutes",
        f"'accommodations', {accommodations}",
        "'consent', consent",
    ]
    return f"to_json(named_struct({', '.join(reversed(fields) if turned else fields)}))"


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw, arrival) of the synthetic lines."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    base = events.selectExpr(
        "event_id",
        "concat('EV-', event_id) as id",
        "case when event_id % 97 = 0 then 'FAX' when user_id % 3 = 0 then 'PHYSICAL' when user_id % 3 = 1 then 'HOTLINE' else 'WEB' end as channel",
        "if(event_id % 89 = 0, null, concat('S-', event_id div 3)) as sid",
        "named_struct('name', concat('U', user_id)) as person",
        "if(user_id % 3 = 1 and event_id % 97 != 0, k - 5, null) as minutes",
        f"if(event_id % 6 = 5, null, array(get({_CODES}, cast(event_id % 6 as int)))) as accommodations",
        "case event_id % 4 when 1 then array('CONTACT_CALLBACK') when 2 then array('CASE_SUMMARY_TRANSFER', 'ACCOMMODATION_TRANSFER') "
        "when 3 then if(event_id % 12 = 3, array('ACCOMMODATION_TRANSFER', 'NOT_A_SCOPE'), array('ACCOMMODATION_TRANSFER', 'CONTACT_CALLBACK')) end as consent",
    )
    lines = F.array(
        F.expr(f"named_struct('raw', if(event_id % 101 = 5, concat('not json ', event_id), {_envelope('accommodations')}), 'arrival', event_id * 10)"),
        F.expr(f"if(event_id % 10 = 0, named_struct('raw', {_envelope('accommodations', True)}, 'arrival', event_id * 10 + 1), null)"),
        F.expr(f"""if(event_id % 25 = 0, named_struct('raw', {_envelope("array('TEXT_ONLY')")}, 'arrival', event_id * 10 + 2), null)"""),
        F.expr(
            "if(event_id % 7 = 1, named_struct('raw', to_json(named_struct('eventId', concat('RV-', event_id), 'revokes', concat(if(event_id % 70 = 1, 'EV-x', 'EV-'), event_id), "
            "'scopes', if(event_id % 14 = 1, array('ACCOMMODATION_TRANSFER'), array('CASE_SUMMARY_TRANSFER', 'CONTACT_CALLBACK')))), 'arrival', event_id * 10 + 3), null)"
        ),
    )
    return base.select(F.explode(lines).alias("l")).where("l is not null").select("l.raw", "l.arrival")


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inbox`` written once, for what reads its lines several times, as batches read what has landed."""
    return written(inbox(spark, sf_dir), "lines")


#: The same lines, read as they should be, as common table expressions: lines, with all of their own errors, and outcomes.
SQL = """
with base as (select event_id, concat('EV-', event_id) as id, user_id,
    case when event_id % 97 = 0 then 'FAX' when user_id % 3 = 0 then 'PHYSICAL' when user_id % 3 = 1 then 'HOTLINE' else 'WEB' end as channel,
    case when event_id % 89 <> 0 then concat('S-', event_id // 3) end as sid, cast(json_extract_string(props, '$.k') as int) - 5 as k,
    case event_id % 6 when 0 then ['BRAILLE_MATERIAL'] when 1 then ['SIGN_INTERPRETER'] when 2 then ['TEXT_ONLY'] when 3 then ['STEP_FREE_ACCESS'] when 4 then ['NOT_A_CODE'] end as acc,
    case event_id % 4 when 1 then ['CONTACT_CALLBACK'] when 2 then ['CASE_SUMMARY_TRANSFER', 'ACCOMMODATION_TRANSFER']
      when 3 then case when event_id % 12 = 3 then ['ACCOMMODATION_TRANSFER', 'NOT_A_SCOPE'] else ['ACCOMMODATION_TRANSFER', 'CONTACT_CALLBACK'] end end as con from events),
sent as (select *, event_id * 10 as arrival, acc as sent_acc from base
  union all select *, event_id * 10 + 1, acc from base where event_id % 10 = 0
  union all select *, event_id * 10 + 2, ['TEXT_ONLY'] from base where event_id % 25 = 0),
requests as (select arrival, id as eventId, channel, case when channel <> 'FAX' then sid end as sourceId,
    case when channel <> 'FAX' then concat('{"name":"U', user_id, '"}') end as person,
    case when channel = 'HOTLINE' then k end as minutes, sent_acc as accommodations, con as consent,
    cast(null as varchar) as revokes, cast(null as varchar[]) as scopes, event_id % 101 = 5 and arrival % 10 = 0 as broken,
    concat_ws('|', channel, coalesce(cast(case when user_id % 3 = 1 and channel <> 'FAX' then k end as varchar), '~'), coalesce(sent_acc[1], '~')) as payload from sent),
revoked as (select event_id * 10 + 3 as arrival, concat('RV-', event_id) as eventId, cast(null as varchar) as channel, cast(null as varchar) as sourceId,
    cast(null as varchar) as person, cast(null as int) as minutes, cast(null as varchar[]) as accommodations, cast(null as varchar[]) as consent,
    concat(case when event_id % 70 = 1 then 'EV-x' else 'EV-' end, event_id) as revokes,
    case when event_id % 14 = 1 then ['ACCOMMODATION_TRANSFER'] else ['CASE_SUMMARY_TRANSFER', 'CONTACT_CALLBACK'] end as scopes, false as broken, 'r' as payload from base where event_id % 7 = 1),
read as (select arrival, case when not broken then eventId end as eventId, case when not broken then channel end as channel, case when not broken then sourceId end as sourceId,
    case when not broken then person end as person, case when not broken then minutes end as minutes, case when not broken then accommodations end as accommodations,
    case when not broken then consent end as consent, revokes, scopes, broken, payload from (select * from requests union all select * from revoked)),
lines as (select *, list_filter([case when broken then 'MALFORMED_ENVELOPE' end, case when channel = 'FAX' then 'UNKNOWN_CHANNEL' end,
    case when channel in ('PHYSICAL', 'HOTLINE', 'WEB') and sourceId is null then 'MISSING_SOURCE_ID' end,
    case when list_contains(accommodations, 'NOT_A_CODE') then 'UNKNOWN_ACCOMMODATION' end,
    case when list_contains(consent, 'NOT_A_SCOPE') then 'UNKNOWN_CONSENT_SCOPE' end,
    case when minutes < 0 then 'NEGATIVE_CALLBACK_WINDOW' end], lambda e: e is not null) as own from read),
placed as (select *, row_number() over (partition by eventId order by arrival) as rn, first_value(payload) over (partition by eventId order by arrival) as p0 from lines),
outcomes as (select *, case when eventId is not null and rn > 1 and payload <> p0 then list_append(own, 'EVENT_ID_CONFLICT') else own end as errors,
    case when eventId is not null and rn > 1 and payload = p0 then 'REPLAY' when (eventId is not null and rn > 1) or len(own) > 0 then 'REJECTED' else 'ACCEPTED' end as outcome from placed),
accepted as (select * from outcomes where outcome = 'ACCEPTED'),
taken as (select revokes as eventId, list_distinct(flatten(list(scopes))) as gone from accepted where revokes is not null group by revokes),
effective as (select a.*, list_filter(coalesce(consent, []), lambda s: not list_contains(coalesce(gone, []), s)) as eff from accepted a left join taken t on a.eventId = t.eventId where a.revokes is null)
"""
