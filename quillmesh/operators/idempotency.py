"""Replays and conflicts of event IDs.

The first arrival of an event ID stands, valid or not (or, as the owner may choose, the first valid one). The same payload again is a replay and has no
effect; a different one is a conflict. The first arrivals come from an aggregation, which combines
before it shuffles, and meet the rows in a join that Spark can split where one event ID holds many rows.
Whatever the ledger holds came before. Missing and blank event IDs name no event: their rows are judged alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.contract import ACCEPTED, REJECTED, REPLAY
from quillmesh.functions.envelopes import is_blank


def event_key() -> Column:
    """The event ID, or null if it is blank."""
    return F.when(~is_blank("eventId"), F.col("eventId"))


def firsts(rows: DataFrame) -> DataFrame:
    """(event, first): arrival and fingerprint of each event ID's first row."""
    keyed = rows.select(event_key().alias("event"), F.struct("arrival", "payload_fp").alias("at")).where("event is not null")
    return keyed.groupBy("event").agg(F.min("at").alias("first"))


def resolve(validated: DataFrame, ledger: DataFrame | None = None, invalid_claims: bool = True) -> DataFrame:
    """``validated`` with ``outcome``, and EVENT_ID_CONFLICT among ``errors``.

    ``ledger``: rows that came before, with eventId, arrival and payload_fp, whatever their arrival numbers. ``invalid_claims``: whether an invalid first record
    claims its event ID, which is the literal reading. If it doesn't, the first valid record stands: invalid ones before it are rejected for what they are, and free the ID for a corrected one; what the
    ledger gives must then be valid first records.
    """
    known = firsts(validated if invalid_claims else validated.where(F.size("errors") == 0)).withColumn("before", F.lit(False))
    if ledger is not None:
        met = validated.select(event_key().alias("eventId")).where("eventId is not null").distinct()
        older = ledger.join(met, "eventId", "left_semi")
        known = known.unionByName(firsts(older).withColumn("before", F.lit(True)))
        known = known.groupBy("event").agg(F.max_by("first", "before").alias("first"), F.max("before").alias("before"))
    rows = validated.withColumn("event", event_key()).join(known, "event", "left")
    again = F.col("first").isNotNull() & (F.col("before") | (F.col("first.arrival") < F.col("arrival")))
    same = F.col("first.payload_fp") == F.col("payload_fp")
    errors = F.when(again & ~same, F.array_append("errors", F.lit("EVENT_ID_CONFLICT"))).otherwise(F.col("errors"))
    outcome = F.when(again & same, REPLAY).when(F.size("errors") > 0, REJECTED).otherwise(ACCEPTED)
    return rows.withColumn("errors", errors).withColumn("outcome", outcome).drop("first", "before", "event")
