"""Consent: what was granted, what was revoked, what may be transferred.

An event's grants never change and revocations only remove, so the effective consent is the grants without the
union of what accepted revocations name, in whatever order they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "cast(array() as array<string>)"


def grants(accepted: DataFrame) -> DataFrame:
    """(eventId, scope) of each granted scope."""
    return accepted.where("revokes is null").select("eventId", F.explode("consent").alias("scope"))


def revocations(accepted: DataFrame) -> DataFrame:
    """(eventId, revoked): the scopes removed from each event; equal scopes are combined before the shuffle."""
    each = accepted.where("revokes is not null").select(F.col("revokes").alias("eventId"), F.explode("scopes").alias("scope"))
    return each.groupBy("eventId").agg(F.sort_array(F.collect_set("scope")).alias("revoked"))


def effective(accepted: DataFrame) -> DataFrame:
    """Accepted requests with ``effective_consent``."""
    requests = accepted.where("revokes is null")
    left = F.array_except(F.coalesce("consent", F.expr(_NONE)), F.coalesce("revoked", F.expr(_NONE)))
    return requests.join(revocations(accepted), "eventId", "left").withColumn("effective_consent", left).drop("revoked")


def effective_view(view: DataFrame) -> DataFrame:
    """(eventId, effective_consent) from the table of grants and revocations that a ledger keeps by event (key, granted, revoked, requested)."""
    return view.where("requested is not null").select(F.col("key").alias("eventId"), F.array_except("granted", "revoked").alias("effective_consent"))


def pending(accepted: DataFrame) -> DataFrame:
    """Accepted revocations whose request has not been accepted yet; they apply once it is."""
    requests = accepted.where("revokes is null").select(F.col("eventId").alias("target"))
    return accepted.where("revokes is not null").join(requests, F.col("revokes") == F.col("target"), "left_anti")


def _if(scope: str, value: Column) -> Column:
    return F.when(F.array_contains("effective_consent", scope), value)


def transferable(effective_rows: DataFrame) -> DataFrame:
    """What the effective consent covers: the callback window, the case (person and source) and the accommodations."""
    return effective_rows.select(
        "canonicalVersion",
        "eventId",
        "channel",
        _if("CONTACT_CALLBACK", F.col("callbackWindowMinutes")).alias("callbackWindowMinutes"),
        _if("CASE_SUMMARY_TRANSFER", F.col("sourceId")).alias("sourceId"),
        _if("CASE_SUMMARY_TRANSFER", F.col("person")).alias("person"),
        _if("ACCOMMODATION_TRANSFER", F.col("accommodations")).alias("accommodations"),
        "effective_consent",
    )
