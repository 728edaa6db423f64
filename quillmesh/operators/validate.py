"""Checks of a canonical row, each an error of its own; a row keeps all of its errors."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.contract import ACCOMMODATION_CODES, CHANNELS, CONSENT_SCOPES, ERRORS
from quillmesh.functions.envelopes import is_blank


def _outside(values: str, known: tuple[str, ...]) -> Column:
    """Whether an array has an element that isn't known; absent and empty arrays have none."""
    held = F.coalesce(F.col(values), F.array().cast("array<string>"))
    return F.size(F.array_except(held, F.array(*map(F.lit, known)))) > 0


def checks(channels: Collection[str] = CHANNELS) -> dict[str, Column]:
    """The condition of each error that a row has by itself."""
    ok, request = F.col("well_formed"), F.col("revokes").isNull()
    known = F.coalesce(F.col("channel").isin(*channels), ~request)
    return {
        "MALFORMED_ENVELOPE": ~ok,
        "MISSING_EVENT_ID": ok & (is_blank("eventId")),
        "UNKNOWN_CHANNEL": ok & ~known,
        "MISSING_SOURCE_ID": ok & F.coalesce(F.col("channel").isin(*channels), F.lit(False)) & is_blank("sourceId"),
        "MALFORMED_FIELD": ok & F.coalesce("malformed_field", F.lit(False)),
        "UNKNOWN_ACCOMMODATION": _outside("accommodations", ACCOMMODATION_CODES),
        "UNKNOWN_CONSENT_SCOPE": _outside("consent", CONSENT_SCOPES) | _outside("scopes", CONSENT_SCOPES),
        "NEGATIVE_CALLBACK_WINDOW": F.coalesce(F.col("window_read") < 0, F.lit(False)),
    }


def validate(canonical: DataFrame, channels: Collection[str] = CHANNELS) -> DataFrame:
    """``canonical`` with ``errors``, in the order of the contract."""
    marks = [F.when(condition, F.lit(name)) for name, condition in checks(channels).items()]
    assert list(checks()) == list(ERRORS[:-1])
    return canonical.withColumn("errors", F.array_except(F.array(*marks), F.array(F.lit(None).cast("string"))))


def split(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, replays, rejected): every row is in exactly one."""
    return tuple(outcomes.where(F.col("outcome") == o) for o in ("ACCEPTED", "REPLAY", "REJECTED"))
