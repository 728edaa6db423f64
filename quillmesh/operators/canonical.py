"""Envelopes to the canonical request model, by each channel's field contract.

The channels' adapters are rows of a registry, looked up within one projection, so a scan of the inbox feeds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.contract import CANONICAL_VERSION, CHANNELS
from quillmesh.functions import envelopes as E


_LISTS = ("accommodations", "consent", "scopes")
_NAMED = ("eventId", "channel", "revokes", *_LISTS)
#: What a channel names itself, by its place in the registry.
_OWN = ("source", "person", "window")
#: The window's member on channels that name none.
_WINDOW = "callbackWindowMinutes"


def parse(inbox: DataFrame, channels: dict[str, tuple] = CHANNELS) -> DataFrame:
    """``inbox`` (raw, arrival) with the variant ``envelope``, whether it is ``well_formed``, and as ``f`` the members that ``channels`` and the contract name, each a variant.

    Bad input stays, without members. A line is parsed once, and its object is read once: what follows reads the members' own variants.
    """
    names = _names(channels)
    rows = inbox.withColumn("envelope", E.parsed(F.col("raw")))
    rows = rows.withColumn("f", E.named_members(F.col("envelope"), names) if _apart(names) else E.members(F.col("envelope")))
    return rows.withColumn("well_formed", F.col("f").isNotNull())


def _names(channels: dict[str, tuple]) -> list[str]:
    """The members that are read of an envelope."""
    return list(dict.fromkeys([*_NAMED, _WINDOW, *(x for fields in channels.values() for x in fields if x)]))


def _apart(names: list[str]) -> bool:
    """Whether no two names differ in case alone; the fields of a struct could not be told apart then."""
    return len({n.lower() for n in names}) == len(names)


def _own(channels: dict[str, tuple], place: int, field) -> Column:
    """The member that a row's channel (``of``) names for a part; null where it names none."""
    out = F.lit(None).cast("variant")
    for c, fields in channels.items():
        if fields[place]:
            out = F.when(F.col("of") == c, field(fields[place])).otherwise(out)
    return out


def adapt(parsed: DataFrame, channels: dict[str, tuple] = CHANNELS) -> DataFrame:
    """Parsed envelopes as canonical rows; ``malformed_field`` marks a field of a wrong type.

    ``channels``: the registry, of the fields that each channel names for its source ID, its person and, perhaps, its callback window (``sources.registry`` reads it from a table); an adapter is a row of it.
    A row with ``revokes`` is a revocation and needs no channel. Fields that a channel's contract doesn't name stay
    in ``raw`` and in the fingerprint alone, but ``callbackWindowMinutes`` is read on any channel, for its range check. Columns ``file`` and ``corrects`` go along.
    """
    if _apart(_names(channels)):
        field = lambda name: F.col("f").getField(name)
    else:
        field = lambda name: F.try_element_at("f", F.lit(name))
    rows = parsed.withColumn("of", E.string_value(field("channel"), E.kind(field("channel"))))
    members = {n: field(n) for n in _NAMED} | {n: _own(channels, i, field) for i, n in enumerate(_OWN[:2])}
    windowed = F.col("of").isin(*(c for c, fields in channels.items() if fields[2]))
    members["window"] = F.when(windowed, _own(channels, 2, field)).otherwise(field(_WINDOW))
    rows = rows.withColumn("g", F.struct(*(v.alias(n) for n, v in members.items())))
    rows = rows.withColumn("k", F.struct(*(E.kind(F.col(f"g.{n}")).alias(n) for n in members)))
    read = {n: E.string_value for n in ("eventId", "channel", "revokes", "source")} | {n: E.strings_value for n in _LISTS} | {"person": E.json_value, "window": E.int_value}
    rows = rows.withColumn("v", F.struct(*(read[n](F.col(f"g.{n}"), F.col(f"k.{n}")).alias(n) for n in members)))
    value = lambda n: F.col(f"v.{n}")
    wrong = F.lit(False)
    for n in members:
        if n != "person":
            wrong = wrong | (F.col(f"k.{n}").isNotNull() & value(n).isNull())
    return rows.select(
        F.lit(CANONICAL_VERSION).alias("canonicalVersion"),
        value("eventId").alias("eventId"),
        value("channel").alias("channel"),
        value("source").alias("sourceId"),
        value("person").alias("person"),
        F.when(windowed, value("window")).alias("callbackWindowMinutes"),
        value("accommodations").alias("accommodations"),
        value("consent").alias("consent"),
        value("revokes").alias("revokes"),
        value("scopes").alias("scopes"),
        "arrival",
        E.fingerprint(F.col("raw"), F.col("well_formed"), F.col("envelope")).alias("payload_fp"),
        "well_formed",
        wrong.alias("malformed_field"),
        value("window").alias("window_read"),
        "raw",
        *(c for c in ("file", "corrects") if c in parsed.columns),
    )


def by_channel(canonical: DataFrame, channel: str) -> DataFrame:
    """The rows that one channel's adapter made."""
    return canonical.where(F.col("channel") == channel)


def correlate(canonical: DataFrame) -> DataFrame:
    """(channel, sourceId, n_events, first_event, last_event): the events that one source ID stands for; they are kept apart."""
    known = canonical.where("channel is not null and sourceId is not null")
    ends = [f(F.struct("arrival", "eventId")).alias(n) for f, n in ((F.min, "a"), (F.max, "z"))]
    found = known.groupBy("channel", "sourceId").agg(F.count(F.lit(1)).alias("n_events"), *ends)
    return found.select("channel", "sourceId", "n_events", F.col("a.eventId").alias("first_event"), F.col("z.eventId").alias("last_event"))


def of_source(canonical: DataFrame, channel: str, source_id: str) -> DataFrame:
    """The rows of one source ID."""
    return canonical.where((F.col("channel") == channel) & (F.col("sourceId") == source_id))
