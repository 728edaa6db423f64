"""The channel registry as a table: a channel is a row, and a new one needs no code."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Channels that a registry may hold; it is small by its nature and is part of the plan.
MOST = 10_000


def read(table: DataFrame) -> dict[str, tuple[str, str | None, str | None]]:
    """The registry of ``table`` (channel, sourceIdField, personField, callbackWindowField) as ``canonical.adapt`` takes it.

    A channel needs a name, a source ID field and no second row; the other fields may be null.
    """
    rows = table.select("channel", "sourceIdField", "personField", "callbackWindowField").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} channels")
    found = {r["channel"]: (r["sourceIdField"], r["personField"], r["callbackWindowField"]) for r in rows}
    if len(found) < len(rows) or not all(c and f[0] for c, f in found.items()):
        raise ValueError("each channel needs one row, a name and a source ID field")
    return found
