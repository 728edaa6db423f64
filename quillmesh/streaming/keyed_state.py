"""Replay and conflict of event IDs by keyed stream state, for streams that answer at once instead of keeping a ledger.

The fingerprint of each event ID's first payload is kept in Spark's RocksDB state store, those of a bucket of event IDs by hash in one state value: a call to the store costs more than a row does, so
a micro-batch makes two for each bucket that it touches, however many event IDs that holds. It may be seeded from a ledger's event IDs, so that what the ledger knows is no first arrival here.
Nothing in an envelope is a time, so state never expires by itself; a stream that needs retention is started anew from a ledger that has been purged.

Rows of an event ID in one micro-batch are taken in the order of their arrival; Spark hands them over in none, so they are sorted, all of one bucket at once. Rows, not frames of pandas, since most buckets have few.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmesh.contract import ACCEPTED, REJECTED, REPLAY
from quillmesh.operators.idempotency import event_key
from quillmesh.plans.intake import canonical

_STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "arrival long, eventId string, channel string, sourceId string, payload_fp string, errors array<string>, outcome string"
#: Buckets of event IDs; those of rows without one have negative numbers.
BUCKETS, UNNAMED = 1 << 18, 1024
_INPUT = ["arrival", "eventId", "channel", "sourceId", "payload_fp", "errors"]


@contextmanager
def rocksdb(spark: SparkSession):
    """A session that uses the RocksDB state store while streams are started in it; they keep it, the session doesn't."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, PROVIDER)
    try:
        yield spark
    finally:
        spark.conf.set(_STORE, before)


class Judge(StatefulProcessor):
    """The outcome of each row of a bucket of event IDs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getValueState("firsts", "events array<string>, prints array<string>")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.firsts.update((initialState["events"], initialState["prints"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.firsts.get() if key[0] >= 0 else None
        firsts = dict(zip(held[0], held[1])) if held else {}
        known = len(firsts)
        for row in sorted(rows, key=lambda r: r["arrival"]):
            errors, outcome, event = list(row["errors"]), None, row["event"]
            if event is not None:
                first = firsts.setdefault(event, None)
                if first is None:
                    firsts[event] = row["payload_fp"]
                elif row["payload_fp"] == first:
                    outcome = REPLAY
                else:
                    errors.append("EVENT_ID_CONFLICT")
            yield Row(**{c: row[c] for c in _INPUT} | {"errors": errors, "outcome": outcome or (REJECTED if errors else ACCEPTED)})
        if len(firsts) > known:
            self.firsts.update((list(firsts), list(firsts.values())))

    def close(self) -> None:
        pass


def judged(lines: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """``lines`` (raw, arrival), a stream, with their outcomes; ``seed``: event IDs known before, as (key, payload_fp).

    Rows without an event ID are judged alone, under keys of their own that keep no state. The session must use the RocksDB state store.
    """
    if lines.sparkSession.conf.get(_STORE) != PROVIDER:
        raise RuntimeError(f"set {_STORE} to {PROVIDER}")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    rows = canonical(lines).withColumn("event", event_key())
    rows = rows.select(F.when(F.col("event").isNotNull(), bucket("event")).otherwise(-1 - F.pmod("arrival", F.lit(UNNAMED))).cast("long").alias("key"), "event", *_INPUT)
    initial = None
    if seed is not None:
        each = seed.groupBy(bucket("key").cast("long").alias("bucket")).agg(F.collect_list(F.struct("key", "payload_fp")).alias("all"))
        initial = each.select(F.col("bucket").alias("key"), F.col("all.key").alias("events"), F.col("all.payload_fp").alias("prints")).groupBy("key")
    return rows.groupBy("key").transformWithState(Judge(), OUTPUT, "append", "none", initialState=initial)
