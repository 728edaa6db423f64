"""Continuous intake: each micro-batch goes through the batch plan, with the ledger's keyed tables as its state.

Stream and batch ingests of one ledger know each other's event IDs, and retention of the ledger is retention of the stream's memory. A micro-batch is known by the identity of its
checkpoint and its number, so several streams may write to one ledger, one at a time, and a micro-batch that is run again after its commit changes nothing.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from quillmesh.plans.intake import ingest
from quillmesh.sources import files
from quillmesh.sources.inbox import numbered


def identity(spark: SparkSession, checkpoint: str) -> str:
    """What Spark calls the stream of a checkpoint, as long as that lasts."""
    return json.loads(files.read(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def start(spark: SparkSession, inbox: DataFrame, path: str, checkpoint: str, ingest_date: str | None = None):
    """A writer that ingests ``inbox`` (raw, landed; or raw, arrival, file) into the ledger at ``path``.

    Without an ``ingest_date`` a micro-batch belongs to the date (UTC) on which it is judged, so that a stream that runs on ages by days.
    """

    def batch(df: DataFrame, n: int) -> None:
        stream, date = identity(spark, checkpoint), ingest_date or datetime.now(timezone.utc).date().isoformat()
        ingest(spark, numbered(df) if "landed" in df.columns else df, path, date, f"stream-{stream}-{n:012d}", (stream, n))

    return inbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
