"""The ledger: judged rows in Parquet, and tables kept beside them so that a batch reads what it touches.

===========  =============================================================================================
rows/        by ingest date and attempt; an attempt's rows count once the manifest has its commit
manifest/    the commits (:mod:`manifest`)
ids/         first arrival and payload of each event ID (:mod:`keyed`)
consent/     what each event was granted and what of it is revoked
pending/     revocations of requests that aren't accepted yet, and which request they were handed over to
tombstones/  digests of sources that were erased
landed/      names of the landed files that a batch has read, by attempt
===========  =============================================================================================

One writer at a time; a second one is refused. Rows hold personal data, rejected ones too. Retention drops whole dates, with the event IDs and requests of those dates; revocations stay, so that
no right comes back by a purge.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources import files, keyed, manifest
from quillmesh.sources.manifest import Commit, Refused

ROWS = """canonicalVersion string, eventId string, channel string, sourceId string, person string, callbackWindowMinutes int, accommodations array<string>,
    consent array<string>, revokes string, scopes array<string>, arrival long, payload_fp string, well_formed boolean, malformed_field boolean, window_read int,
    raw string, errors array<string>, outcome string, corrects long"""
_COLUMNS = [c.split()[0] for c in ROWS.replace("\n", " ").split(", ")]


def _union(c: str) -> tuple[str, str]:
    return c, f"array_sort(array_distinct(flatten(collect_list({c}))))"


IDS = keyed.Keyed("ids", "key string, arrival long, payload_fp string, ingest_date string", (("payload_fp", "min_by(payload_fp, arrival)"), ("ingest_date", "min_by(ingest_date, arrival)"), ("arrival", "min(arrival)")))
CONSENT = keyed.Keyed("consent", "key string, granted array<string>, revoked array<string>, requested string", (_union("granted"), _union("revoked"), ("requested", "max(requested)")))
PENDING = keyed.Keyed("pending", "key string, revocations array<string>, since long, resolved long", (_union("revocations"), ("since", "min(since)"), ("resolved", "max(resolved)")))
TOMBSTONES = keyed.Keyed("tombstones", "key string, erased string", (("erased", "min(erased)"),))
TABLES = (IDS, CONSENT, PENDING, TOMBSTONES)


def new_attempt() -> str:
    return uuid.uuid4().hex


@contextmanager
def scratch(spark: SparkSession, path: str):
    """A folder beside the ledger for what a job writes in between; it goes with the job."""
    name = f"{path.rstrip('/')}/scratch/{new_attempt()}"
    try:
        yield name
    finally:
        files.remove(spark, name)


def write_rows(outcomes: DataFrame, path: str, ingest_date: str, attempt: str) -> None:
    """Writes an attempt's rows; they aren't part of the ledger before its commit."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", ingest_date):
        raise ValueError(f"{ingest_date!r} is no ISO date")
    if "corrects" not in outcomes.columns:
        outcomes = outcomes.withColumn("corrects", F.lit(None).cast("long"))
    rows = outcomes.select(*_COLUMNS).withColumn("ingest_date", F.lit(ingest_date)).withColumn("attempt", F.lit(attempt))
    bloom = {f"parquet.bloom.filter.{k}#{c}": v for c in ("sourceId", "eventId") for k, v in (("enabled", "true"), ("expected.ndv", "100000"))}
    rows.write.mode("append").options(**bloom).partitionBy("ingest_date", "attempt").parquet(f"{path}/rows")


def rows_of(spark: SparkSession, path: str, ingest_date: str, attempt: str) -> DataFrame:
    """The rows of one attempt, committed or not; an attempt without rows has none."""
    return _stored(spark, path).where((F.col("ingest_date") == ingest_date) & (F.col("attempt") == attempt))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{ROWS}, ingest_date string, attempt string"
    return spark.read.schema(schema).parquet(f"{path}/rows") if files.names(spark, f"{path}/rows") else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches, with ingest_date and batch; a filter on ingest_date prunes folders."""
    entries = manifest.entries(spark, path).select("attempt", "batch")
    purged = manifest.latest(spark, path).purged
    batches = entries.join(manifest.visible(spark, path), "attempt")
    return _stored(spark, path).where(F.col("ingest_date") >= purged).join(batches, "attempt").select(*_COLUMNS, "ingest_date", "batch")


def table(spark: SparkSession, path: str, which: keyed.Keyed) -> DataFrame:
    """A keyed table as of the last commit."""
    state = manifest.latest(spark, path)
    return _kept(keyed.read(spark, which, path, state.live.get(which.name, [])), which, state.purged)


def find(spark: SparkSession, path: str, state: Commit, which: keyed.Keyed, keys: DataFrame, most: int) -> DataFrame:
    """A keyed table's rows of some keys."""
    return _kept(keyed.find(spark, which, path, state.live.get(which.name, []), keys, most), which, state.purged)


def _kept(rows: DataFrame, which: keyed.Keyed, purged: str) -> DataFrame:
    """Without what a purge has dropped."""
    if which is IDS:
        return rows.where(F.col("ingest_date") >= purged)
    if which is CONSENT:
        gone = F.col("requested") < purged
        return rows.select("key", F.when(~gone, F.col("granted")).alias("granted"), "revoked", F.when(~gone, F.col("requested")).alias("requested"))
    return rows


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rejected rows by error: (error, eventId, channel, arrival, raw, ingest_date, batch, corrected_by, state), a row for each error of each.

    A line that was sent to correct one names its arrival number in ``corrects``; state is open, or what became of the last correction: accepted, replay or rejected.
    """
    rows = read(spark, path)
    fixes = rows.where("corrects is not null").groupBy("corrects").agg(F.max(F.struct("arrival", "outcome")).alias("fix")).select(F.col("corrects").alias("arrival"), "fix")
    out = rows.where("outcome = 'REJECTED'").join(fixes, "arrival", "left").withColumn("error", F.explode("errors"))
    return out.select("error", "eventId", "channel", "arrival", "raw", "ingest_date", "batch", F.col("fix.arrival").alias("corrected_by"), F.coalesce(F.lower("fix.outcome"), F.lit("open")).alias("state"))


def next_arrival(ledger: DataFrame) -> int:
    """The first arrival number after some rows."""
    last = ledger.agg(F.max("arrival")).first()[0]
    return 0 if last is None else last + 1


def outcomes_of(ledger: DataFrame, event_id: str) -> DataFrame:
    """What became of each submission of an event ID, in the order of arrival: where a client's 202 ends."""
    return ledger.where(F.col("eventId") == event_id).select("arrival", "outcome", "errors", "ingest_date", "batch").orderBy("arrival")


def maintain(spark: SparkSession, path: str) -> int:
    """Merges runs of the keyed tables that are due, each by a commit of its own, and puts old commits together; says how many merges that took."""
    n = 0
    for which in TABLES:
        while runs := keyed.due((state := manifest.latest(spark, path)).live.get(which.name, [])):
            live = keyed.merge(spark, which, path, state.live[which.name], runs, new_attempt())
            manifest.commit(spark, path, state.following("merge", live=state.live | {which.name: live}))
            for r in runs:
                files.remove(spark, f"{path}/{which.name}/{r['run']}")
            n += 1
    manifest.compact(spark, path)
    return n


def purge(spark: SparkSession, path: str, before: str) -> list[str]:
    """Deletes the dates before ``before`` (an ISO date) and returns them. There is no default period: it is the owner's decision.

    The commit comes first: from then on the rows are no part of the ledger, and a purge that was broken off is run again. The keyed tables are rewritten without what belonged to those dates. A purged
    event ID is unknown afterwards: sent again, with whatever payload, it is a first arrival.
    """
    state = manifest.latest(spark, path)
    if state.version < 0:
        return []
    if before > state.purged:
        state = manifest.commit(spark, path, state.following("purge", purged=before))
    gone = [n for n in files.names(spark, f"{path}/rows") if n.startswith("ingest_date=") and n.partition("=")[2] < before]
    for which, keep in ((IDS, F.col("ingest_date") >= before), (CONSENT, F.coalesce(F.col("requested") >= before, F.size("revoked") > 0))):
        if runs := state.live.get(which.name):
            live = keyed.merge(spark, which, path, runs, runs, new_attempt(), keep)
            state = manifest.commit(spark, path, state.following("merge", live=state.live | {which.name: live}))
            for r in runs:
                files.remove(spark, f"{path}/{which.name}/{r['run']}")
    for n in gone:
        files.remove(spark, f"{path}/rows/{n}")
    return sorted(n.partition("=")[2] for n in gone)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes what attempts that failed have left behind and returns their names; no writer may be at work."""
    state, gone = manifest.latest(spark, path), []
    live = {r["run"] for runs in state.live.values() for r in runs}
    for which in TABLES:
        gone += [f"{which.name}/{n}" for n in files.names(spark, f"{path}/{which.name}") if n not in live]
    seen = {r["attempt"] for r in manifest.visible(spark, path).collect()}  # names of attempts, one a batch
    for date in files.names(spark, f"{path}/rows"):
        gone += [f"rows/{date}/{n}" for n in files.names(spark, f"{path}/rows/{date}") if n.startswith("attempt=") and n[8:] not in seen] if date.startswith("ingest_date=") else []
    gone += [f"scratch/{n}" for n in files.names(spark, f"{path}/scratch")]
    for n in gone:
        files.remove(spark, f"{path}/{n}")
    return gone


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(file): names of the landed files that committed batches have read."""
    if not files.names(spark, f"{path}/landed"):
        return spark.createDataFrame([], "file string")
    known = manifest.entries(spark, path).where("kind = 'batch'").select("attempt")
    return spark.read.schema("file string, attempt string").parquet(f"{path}/landed").join(known, "attempt", "left_semi").select("file")


def purge_landing(spark: SparkSession, path: str, before: str, ledger: str) -> list[str]:
    """Deletes the landed files last changed before the ISO date ``before`` (UTC) that ``ledger`` has ingested, and returns their names.

    They hold the raw lines, so retention covers them as it covers the ledger; a file that no committed batch has read stays, however old.
    """
    fs, root = files.at(spark, path)
    limit = datetime.fromisoformat(before).replace(tzinfo=timezone.utc).timestamp() * 1000
    old = [(s.getPath().getName(),) for s in fs.listStatus(root) if s.isFile() and s.getModificationTime() < limit]
    if not old:
        return []
    gone = sorted(r["file"] for r in spark.createDataFrame(old, "file string").join(landed(spark, ledger), "file", "left_semi").collect())
    for n in gone:
        files.remove(spark, f"{path.rstrip('/')}/{n}")
    return gone


def source_key(channel: Column, source_id: Column) -> Column:
    """The digest by which an erased source is known."""
    return F.sha2(F.concat_ws("\u0000", channel, source_id), 256)


def erase(spark: SparkSession, path: str, channel: str, source_id: str, on: str) -> dict[str, int]:
    """Removes all that the ledger holds of one source, at the date ``on``: its rows and the revocations of its events, their event IDs, consent and pending entries. Says how many.

    The row files that hold the source are found by their Bloom filters, and only their batches are rewritten, each by a commit of its own that replaces the attempt. A tombstone, the digest of channel
    and source ID, comes first: what is sent of that source from then on is rejected and none of it is kept. Run again, it finds what is left to remove, or nothing.
    """
    state = manifest.latest(spark, path)
    stone = spark.createDataFrame([(channel, source_id, on)], "c string, s string, erased string").select(source_key(F.col("c"), F.col("s")).alias("key"), "erased")
    if find(spark, path, state, TOMBSTONES, stone.select("key"), 1).isEmpty():
        run = keyed.write(stone, TOMBSTONES, path, new_attempt(), 1)
        state = manifest.commit(spark, path, state.following("tombstone", live=state.live | {TOMBSTONES.name: [*state.live.get(TOMBSTONES.name, []), run]}))
    stored = _stored(spark, path).join(manifest.visible(spark, path), "attempt", "left_semi")
    own = stored.where((F.col("channel") == channel) & (F.col("sourceId") == source_id))
    events = sorted({r["eventId"] for r in own.select("eventId").distinct().collect() if r["eventId"] is not None})  # of one source
    mine = (F.col("channel") == channel) & (F.col("sourceId") == source_id)
    mine = F.coalesce(mine, F.lit(False)) | F.coalesce(F.col("revokes").isin(events), F.lit(False)) if events else F.coalesce(mine, F.lit(False))
    hit = [r.asDict() for r in stored.where(mine).groupBy("ingest_date", "attempt").agg(F.count(F.lit(1)).alias("n")).collect()]
    gone_ids = [*events, *(r["eventId"] for r in stored.where(mine & F.col("revokes").isNotNull()).select("eventId").collect())]
    for h in hit:
        new, old = new_attempt(), f"{path}/rows/ingest_date={h['ingest_date']}/attempt={h['attempt']}"
        write_rows(rows_of(spark, path, h["ingest_date"], h["attempt"]).where(~mine), path, h["ingest_date"], new)
        batch = manifest.entries(spark, path).where(F.col("attempt") == h["attempt"]).select("batch").first()["batch"]
        state = manifest.commit(spark, path, state.following("erasure", attempt=new, ingest_date=h["ingest_date"], batch=batch, replaces=[h["attempt"]]))
        files.remove(spark, old)
    keys = spark.createDataFrame([(e,) for e in gone_ids], "key string")
    for which in (IDS, CONSENT, PENDING):
        runs = state.live.get(which.name, [])
        held = [r for r in runs if gone_ids and not keyed.find(spark, which, path, [r], keys, len(gone_ids)).isEmpty()]
        for r in held:
            live = keyed.merge(spark, which, path, state.live[which.name], [r], new_attempt(), ~F.col("key").isin(gone_ids))
            state = manifest.commit(spark, path, state.following("merge", live=state.live | {which.name: live}))
            files.remove(spark, f"{path}/{which.name}/{r['run']}")
    return {"rows": sum(h["n"] for h in hit), "events": len(gone_ids)}


__all__ = ["Refused", "erase", "find", "landed", "maintain", "next_arrival", "outcomes_of", "purge", "purge_landing", "quarantine", "read", "scratch", "table", "vacuum"]
