"""The intake plan: inbox to outcomes, and outcomes to the ledger."""

from __future__ import annotations

from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmesh.contract import CHANNELS, ERRORS
from quillmesh.operators.canonical import adapt, parse
from quillmesh.operators.idempotency import event_key, resolve
from quillmesh.operators.validate import validate
from quillmesh.sources import keyed, ledger, manifest
from quillmesh.sources.scratch import written

#: The error of a row whose source was erased; it is no part of the contract's list.
ERASED = "ERASED_SOURCE"


def canonical(inbox: DataFrame, channels: dict[str, tuple] = CHANNELS) -> DataFrame:
    """Canonical rows of ``inbox`` (raw, arrival) with their own errors; ``channels``: the registry."""
    return validate(adapt(parse(inbox, channels), channels), channels)


def outcomes(inbox: DataFrame, before: DataFrame | None = None, channels: dict[str, tuple] = CHANNELS, invalid_claims: bool = True) -> DataFrame:
    """Canonical rows with errors and outcome; ``before`` holds what came before.

    The canonical rows are written once, in the shared folder, so that each line is parsed once although first arrivals and rows both need it.
    """
    return resolve(written(canonical(inbox, channels), "canonical"), before, invalid_claims)


def _observed(o: Observation) -> dict:
    """What was counted; nothing where Spark knew beforehand that there are no rows, and left the counting out."""
    try:
        return defaultdict(int, o.get)
    except Py4JJavaError:
        return defaultdict(int)


def _inputs(observed: dict) -> str:
    """A digest of a batch's lines in their order of arrival."""
    return f"{observed['n']}-{observed['a'] or 0}-{observed['b'] or 0}"


def _counts(claims: bool) -> list:
    """What is counted of a batch while its rows are written."""
    of = lambda name, condition: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    return [
        F.count(F.lit(1)).alias("rows"),
        *(of(f"outcome:{o}", F.col("outcome") == o) for o in ("ACCEPTED", "REPLAY", "REJECTED")),
        *(of(f"error:{e}", F.array_contains("errors", e)) for e in (*ERRORS, ERASED)),
        *(of(f"channel:{c}", F.col("channel") == c) for c in CHANNELS),
        of("channel:other", F.col("channel").isNotNull() & ~F.col("channel").isin(*CHANNELS)),
        of("firsts", event_key().isNotNull() & _first(claims)),
        of("revocations", (F.col("outcome") == "ACCEPTED") & F.col("revokes").isNotNull()),
    ]


def _first(claims: bool):
    """Whether a judged row is the one that stands for its event ID."""
    if not claims:
        return F.col("outcome") == "ACCEPTED"
    return (F.col("outcome") != "REPLAY") & ~F.array_contains("errors", "EVENT_ID_CONFLICT")


def _without_erased(spark: SparkSession, path: str, state: manifest.Commit, rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with nothing left of sources that were erased but an error."""
    if not state.live.get(ledger.TOMBSTONES.name):
        return rows
    rows = rows.withColumn("key", F.when(F.col("channel").isNotNull() & F.col("sourceId").isNotNull(), ledger.source_key(F.col("channel"), F.col("sourceId"))))
    stones = ledger.find(spark, path, state, ledger.TOMBSTONES, rows.select("key"), n)
    kept = {"arrival", "canonicalVersion", "well_formed", "malformed_field", "file", "corrects"}
    gone = F.col("erased").isNotNull()
    value = lambda c, kind: F.array(F.lit(ERASED)) if c == "errors" else F.lit("") if c == "payload_fp" else F.lit(None).cast(kind)
    columns = [F.col(c) if c in kept else F.when(gone, value(c, kind)).otherwise(F.col(c)).alias(c) for c, kind in rows.drop("key").dtypes]
    return rows.join(stones, "key", "left").select(*columns)


def _deltas(spark: SparkSession, path: str, state: manifest.Commit, rows: DataFrame, ingest_date: str, counts: dict, claims: bool):
    """What a batch's judged rows add to the keyed tables: (table, rows, their number at most)."""
    if counts["firsts"]:
        firsts = rows.where(event_key().isNotNull() & _first(claims))
        yield ledger.IDS, firsts.select(event_key().alias("key"), "arrival", "payload_fp", F.lit(ingest_date).alias("ingest_date")), counts["firsts"]
    accepted, n = rows.where("outcome = 'ACCEPTED'"), counts["outcome:ACCEPTED"]
    if not n:
        return
    none, text = F.array().cast("array<string>"), lambda c: F.lit(c).cast("string")
    requests, revocations = accepted.where("revokes is null"), accepted.where("revokes is not null")
    granted = requests.select(F.col("eventId").alias("key"), F.coalesce("consent", none).alias("granted"), none.alias("revoked"), text(ingest_date).alias("requested"))
    revoked = revocations.select(F.col("revokes").alias("key"), none.alias("granted"), F.coalesce("scopes", none).alias("revoked"), text(None).alias("requested"))
    yield ledger.CONSENT, granted.unionAll(revoked), n
    own = requests.select(F.col("eventId").alias("key"), "arrival")
    if m := counts["revocations"]:
        named = revocations.select(F.col("revokes").alias("key"), F.col("eventId").alias("of"), F.col("arrival").alias("since"))
        there = ledger.find(spark, path, state, ledger.CONSENT, named.select("key"), m).where("requested is not null").select("key").unionAll(own.select("key"))
        waiting = named.join(there, "key", "left_anti").select("key", F.array("of").alias("revocations"), "since", F.lit(None).cast("long").alias("resolved"))
        yield ledger.PENDING, waiting, m
    if state.live.get(ledger.PENDING.name) and n > counts["revocations"]:
        met = ledger.find(spark, path, state, ledger.PENDING, own.select("key"), n).where("resolved is null").drop("resolved")
        yield ledger.PENDING, met.join(own.withColumnRenamed("arrival", "resolved"), "key").select("key", "revocations", "since", "resolved"), n


def ingest(spark: SparkSession, lines: DataFrame, path: str, ingest_date: str, batch: str, stream: tuple[str, int] | None = None, channels: dict[str, tuple] = CHANNELS, invalid_claims: bool = True) -> DataFrame:
    """Judges ``lines`` (raw, arrival from 0, perhaps landed or file, and corrects, the arrival number of a rejected row) against the ledger at ``path``, commits them as a batch and returns the batch's rows.

    A batch that is committed already stays as it is if its lines are the same, and is refused if they aren't; to know that, its lines are digested and not judged. One that failed before its commit has left
    nothing that counts and is judged anew. Of the ledger it reads the last commit and what its own event IDs, targets and sources meet in the keyed tables. Everything that is counted is counted while
    rows are written. ``stream``: the identity of a stream and the number of its micro-batch, which names the batch for good.
    ``channels``: the registry. ``invalid_claims``: as in :func:`resolve`; a ledger keeps to the reading with which it began.
    """
    path = path.rstrip("/")
    state = manifest.latest(spark, path)
    if stream and stream[1] <= state.streams.get(stream[0], -1):
        return ledger.read(spark, path).where(F.col("batch") == batch)
    if ingest_date < state.purged:
        raise manifest.Refused(f"dates before {state.purged} are purged")
    if state.claims not in (None, invalid_claims):
        raise manifest.Refused(f"{path} was begun with invalid_claims={state.claims}")
    extra = ["corrects"] if "corrects" in lines.columns else []
    with ledger.scratch(spark, path) as scratch:
        seen = Observation()
        file = F.col("landed.file") if "landed" in lines.columns else F.col("file") if "file" in lines.columns else F.lit(None).cast("string")
        hashed = lambda text: F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
        line = F.concat_ws("\u0000", F.col("place").cast("string"), F.coalesce("raw", F.lit("\u0001")))
        given = lines.select("raw", F.col("arrival").alias("place"), file.alias("file"), *extra).withColumn("arrival", F.col("place") + state.next)
        sums = [F.count(F.lit(1)).alias("n"), F.max("arrival").alias("last"), F.sum(F.xxhash64("place", "raw").cast("decimal(20,0)")).alias("a"), F.sum(hashed(line)).alias("b")]
        if not stream and (known := manifest.batch_of(spark, path, ingest_date, batch)):
            if known.inputs != _inputs(given.agg(*sums).first().asDict()):
                raise manifest.Refused(f"batch {batch!r} of {ingest_date} was committed with other lines")
            return ledger.read(spark, path).where((F.col("ingest_date") == ingest_date) & (F.col("batch") == batch))
        validated = canonical(given.observe(seen, *sums).select("raw", "arrival", F.element_at(F.split("file", "/"), -1).alias("file"), *extra), channels)
        validated.write.parquet(f"{scratch}/canonical")
        found = _observed(seen)
        n, inputs = found["n"], _inputs(found)
        validated = _without_erased(spark, path, state, spark.read.schema(validated.schema).parquet(f"{scratch}/canonical"), n)
        before = ledger.find(spark, path, state, ledger.IDS, validated.select(event_key().alias("key")), n).select(F.col("key").alias("eventId"), "arrival", "payload_fp")
        attempt, counted = ledger.new_attempt(), Observation()
        ledger.write_rows(resolve(validated, before, invalid_claims).observe(counted, *_counts(invalid_claims)), path, ingest_date, attempt)
        counts = _observed(counted)
        rows = ledger.rows_of(spark, path, ingest_date, attempt)
        live = {k: list(v) for k, v in state.live.items()}
        for table, delta, size in _deltas(spark, path, state, rows, ingest_date, counts, invalid_claims):
            if run := keyed.write(delta, table, path, ledger.new_attempt(), size):
                live.setdefault(table.name, []).append(run)
        if {"landed", "file"} & set(lines.columns):
            validated.select("file").where("file is not null").distinct().withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{path}/landed")
        streams = state.streams | ({stream[0]: stream[1]} if stream else {})
        manifest.commit(spark, path, state.following("batch", attempt=attempt, ingest_date=ingest_date, batch=batch, stream=stream and stream[0], inputs=inputs, n_rows=counts["rows"], counts=counts, live=live, streams=streams, claims=invalid_claims, next=found["last"] + 1 if n else state.next))
    ledger.maintain(spark, path)
    return rows.withColumn("batch", F.lit(batch)).drop("attempt")
