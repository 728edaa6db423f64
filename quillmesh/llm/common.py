"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.scratch import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a folder of our own takes its place.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch: with whole texts in them, Spark's 10,000 take tens of megabytes several times over.
BATCH_ROWS = 1024


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of BATCH_ROWS at most, a setting of the session that only ever gets smaller."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(task, schema)


def trim() -> None:
    """Gives a Python worker's free memory back: the worker is kept for later tasks, beside which it would stand unused."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files, checkpoints and broadcasts that nothing refers to any more.

    It notices when the driver collects garbage, otherwise every half hour; between the phases of a job their files would add up on the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a side that is broadcast: some tens of bytes each. A larger one is shuffled.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame) -> DataFrame:
    """A side of a join, marked for broadcast if it is small; ``df`` is cut."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def text_id(c: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text_bytes(c)))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def each_copy(df: DataFrame, n: str, name: str, step: int = 1 << 16) -> DataFrame:
    """A row for each of a row's ``n`` copies, numbered from 0 in ``name``: by ranges of ``step``, so that no array grows with the copies."""
    part, last = fresh(df, "part"), F.col(n) - 1
    rows = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {step}"))))
    return rows.withColumn(name, F.explode(F.sequence(F.col(part) * step, F.least(last, F.col(part) * step + (step - 1))))).drop(part)


def bits_for(n: int) -> int:
    """Bits of a filter over ``n`` keys: 16 for each, a power of two, from 2**20 up to 2**28, so that a broadcast takes 32 MB at most."""
    return 1 << min(28, max(20, (16 * n - 1).bit_length()))


def bitmap_of(slots: DataFrame, c: str, bits: int) -> bytes:
    """A bitmap of ``bits`` bits with those at ``slots.c`` set."""
    parts = slots.groupBy(F.expr(f"{c} div 32768").alias("page")).agg(F.expr(f"bitmap_construct_agg({c} % 32768)").alias("bits")).collect()
    out = bytearray(bits // 8)
    for p in parts:
        out[p["page"] * 4096 : p["page"] * 4096 + len(p["bits"])] = p["bits"]
    return bytes(out)


#: Where a key's three bits of a Bloom filter are read off the key itself, which must be a hash.
_SHIFTS = (1, 19, 36)


def bloom_of(keys: DataFrame, c: str) -> tuple[bytes, int]:
    """A Bloom filter over hashes, and its bits. Past 2**24 keys it lets more of the others pass, which costs rows and no result. ``keys`` should be cut."""
    bits = bits_for(keys.count())
    slots = keys.select(F.explode(F.array(*(F.shiftrightunsigned(c, s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS))).alias("at"))
    return bitmap_of(slots, "at", bits), bits


def bloom_hits(held: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether each of the keys (unsigned 64 bits) may be in the filter (its bytes)."""
    out = np.ones(keys.shape, bool)
    for s in _SHIFTS:
        at = (keys >> np.uint64(s)) & np.uint64(bits - 1)
        out &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
