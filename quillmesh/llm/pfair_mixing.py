"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in an order drawn by hash, fill blocks of ``BLOCK_BYTES``. With target weight w the k-th
block (from 0) of a source is released at slot floor(k / w) and due by slot ceil((k + 1) / w); each slot takes the
released block of earliest deadline. At every slot a source's share then differs from its weight by
less than one block. Weights are fractions of ``SLOTS``, which is far beyond any number of blocks, so that rounding them moves no share by a
millionth of a block. The driver schedules every block, one row of numbers for each, and knows the sources, a row of numbers each. The size of a block is the caller's and never changes by itself: "less than one block" means that
size. A corpus of more than ``MAX_BLOCKS`` blocks (1 TB of the default's) is refused, with the size that it needs.

When a source runs out, a new phase starts with the weights of the others in proportion; so no row
is dropped or repeated, and the bound holds within each phase.

Defined cases: a null source is the source ""; null and empty texts count as one byte; rows without an id are rows like any
other; repeated rows follow one another; a row longer than a block leaves the slots it covers to itself; sources beyond the
``MAX_SOURCES`` largest share the slots of up to that many groups, within which they are scheduled by their own weights in the same way; their windows
are those of the group's blocks, and the bound of one block holds for the group and, in its slots, for its members; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, each_copy, fresh, table

BLOCK_BYTES, SLOTS, MAX_SOURCES, TEMPERATURE = 256 << 10, 1 << 40, 500, 0.5
#: Blocks that the driver schedules at most, some 100 bytes each.
MAX_BLOCKS = 1 << 22
#: Rows of a hash bucket, within which a window numbers them.
BUCKET_ROWS = 2048


def shares(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainder; at least one, taken from the largest."""
    slots = max(slots, len(weights))
    total = sum(weights.values())
    ideal = {s: w / total * slots for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in ideal.items()}
    for s in sorted(ideal, key=lambda s: (out[s] - ideal[s], s))[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    for _ in range(sum(out.values()) - slots):
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def window(k: int, n: int, slots: int) -> tuple[int, int]:
    """Release slot and deadline of block k of a source with n of ``slots``."""
    return k * slots // n, -(-(k + 1) * slots // n)


def period(share: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among the released ones.

    With ``left``, the blocks that each source has, it goes on through periods and ends when the first source runs out.
    """
    slots = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]  # by release
    ready: list[tuple[int, str, int]] = []  # by deadline
    out: dict[str, list[int]] = {s: [] for s in share}
    for t in range(slots) if left is None else count():
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(k, share[s], slots)[1], s, k))
        _, s, k = heapq.heappop(ready)
        out[s].append(t)
        if left is not None and k + 1 == left[s]:
            break
        if left is not None or k + 1 < share[s]:
            heapq.heappush(waiting, (window(k + 1, share[s], slots)[0], s, k + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], slots: int = SLOTS) -> list[dict]:
    """The phases, each with its first slot and each source's share, first block, number of blocks and their slots."""
    left, start, out = {s: n for s, n in blocks.items() if n}, 0, []
    done = {s: 0 for s in left}
    while left:
        share = shares({s: weights[s] for s in left}, slots)
        size, at = sum(share.values()), period(share, left)
        took = {s: len(at[s]) for s in left}
        last = sum(took.values())
        out.append({"start": start, "slots": size, "share": share, "at": at, "first": {s: done[s] for s in left}, "took": took})
        for s, n in took.items():
            done[s] += n
        left, start = {s: n - took[s] for s, n in left.items() if n > took[s]}, start + last
    return out


def plan(blocks: dict[str, int], weights: dict[str, float], slots: int = SLOTS) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, deadline, phase) of every block, with as many sources as there are."""
    by_size = sorted(blocks, key=lambda s: (-blocks[s], s))
    rest = by_size[MAX_SOURCES:]
    step = max(1, -(-len(rest) // MAX_SOURCES))
    groups = [rest[i : i + step] for i in range(0, len(rest), step)]
    units = [[s] for s in by_size[:MAX_SOURCES]] + groups
    name = {f"{i:09d}": u for i, u in enumerate(units)}
    found = phases({k: sum(blocks[s] for s in u) for k, u in name.items()}, {k: sum(weights[s] for s in u) for k, u in name.items()}, slots)
    mine: dict[str, list[tuple[int, int, int, int]]] = {k: [] for k in name}
    for p, ph in enumerate(found):
        for k, at in ph["at"].items():
            for j, t in enumerate(at):
                release, due = window(j, ph["share"][k], ph["slots"])
                mine[k].append((ph["start"] + t, ph["start"] + release, ph["start"] + due, p))
    for k, u in name.items():
        if len(u) == 1:
            yield from ((u[0], b, *x) for b, x in enumerate(mine[k]))
            continue
        own = mine[k]
        for s, b, slot, release, due, _ in plan({s: blocks[s] for s in u}, {s: weights[s] for s in u}, slots):
            last = own[min(due, len(own)) - 1][2]
            yield s, b, own[slot][0], own[release][1], last, own[slot][3]


def _distinct(docs: DataFrame) -> DataFrame:
    """(id, source, h, bytes, n) of each distinct row, n the number of its copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), row_hash(text).alias("h"), F.greatest(F.octet_length(text), F.lit(1)).cast("long").alias("bytes"))
    return cut(rows.groupBy("id", "source", "h", "bytes").agg(F.count(F.lit(1)).alias("n")))


def row_hash(text):
    return F.xxhash64(F.col("doc_id"), F.col("source"), text)


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, temperature: float = TEMPERATURE, slots: int = SLOTS) -> DataFrame:
    """(id, source, h, n, bytes, copy, block, slot, release, deadline, phase, before) of each row.

    ``weights`` are the target weights by source; those it lacks, or all of them, get bytes ** temperature.
    The order of the mix is (slot, before).
    """
    spark = docs.sparkSession
    rows = _distinct(docs)
    sizes = rows.groupBy("source").agg(F.sum(F.col("bytes") * F.col("n")).alias("b"), F.count(F.lit(1)).alias("rows"))
    sizes = sizes.collect()
    if not sizes:
        return rows.select("id", "source", "h", "n", "bytes", *(F.lit(0).cast("long").alias(c) for c in ("copy", "block", "slot", "release", "deadline", "phase", "before")))
    bytes_of = {r["source"]: r["b"] for r in sizes}
    rows = rows.withColumn("key", F.col("source"))
    if sum(bytes_of.values()) > block_bytes * MAX_BLOCKS:
        raise ValueError(f"{sum(bytes_of.values())} bytes need blocks of {-(-sum(bytes_of.values()) // MAX_BLOCKS)} bytes at least, not {block_bytes}")
    weights = {s: (weights or {}).get(s, b**temperature) for s, b in bytes_of.items()}
    planned = list(plan({s: -(-b // block_bytes) for s, b in bytes_of.items()}, weights, slots))

    # bytes of the source before each row: a running sum over buckets of hashes, then within the bucket
    bits = max(1, math.ceil(math.log2(max(2, sum(r["rows"] for r in sizes) / BUCKET_ROWS))))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    buckets = rows.groupBy("key", "bucket").agg(F.sum(F.col("bytes") * F.col("n")).alias("b"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut(buckets.select("key", "bucket", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("key", "bucket").orderBy("h", "id", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("bytes") * F.col("n")).over(inside), F.lit(0))).join(buckets, ["key", "bucket"])
    rows = each_copy(rows, "n", "copy")
    rows = rows.withColumn("before", F.col("offset") + F.col("inside") + F.col("copy") * F.col("bytes")).withColumn("block", F.expr(f"before div {block_bytes}"))

    blocks = spark.createDataFrame(planned, "key string, block long, slot long, release long, deadline long, phase long")
    return rows.join(blocks, ["key", "block"]).select("id", "source", "h", "n", "bytes", "copy", "block", "slot", "release", "deadline", "phase", "before")


def positioned(docs: DataFrame, slot: str = "mix_slot", before: str = "mix_before", **options) -> DataFrame:
    """``docs`` in the order of the mix, with the columns ``slot`` and ``before`` that say it, in place of columns of those names; equal rows stand together at their first one's place.

    The place depends on the rows alone, so it is the same in whatever order and files they are read.
    """
    order = schedule(docs, **options).where("copy = 0")
    h, s, b = fresh(docs, "mix_h"), fresh(docs, f"{slot}_new"), fresh(docs, f"{before}_new")
    order = order.select(F.col("id").alias(h + "_id"), F.col("h").alias(h), F.col("slot").alias(s), F.col("before").alias(b))
    rows = docs.withColumn(h, row_hash(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = rows.join(order, (rows[h] == order[h]) & rows["doc_id"].eqNullSafe(order[h + "_id"]))
    kept = [c for c in docs.columns if c.lower() not in (slot.lower(), before.lower())]
    return joined.orderBy(s, b).select(*(rows[f"`{c}`"] for c in kept), F.col(s).alias(slot), F.col(b).alias(before))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mix; equal rows stand together at their first one's place."""
    return positioned(docs, fresh(docs, "mix_slot"), fresh(docs, "mix_before"), **options).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of each document in a mix whose weights are the square roots of the sources' sizes."""
    found = schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select(F.col("id").alias("doc_id"), "source", "block", "slot", "release", "deadline", "phase", F.col("before").alias("bytes_before"))
