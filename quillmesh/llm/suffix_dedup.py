"""Suffix-array deduplication: bytes covered by a string of WINDOW bytes that starts twice or more anywhere are removed.

Strings that are equal have equal anchors: of a window's grams (GRAMS[0] bytes) the one of least hash, of equal ones the first. A run of neighbouring windows with one anchor is a
segment, some 270 bytes of a text, and only segments of one anchor can share a window. So anchors are counted; segments whose anchor occurs once are left out; equal segments count as one with
its number of copies. What is left is dealt out to shards by anchor, and a shard's segments become one text on disk whose suffixes
are sorted, with their common prefixes, by the external induced sorting of :mod:`external_induction`; a shard may be far larger than the memory that its task may take. Neighbours
in that order with a common prefix of WINDOW bytes are repeats of each other, exactly, byte by byte. A segment with copies repeats as a whole, and one whose anchor has no other segment needs no order.

An anchor that a great part of all texts share, say in a passage shorter than a window, with other bytes around it each time, has more segments than one task should get. Past HOT different ones they are
cut again by anchors of longer grams, which reach into what differs, up to those of a whole window, where equal anchors mean equal windows.

Digests of 128 bits stand for equal texts and equal segments (of one anchor). Bloom filters of 32 MB at most leave out rows before the joins that decide; when full they save less and change nothing.

A task's sort spills to a folder under Spark's own spill folders (SPARK_LOCAL_DIRS), and removes it at its end; nothing else reads it, and a task that is run again starts anew.

Strings are judged on the input, within one row's text; null text is empty. Texts shorter than WINDOW have no window and stay. Rows are documents, so a repeated row is a copy and a row without an id is a document as well. Further
columns are ignored; an empty table gives no rows. UTF-8 has no byte 255, which parts the segments of a shard.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources.scratch import written

from .common import arrow, bloom_hits, bloom_of, cut, release, table, text_bytes
from .external_induction import repeated

WINDOW = 200
#: Bytes of the grams that anchor segments, by how often an anchor has been found hot.
GRAMS = (64, 128, 176, WINDOW)
#: Different segments of one anchor that go to one shard at most.
HOT = 4096
#: Bytes of a shard that is dealt out, and of memory within which its sort keeps off the disk.
SHARD_BYTES, MEMORY = 4 << 20, 128 << 20
#: Windows that are anchored at once; a place in them takes so many bits.
_PLACE_BITS = 20
_PIECE = (1 << _PLACE_BITS) - WINDOW
#: Texts that a task remembers to have sent.
SEEN = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    if not _POWERS:
        n = _PIECE + WINDOW
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def runs(body: np.ndarray, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, windows, anchor's hash) of the segments of a text's bytes, by pieces of bounded size."""
    up, down = _powers()
    for a in range(0, len(body) - WINDOW + 1, _PIECE):
        part = body[a : a + _PIECE + WINDOW - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * down[: len(part)], out=sums[1:])
        h = _mix((sums[gram:] - sums[:-gram]) * up[: len(part) - gram + 1])
        place = np.uint64((1 << _PLACE_BITS) - 1)
        at = _least((h & ~place) | np.arange(len(h), dtype=np.uint64), WINDOW - gram + 1) & place
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield a + starts, np.diff(np.r_[starts, len(at)]), h[at[starts].astype(np.int64)].view(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    """(id, body, copies) of rows that hold a window; a text's id is its digest unless given."""
    n = batch.num_rows
    ids = batch["id"].to_pylist() if "id" in batch.schema.names else [None] * n
    copies = batch["n"].to_pylist() if "n" in batch.schema.names else [1] * n
    for body, given, c in zip(batch["body"], ids, copies):
        body = body.as_py()
        if len(body) >= WINDOW:
            yield given or hashlib.md5(body).digest(), body, c


def anchor_counts(pieces: DataFrame, gram: int) -> DataFrame:
    """(key, n): anchors that occur twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, size = [], [], 0
            for _, body, n in _pieces(batch):
                for _, _, k in runs(np.frombuffer(body, np.uint8), gram):
                    keys.append(k)
                    counts.append(np.full(len(k), n))
                    size += len(k)
                if size >= 1 << 19:
                    yield summed(keys, counts)
                    keys, counts, size = [], [], 0
            if keys:
                yield summed(keys, counts)

    def summed(keys: list, counts: list) -> pa.RecordBatch:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(where, np.concatenate(counts)).astype(np.int64))], ["key", "n"])

    found = arrow(pieces, run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def placed(pieces: DataFrame, gram: int, held: bytes, bits: int) -> DataFrame:
    """(id, at, size, key, segment, n): the segments whose anchors may repeat; ``segment`` is a digest of their bytes, ``size`` counts their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, names = np.frombuffer(held, np.uint8), ["id", "at", "size", "key", "segment", "n"]
        for batch in batches:
            for ident, body, n in _pieces(batch):
                for starts, sizes, keys in runs(np.frombuffer(body, np.uint8), gram):
                    hit = bloom_hits(bloom, bits, keys.view(np.uint64))
                    starts, sizes, keys = starts[hit], sizes[hit], keys[hit]
                    digests = [int.from_bytes(hashlib.blake2b(body[a : a + s + WINDOW - 1], digest_size=8).digest(), "little", signed=True) for a, s in zip(starts.tolist(), sizes.tolist())]
                    if digests:
                        same = lambda x, kind: pa.array([x] * len(digests), kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([same(ident, pa.binary()), pa.array(starts.astype(np.int64)), pa.array(sizes.astype(np.int32)), pa.array(keys), pa.array(digests, pa.int64()), same(n, pa.int64())], names)

    return arrow(pieces, run, "id binary, at long, size int, key long, segment long, n long")


def _may_hold(bloom: np.ndarray, bits: int, ident: bytes) -> bool:
    """Whether a filter over Spark's xxhash64 of ids may hold one."""
    return bool(bloom_hits(bloom, bits, np.array([xxhash.xxh64_intdigest(ident, 42)], np.uint64))[0])


def fetched(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, segment, n, body): the bytes of ``wanted`` segments (of: id, at, size; key, segment, n), each from one of the texts that hold it."""
    own = F.struct(F.col("of.at").alias("at"), F.col("of.size").alias("size"), "key", "segment", "n")
    lists = cut(wanted.groupBy(F.col("of.id").alias("id")).agg(F.collect_list(own).alias("own")))
    held, bits = bloom_of(lists.select(F.xxhash64("id").alias("k")), "k")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, sent = np.frombuffer(held, np.uint8), set()
        for batch in batches:
            out = []
            for ident, body, _ in _pieces(batch):
                if ident not in sent and _may_hold(bloom, bits, ident):
                    if len(sent) >= SEEN:
                        sent.clear()
                    sent.add(ident)
                    out.append((ident, body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["id", "body"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, own = batch["body"][i].as_py(), batch["own"][i].as_py()
                parts = [body[o["at"] : o["at"] + o["size"] + WINDOW - 1] for o in own]
                yield pa.RecordBatch.from_arrays([*(pa.array([o[c] for o in own], pa.int64()) for c in ("key", "segment", "n")), pa.array(parts, pa.binary())], ["key", "segment", "n", "body"])

    rows = arrow(pieces, texts, "id binary, body binary").join(lists, "id").select("body", "own")
    each = arrow(rows, cut_out, "key long, segment long, n long, body binary")
    return each.groupBy("key", "segment").agg(F.max("n").alias("n"), F.first("body").alias("body"))


_MARKS = "key long, segment long, spans array<struct<first: int, last: int>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def sorted_shards(bodies: DataFrame, shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """(key, segment, spans): the windows of each segment, as ranges, that occur again in a segment of its shard or in a copy of its own."""
    total = bodies.agg(F.sum(F.octet_length("body") + 1)).first()[0] or 0
    dealt = bodies.repartition(max(1, -(-total // shard_bytes)), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        with tempfile.TemporaryDirectory(prefix="suffixes-", dir=local if local and os.path.isdir(local) else None) as folder:
            meta, path, n = [], os.path.join(folder, "text"), 0
            with open(path, "wb") as f:
                for batch in batches:
                    sizes = []
                    for body in batch["body"]:
                        f.write(data := body.as_py() + b"\xff")
                        sizes.append(len(data))
                    if sizes:
                        meta.append((batch["key"].to_numpy(), batch["segment"].to_numpy(), batch["n"].to_numpy(), np.array(sizes)))
                        n += sum(sizes)
                f.write(bytes(WINDOW + 8))
            if not n:
                return
            marks = repeated(np.asarray(np.memmap(path, np.uint8, "r"))[:n], folder, WINDOW, memory)
            at = 0
            for key, segment, copies, sizes in meta:
                spans = []
                for c, size in zip(copies.tolist(), sizes.tolist()):
                    windows = size - WINDOW
                    hit = np.ones(windows, bool) if c > 1 else np.asarray(marks[at : at + windows])
                    edges = np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist()
                    spans.append([{"first": a, "last": b} for a, b in zip(edges[::2], edges[1::2])])
                    at += size
                keep = np.flatnonzero([bool(s) for s in spans])
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(segment[keep]), pa.array([spans[i] for i in keep], _SPANS)], ["key", "segment", "spans"])

    return arrow(dealt, run, _MARKS)


def repeats(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(id, spans) of the pieces that hold a window which occurs again: its first bytes, as distinct ranges (first, last, which is exclusive) that may overlap.

    ``pieces``: body, perhaps with an id and a number of copies; without an id each row counts, and equal texts share one.
    """
    gram = GRAMS[level]
    counts = cut(anchor_counts(pieces, gram).select("key"))
    held, bits = bloom_of(counts, "key")
    places = written(placed(pieces, gram, held, bits), "places")
    release(pieces.sparkSession)
    segments = cut(places.groupBy("key", "segment").agg(F.sum("n").alias("n"), F.min(F.struct("id", "at", "size")).alias("of")))
    kinds = segments.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    classed = cut(segments.join(kinds, "key").drop("total"))
    release(pieces.sparkSession)
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("of.size").alias("last")))
    marks = classed.where("kinds = 1").select("key", "segment", whole.alias("spans"))
    bodies = cut(fetched(pieces, classed.where((F.col("kinds") > 1) & (F.col("kinds") <= HOT))))
    marks = marks.unionByName(sorted_shards(bodies))
    hot = classed.where(F.col("kinds") > HOT)
    if level + 1 < len(GRAMS) and not hot.isEmpty():
        ident = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("key", "segment"))))
        inner = written(fetched(pieces, hot).select(ident.alias("id"), "body", "n", "key", "segment"), "hot")
        own = inner.select("id", "key", "segment")
        found = repeats(inner.select("id", "body", "n"), level + 1).join(own, "id")
        marks = marks.unionByName(found.select("key", "segment", F.transform("spans", lambda s: F.struct(s["first"].cast("int").alias("first"), s["last"].cast("int").alias("last"))).alias("spans")))
    marks = cut(marks)
    release(pieces.sparkSession)
    met = places.join(marks, ["key", "segment"]).select("id", "at", F.explode("spans").alias("s"))
    return met.groupBy("id").agg(F.collect_set(F.struct((F.col("at") + F.col("s.first")).alias("first"), (F.col("at") + F.col("s.last")).alias("last"))).alias("spans"))


def merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the windows of some ranges of first bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["last"] + WINDOW - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, min(b, n)))
    return out


def removed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of each document: removed byte ranges, and the digest of the bytes that stay.

    Texts without a repeat are judged where they are read; the others meet their ranges in a join.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("body"))
    spans = cut(repeats(docs.select("body")))
    release(spark)
    held, bits = bloom_of(spans.select(F.xxhash64("id").alias("k")), "k")

    def some(clean: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bloom = np.frombuffer(held, np.uint8)
            for batch in batches:
                out = []
                for doc, body in zip(batch["doc_id"].to_pylist(), batch["body"]):
                    body = body.as_py()
                    ident = hashlib.md5(body).digest()
                    if _may_hold(bloom, bits, ident) != clean:
                        out.append((doc, ident, body))
                if clean:
                    yield _judged((d, b, []) for d, _, b in out)
                elif out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "id", "body"])

        return run

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield _judged((d, b.as_py(), s.as_py() or []) for d, b, s in zip(part["doc_id"].to_pylist(), part["body"], part["spans"]))

    clean = arrow(docs, some(True), _JUDGED)
    hit = arrow(docs, some(False), "doc_id long, id binary, body binary").join(spans, "id", "left").select("doc_id", "body", "spans")
    return clean.unionByName(arrow(hit, judge, _JUDGED))


_JUDGED = "doc_id long, n_bytes long, removed array<struct<first: long, last: long>>, kept binary"


def _judged(rows) -> pa.RecordBatch:
    out: list[tuple] = []
    for doc, body, spans in rows:
        gone = merged(spans, len(body))
        kept, at = hashlib.sha256(), 0
        for a, b in gone:
            kept.update(body[at:a])
            at = b
        kept.update(body[at:])
        out.append((doc, len(body), [{"first": a, "last": b} for a, b in gone], kept.digest()))
    columns = list(zip(*out)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "removed", "kept"])


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: what of each repeats anywhere, and what stays."""
    rows = removed(table(spark, sf_dir, "documents"))
    covered = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return rows.select("doc_id", "n_bytes", covered.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
