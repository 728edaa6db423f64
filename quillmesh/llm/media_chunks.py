"""Media columns by content-defined chunking of payloads.

A payload is stored as a WAV file of 8-bit mono samples. A rolling gear hash cuts the file where its low
bits are zero, so equal stretches give equal chunks wherever they stand. Chunks are named by
digest. An aggregation finds the digests that occur more than once; those chunks go to a store with one row for
each digest, the others stay in their file's own row. A file is an ordered list of chunks, and joining
the list with the store gives its bytes back, which are verified against the digest of the whole file before any
feature is computed from them.

Which digests are shared reaches the tasks as a bitmap of ``BITMAP_BITS`` bits, whatever the corpus: a
false positive sends a chunk to the store that nobody shares, and never loses one. Only shared
chunks and the files that have some are shuffled, and of equal files one: a file is named by the digest of its bytes, not by a row number, so a task that
runs again names the same files. Its features then go to the rows that have it.

Defined cases: null and empty texts are one block of zeros; equal texts give equal files and features; repeated rows and
rows without an id each have their result; a payload of any length is cut whole; further columns are ignored; an empty table gives no
rows. A chunk that is missing or altered raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, table, text_bytes

#: Bytes of a chunk: least, mean (a power of two) and most.
LEAST, MEAN, MOST = 256, 1024, 8192
BLOCK, RATE = 64, 8000
BITMAP_BITS = 1 << 23
_WINDOW = 32


def _gear() -> np.ndarray:
    """A word for each byte, from a rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)


_GEAR = _gear()


def payload(text: bytes) -> bytes:
    """A text's bytes, filled up with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or struct.unpack("<I", media[40:44])[0] != len(media) - 44:
        raise ValueError("not a file of this format")
    return media[44:]


def rolling(data: bytes) -> np.ndarray:
    """The gear hash at each byte: the sum of gear[byte] << age over the last 32 bytes, by doubling."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < _WINDOW and span < len(h):
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    marks = np.flatnonzero((rolling(data) >> np.uint32(8)) & np.uint32(MEAN - 1) == 0) + 1
    ends, start, n = [], 0, len(data)
    for m in marks.tolist():
        while m - start > MOST:
            start += MOST
            ends.append(start)
        if m - start >= LEAST:
            ends.append(m)
            start = m
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n or not ends:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    out, start = [], 0
    for end in cuts(data):
        part = data[start:end]
        out.append((hashlib.blake2b(part, digest_size=16).digest(), part))
        start = end
    return out


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little") % BITMAP_BITS


def features(media: bytes) -> str:
    """Whole-number features of the samples: count, sum, sum of squares about 128, crossings of 128, least and greatest."""
    x = np.frombuffer(samples(media), dtype=np.uint8).astype(np.int64)
    y = x - 128
    return f"n={len(x)};sum={x.sum()};square={(y * y).sum()};cross={np.count_nonzero((y[1:] >= 0) != (y[:-1] >= 0))};min={x.min()};max={x.max()}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = Counter(d for t in b.column(0) for d, _ in chunks(wav(payload(t.as_py()))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"])


def shared_bitmap(texts: DataFrame) -> bytes:
    """Bits of the digests that occur more than once; texts: one binary column."""
    shared = arrow(texts, _digests, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    octet = lambda i: F.conv(F.hex(F.substring("digest", i, 1)), 16, 10).cast("long") * (1 << 8 * (i - 1))
    at = shared.select(((octet(1) + octet(2) + octet(3) + octet(4)) % BITMAP_BITS).alias("at"))
    parts = at.groupBy(F.expr("at div 32768").alias("page")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits")).collect()
    out = bytearray(BITMAP_BITS // 8)
    for p in parts:
        out[p["page"] * 4096 : p["page"] * 4096 + len(p["bits"])] = p["bits"]
    return bytes(out)


_ROW = "doc_id long, n_bytes long, media_sha256 binary, refs int, parts array<struct<ord:int,digest:binary,payload:binary>>"
_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            found = {d: p for t in b.column(0) for d, p in chunks(wav(payload(t.as_py()))) if bits[(i := _slot(d)) >> 3] >> (i & 7) & 1}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "payload"])

    return run


def _files(bitmap):
    kind = pa.list_(pa.struct([("ord", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sizes, shas, refs, lists = [], [], [], []
                for t in part.column(1):
                    text = t.as_py()
                    media = wav(payload(text))
                    row = [{"ord": o, "digest": d, "payload": None if bits[(i := _slot(d)) >> 3] >> (i & 7) & 1 else p} for o, (d, p) in enumerate(chunks(media))]
                    sizes.append(len(text))
                    shas.append(hashlib.sha256(media).digest())
                    refs.append(sum(c["payload"] is None for c in row))
                    lists.append(row)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(refs, pa.int32()), pa.array(lists, kind)], names=["doc_id", "n_bytes", "media_sha256", "refs", "parts"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for want, parts in zip(b.column(2), b.column(3)):
            media = b"".join(c["payload"] or b"" for c in sorted(parts.as_py(), key=lambda c: c["ord"]))
            sha = hashlib.sha256(media)
            if sha.digest() != want.as_py():
                raise ValueError("a media file read back differs from the one stored")
            data = samples(media)
            for column, x in zip(out, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), sha.hexdigest(), features(media))):
                column.append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(files, store): each row's ordered chunk list, and one payload for each digest that a list refers to."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("t"))
    bitmap = docs.sparkSession.sparkContext.broadcast(shared_bitmap(rows.select("t")))
    store = arrow(rows.select("t"), _store(bitmap), "digest binary, payload binary").groupBy("digest").agg(F.first("payload").alias("payload"))
    return arrow(rows, _files(bitmap), _ROW), store


def read_back(files: DataFrame, store: DataFrame) -> DataFrame:
    """Verified features of each file, its chunks joined from the store where its list refers to it."""
    columns = ["doc_id", "n_bytes", "media_sha256", "parts"]
    alone = arrow(files.where("refs = 0").select(*columns), _features, _OUT)
    some = files.where("refs > 0")
    each = some.select("media_sha256", F.explode("parts").alias("c")).select("media_sha256", "c.*")
    own = each.where("payload is not null").groupBy("media_sha256", "ord").agg(F.first("payload").alias("payload"))
    fetched = each.where("payload is null").select("media_sha256", "ord", "digest").distinct().join(cut(store), "digest", "left").select("media_sha256", "ord", "payload")
    whole = own.unionAll(fetched).groupBy("media_sha256").agg(F.collect_list(F.struct("ord", "payload")).alias("parts"))
    none = F.lit(None).cast("long")
    made = arrow(whole.select(none.alias("doc_id"), none.alias("n_bytes"), "media_sha256", "parts"), _features, _OUT).drop("doc_id", "n_bytes")
    rows = some.select("doc_id", "n_bytes", F.lower(F.hex("media_sha256")).alias("media_sha256"))
    return alone.unionByName(rows.join(made, "media_sha256"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text stored as media, read back and measured."""
    return read_back(*stored(table(spark, sf_dir, "documents")))
