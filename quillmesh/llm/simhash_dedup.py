"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; two documents link at up to ``DISTANCE`` = 2 differing bits. Cut into
two segments of 32 bits, one segment then differs by at most one bit. Each distinct
fingerprint is indexed under 64 keys: a segment with one of its bits made a wildcard. An equality join on
the keys gives the candidates, the popcount of their difference verifies them.

A bucket of two is read off one aggregation (its smallest and largest member). The members of
larger buckets, which a group of near copies fills, are refined instead of paired: each is
indexed under the 65 values within one bit of it, so that two members share such a value exactly
if they differ by up to two bits. A value has at most 65 distinct members, all of them linked, and a star to the smallest
keeps every link's effect. No bucket is capped and none is expanded into all pairs.

``similar`` takes the method to a Jaccard similarity, by default 0.8 of five-word shingles, at which a tenth and more of
the bits differ. Its fingerprint is wider: ``SEGMENTS`` segments of ``WIDTH`` = 24 bits, each set by the distinct shingles. Texts meet where any
segment differs by at most one bit, and are verified by the exact similarity of their shingles. A segment value is indexed once
for all texts that share it, by the least of them; a value's variants are written only for its zero bits, since a value with that bit
set is its own other variant. So a bucket holds a value and those of its neighbours that exist, however many texts there are. The search finds a pair of
similarity 0.8 with probability 0.91 if segments are independent, of 0.9 with 0.998. Pairs that meet by chance grow with the square of the texts over 2**WIDTH: past some 10**7 different texts ``width`` should grow (28 bits need 36 segments).

What the segments miss is then searched exactly, between different components alone. A pair of similarity s has its first common shingle, in any one order of all shingles, among the first
n - ceil(s * n) + 1 of both texts (of n shingles). The order puts shingles first that are rare in a sample of texts, so that buckets are small; the sample bears on speed alone.
Shingles that stand in one text only are dropped by a Bloom filter. Buckets are paired by component before they are paired by text, so a group that the segments have joined costs nothing more, and lengths,
places in the order and parities rule pairs out before texts are compared: two texts' parities of the counts of their shingles by slot differ in no more slots than there are shingles in one text alone. ``SKETCH`` words of
parities go with the shingles, and wider ones, as many slots as a text has shingles, with the pairs that are left; only pairs that pass both are given their texts. What is left of a bucket is the pairs of texts of different components, which nothing bounds but these filters.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other;
repeated rows stay, each with its component; rows without an id take part, but a component's id is
its smallest non-null id; further columns are ignored; an empty table gives no rows. ``deduplicated`` keeps one row of each component, also of one
without any id, and tells rows apart by id and text, not by id alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bitmap_of, bits_for, bloom_hits, bloom_of, cut, fresh, release, sized, table, text_bytes, text_id
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Of ``similar``: words of a shingle, least similarity, segments of its fingerprint and their bits.
WORDS, SIMILARITY, SEGMENTS, WIDTH = 5, 0.8, 22, 24
#: Share of differing bits beyond which a candidate isn't verified: pairs of similarity 0.8 differ in 0.15 of them, others in half.
FAR = 0.25
#: Texts, about, of which shingles are counted to order them, and in how many of these a shingle is listed, at most how many.
SAMPLE, LISTED, MOST_LISTED = 1 << 13, 3, 1 << 18
#: Words of 64 parities that go with each shingle of the exact search, and the most parities of a text.
SKETCH, MOST_PARITIES = 4, 1 << 20
#: Shingles hashed at once: bounds the memory that a very long text takes.
CHUNK = 1 << 16


def _lanes() -> np.ndarray:
    """For each byte its eight bits, each in a lane of eight bits of one word."""
    bits = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)
    return (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


_LANES = _lanes()


def _bit_counts(hashes: np.ndarray, counts: np.ndarray) -> None:
    """Adds to counts[64] how many of the hashes have each bit set; lanes of 8 bits hold up to 255."""
    for at in range(0, len(hashes), 255):
        octets = hashes[at : at + 255].view(np.uint8).reshape(-1, 8)
        counts += _LANES[octets].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: lower-cases A-Z alone and splits at ASCII white space alone
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
        _bit_counts(hashes, counts)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(F.col(text_col)).alias("t"))
    return arrow(rows, _fingerprints, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(fp, key) for each of the 64 one-wildcard segment variants of each fingerprint."""
    segment = F.expr("if(slot < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))")
    rows = fps.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("segment", segment)
    return rows.select("fp", F.expr("shiftleft(cast(slot as bigint), 32) | (segment & ~shiftleft(1L, slot % 32))").alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links that join the distinct fingerprints of ``fps`` exactly as all links within DISTANCE do."""
    near = F.expr(f"bit_count(u ^ v) <= {DISTANCE} and u != v")
    keyed = variants(fps)
    buckets = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n >= 2"))
    pairs = buckets.where("n = 2").select("u", "v").distinct().where(near)
    members = keyed.join(buckets.where("n >= 3").select("key"), "key", "left_semi").select("fp").distinct()
    within = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    balls = members.select("fp", F.explode(within).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("at")).where(F.size("at") > 1)
    stars = balls.select(F.array_min("at").alias("u"), F.explode("at").alias("v")).where(near).distinct()
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    rows = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = cut(rooted.join(ids, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    step = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    parts = [w[j : n + j] * step[j] for j in range(min(size, len(w)))]
    return np.unique(_mix(np.sum(parts, axis=0, dtype=np.uint64)))


def wide_fingerprint(text: bytes, size: int = WORDS, segments: int = SEGMENTS, width: int = WIDTH) -> np.ndarray:
    """Segments of the SimHash of a text's distinct shingles; each 64-bit word of it has its own hash of a shingle."""
    h = shingle_set(text, size)
    octets = []
    for k in range(-(-segments * width // 64)):
        counts = np.zeros(64, dtype=np.int64)
        if len(h):
            _bit_counts(_mix(h ^ _mix(np.array([k + 1], np.uint64))), counts)
        octets.append((counts * 2 > len(h)).astype(np.uint8))
    bits = np.concatenate(octets)[: segments * width].reshape(segments, width)
    return bits @ (np.int64(1) << np.arange(width, dtype=np.int64))


def jaccard(a: bytes, b: bytes, size: int = WORDS) -> float:
    """Similarity of two texts' shingle sets; two texts without words are equal."""
    x, y = shingle_set(a, size), shingle_set(b, size)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0


def _wide(size: int, segments: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [wide_fingerprint(t.as_py(), size, segments, width) for t in b.column(1)]
            flat = pa.array(np.concatenate(made) if made else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * segments), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["text", "segments"])

    return run


def _verified(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = pa.array([jaccard(x.as_py(), y.as_py(), size) >= least for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in b.columns[:2]], names=["u", "v"])

    return run


def _slot(key: np.ndarray, width: int) -> np.ndarray:
    """Where a key stands in the bitmap, before the remainder: its value, moved on by its segment's number."""
    return (key & (1 << width) - 1) ^ (key >> width) * 0x9E3779B1


def _variants(bitmap, bits: int, width: int):
    """(key, w) of the one-bit-more variants of (key, least) whose own bit of the bitmap is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ones = np.frombuffer(bitmap.value, np.uint8), np.int64(1) << np.arange(width, dtype=np.int64)
        for b in batches:
            key, node = (b.column(i).to_numpy() for i in (0, 1))
            row, bit = np.nonzero(key[:, None] & ones == 0)
            more = key[row] | ones[bit]
            at = _slot(more, width) & (bits - 1)
            hit = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(more[hit]), pa.array(node[row[hit]])], names=["key", "w"])

    return run


def candidates(values: DataFrame, width: int = WIDTH) -> DataFrame:
    """(u, v), u < v: nodes one of whose segments differs by at most one bit; values: (node, key), the key a segment's number above its ``width`` bits.

    Of the nodes that share a key the least stands for all: each of them is paired with it, and it alone meets the neighbouring keys. Variants that
    a bitmap of the keys rules out aren't shuffled.
    """
    least = cut(values.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last")))
    shared = values.join(least.where("least != last").select("key", "least"), "key")
    same = shared.where("node != least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    bits = bits_for(least.count())
    spread = F.col("key").bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(F.shiftright("key", width) * F.lit(0x9E3779B1))  # as _slot
    held = values.sparkSession.sparkContext.broadcast(bitmap_of(least.select(spread.bitwiseAND(F.lit(bits - 1)).alias("at")), "at", bits))
    variants = arrow(least.select("key", "least"), _variants(held, bits, width), "key long, w long")
    beside = variants.join(least.select("key", "least"), "key").select(F.least("w", "least").alias("u"), F.greatest("w", "least").alias("v"))
    return same.unionAll(beside).distinct()


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` slots, a power of two from 8, whether the hashes in it are odd in number; packed to bytes."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def _marks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column(1)]
            made = [parities(h, 1 << (min(MOST_PARITIES, max(64 * SKETCH, len(h))) - 1).bit_length()).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(made, pa.binary())], names=["text", "n", "odd"])

    return run


def alike(n: int, odd: bytes, m: int, also: bytes, similarity: float) -> bool:
    """Whether texts of n and m shingles with these parities may be of ``similarity``. The wider parities are folded to as many as the others."""
    x, y = np.frombuffer(odd, np.uint8), np.frombuffer(also, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, width), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, odd, m, also = (b.column(c).to_pylist() for c in ("nx", "oddx", "ny", "oddy"))
            may = pa.array([alike(*x, similarity) for x in zip(n, odd, m, also)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(may) for c in ("ru", "rv", "tu", "tv")], names=["ru", "rv", "tu", "tv"])

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t.as_py(), size) for t in b.column(1)]
            flat = np.concatenate(made).view(np.int64) if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["token"])

    return run


def _listed(texts: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of about SAMPLE of the ``n`` different texts, sorted, and in how many of these each stands."""
    below = min(1.0, SAMPLE / max(1, n)) * 2.0**32
    some = texts.where(F.conv(F.substring(F.hex("text"), 1, 8), 16, 10).cast("long") < below).dropDuplicates(["text"])
    counts = arrow(some, _shingles(size), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LISTED)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_LISTED).toArrow()  # bounded by MOST_LISTED
    token, n_in = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n_in[order]


def prefix(h: np.ndarray, least: float, listed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of a text's shingles, listed ones last, of which a text of similarity ``least`` must share one."""
    if not len(h):
        return h
    rank = np.zeros(len(h), np.int64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        rank = np.where(listed[at] == h, counts[at], 0)
    keep = len(h) - max(1, math.ceil(least * len(h) - 1e-9)) + 1
    return h[np.lexsort((h, rank))[:keep]]


_SKETCH = [f"s{i}" for i in range(SKETCH)]


def _prefixes(size: int, least: float, order, held=None):
    """(token, id) of prefixes, id the start of a text's id; or, with a filter of tokens, (token, id, n, at, s0, s1 ..) of those that it lets pass, n the text's shingles and s its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sets = [shingle_set(t.as_py(), size) for t in b.column(1)]
            made = [prefix(h, least, *order.value) for h in sets]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            token, row = np.concatenate(made), np.repeat(np.arange(len(made)), sizes)
            ids = np.fromiter((int.from_bytes(t.as_py()[:8], "big", signed=True) for t in b.column(0)), np.int64, len(made))
            if held is None:
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids[row])], names=["token", "id"])
                continue
            hit = np.flatnonzero(bloom_hits(np.frombuffer(held[0].value, np.uint8), held[1], token))
            at = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[hit].astype(np.int32)
            n = np.fromiter(map(len, sets), np.int32, len(sets))[row[hit]]
            odd = np.stack([parities(h, 64 * SKETCH).view("<i8") for h in sets])[row[hit]]
            columns = [token[hit].view(np.int64), ids[row[hit]], n, at, *(np.ascontiguousarray(c) for c in odd.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "id", "n", "at", *_SKETCH])

    return run


def missed(rows: DataFrame, rooted: DataFrame, size: int, similarity: float) -> DataFrame:
    """(ru, rv, tu, tv): all pairs of texts of different roots that may be of ``similarity``, by their roots and their ids; rows: (text, t), rooted: (text, node, root).

    Exact: a pair that isn't given isn't similar.
    """
    context = rows.sparkSession.sparkContext
    order = context.broadcast(_listed(rows, size, rooted.count()))
    each = arrow(rows, _prefixes(size, similarity, order), "token long, id long")
    shared = cut(each.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("token"))
    filter_, bits = bloom_of(shared, "token")
    schema = "token long, id long, n int, at int, " + ", ".join(f"{c} long" for c in _SKETCH)
    hits = arrow(rows, _prefixes(size, similarity, order, (context.broadcast(filter_), bits)), schema)
    named = rooted.select(F.expr("cast(conv(substring(hex(text), 1, 16), 16, -10) as long)").alias("id"), "node", "root")
    hits = cut(hits.join(named, "id").dropDuplicates(["id", "token"]).select("token", "node", "root", "n", "at", *_SKETCH))
    mixed = hits.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a != z").select("token")
    members = cut(hits.join(sized(cut(mixed)), "token", "left_semi"))
    release(rows.sparkSession)
    ends = [F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("room")]
    groups = cut(members.groupBy("token", "root").agg(*ends, *(f(c).alias(f"{n}{c}") for c in _SKETCH for n, f in (("every", F.bit_and), ("any", F.bit_or)))))
    side = lambda df, x: df.select("token", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "token"))
    share = similarity / (1 + similarity)
    most = f" * {1 - 2 * share!r} + 1e-6"  # times the shingles of both: what two texts may differ in
    apart = " + ".join(f"bit_count((every{c}_u & ~any{c}_v) | (every{c}_v & ~any{c}_u))" for c in _SKETCH)  # all members of one group from all of the other
    odd = " + ".join(f"bit_count({c}_u ^ {c}_v)" for c in _SKETCH)
    reach = F.expr(f"root_u < root_v and high_u >= low_v * {similarity} - 1e-6 and high_v >= low_u * {similarity} - 1e-6 and least(room_u, room_v) >= (low_u + low_v) * {share!r} - 1e-6")
    both = side(groups, "u").join(side(groups, "v"), "token").where(reach & F.expr(f"{apart} <= (high_u + high_v){most}")).select("token", "root_u", "root_v")
    pairs = both.join(side(members, "u"), ["token", "root_u"]).join(side(members, "v"), ["token", "root_v"])
    common = F.expr(f"least(n_u - at_u, n_v - at_v) >= (n_u + n_v) * {share!r} - 1e-6 and {odd} <= (n_u + n_v){most}")  # with this as the first in common
    near = F.expr(f"least(n_u, n_v) >= greatest(n_u, n_v) * {similarity} - 1e-6")
    pairs = pairs.where(near & common).select(*(F.col(f"{c}_{x}").alias(f"{c[0]}{x}") for x in "uv" for c in ("node", "root"))).distinct()
    text = lambda x: rooted.select(F.col("node").alias(f"n{x}"), F.col("text").alias(f"t{x}"))
    pairs = cut(sized(cut(pairs)).join(text("u"), "nu").join(text("v"), "nv").select("ru", "rv", "tu", "tv"))
    marks = arrow(rows.join(_texts(pairs), "text", "left_semi"), _marks(size), "text binary, n long, odd binary")
    marks = cut(marks.groupBy("text").agg(F.first("n").alias("n"), F.first("odd").alias("odd")))
    mark = lambda t, x: marks.select(F.col("text").alias(t), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}"))
    return cut(arrow(pairs.join(mark("tu", "x"), "tu").join(mark("tv", "y"), "tv"), _alike(similarity), "ru long, rv long, tu binary, tv binary"))


def _texts(pairs: DataFrame) -> DataFrame:
    """(text): the different texts of pairs (.., tu, tv)."""
    return sized(cut(pairs.select("tu").unionAll(pairs.select("tv")).distinct().withColumnRenamed("tu", "text")))


def _links(rows: DataFrame, pairs: DataFrame, size: int, similarity: float, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v), by the names given, of the pairs (.., tu, tv) whose texts are of ``similarity``."""
    wanted = cut(rows.join(_texts(pairs), "text", "left_semi").groupBy("text").agg(F.first("t").alias("t")))
    both = pairs.join(wanted.select(F.col("text").alias("tu"), F.col("t").alias("x")), "tu").join(wanted.select(F.col("text").alias("tv"), F.col("t").alias("y")), "tv")
    return arrow(both.select(F.col(u).alias("u"), F.col(v).alias("v"), "x", "y"), _verified(size, similarity), "u long, v long")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, similarity: float = SIMILARITY, segments: int = SEGMENTS, width: int = WIDTH) -> DataFrame:
    """(text, root): each different text by its ``text_id``, and the component of similar texts that it is in. No pair of ``similarity`` (above 0) is left out."""
    rows = docs.select(text_id(F.col(f"`{text_col}`")).alias("text"), text_bytes(F.col(f"`{text_col}`")).alias("t"))
    made = arrow(rows, _wide(size, segments, width), "text binary, segments array<long>")
    # nodes are numbered as they are written: a checkpoint holds one numbering, whatever is run again
    texts = cut(made.groupBy("text").agg(F.first("segments").alias("segments")).withColumn("node", F.monotonically_increasing_id()))
    values = texts.select("node", F.posexplode("segments").alias("at", "value")).select("node", F.expr(f"shiftleft(cast(at as bigint), {width}) | value").alias("key"))
    pairs = candidates(values, width)
    own = texts.select("node", "text", "segments")
    pairs = pairs.join(own.select(F.col("node").alias("u"), F.col("text").alias("tu"), F.col("segments").alias("su")), "u")
    pairs = pairs.join(own.select(F.col("node").alias("v"), F.col("text").alias("tv"), F.col("segments").alias("sv")), "v")
    differing = F.aggregate(F.zip_with("su", "sv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    pairs = cut(pairs.where(differing <= FAR * segments * width).select("u", "v", "tu", "tv"))
    release(docs.sparkSession)
    roots = components(_links(rows, pairs, size, similarity))
    rooted = cut(texts.join(roots, "node", "left").select("text", "node", F.coalesce("root", "node").alias("root")))
    release(docs.sparkSession)
    more = components(_links(rows, missed(rows, rooted, size, similarity), size, similarity, "ru", "rv"))
    return rooted.join(sized(cut(more.select(F.col("node").alias("root"), F.col("root").alias("joined")))), "root", "left").select("text", F.coalesce("joined", "root").alias("root"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component of ``similar`` texts: of its smallest id and, among texts of that id, the smallest ``text_id``.

    Rows without an id come last. Of several rows of that id and text one stays.
    """
    text, at = fresh(docs, "kept_text"), fresh(docs, "kept_id")
    ours = docs.withColumn(text, text_id(F.col(f"`{text_col}`"))).withColumn(at, F.col(f"`{id_col}`").cast("long"))
    each = ours.groupBy(F.col(text).alias("text"), F.col(at).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    each = cut(each.join(similar(docs, id_col, text_col, **options), "text"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "text")).alias("k"))
    judged = cut(each.join(first, "root").withColumn("kept", (F.col("text") == F.col("k.text")) & F.col("id").eqNullSafe(F.col("k.id"))).where("not kept or n > 1").select("text", "id", "kept"))
    same = (F.col(f"a.{text}") == F.col("b.text")) & F.col(f"a.{at}").eqNullSafe(F.col("b.id"))
    gone, repeated = sized(judged.where("not kept")), judged.where("kept")
    kept = ours.alias("a").join(gone.alias("b"), same, "left_anti")
    if not repeated.isEmpty():
        repeated = sized(repeated)
        once, again = (kept.alias("a").join(repeated.alias("b"), same, how) for how in ("left_anti", "left_semi"))
        kept = once.unionAll(again.dropDuplicates([text, at]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
