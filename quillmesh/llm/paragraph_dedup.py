"""Substring deduplication: MinHash banding of paragraphs, verified, with removals clustered by components.

A paragraph is a stretch of ``WORDS`` = 24 words. One starts at every line that is as long, and wherever the hash of a five-word shingle is the
least of ``EVERY`` neighbours, so two texts that share a passage share its paragraphs wherever the passage stands; every
passage of 51 words holds one at least. With ``line_words`` a
line of as many words is a unit too, whole, which repeats where another line has the same words; near duplicates of lines are not looked for. The query leaves that out: some short lines stand in a tenth of all
documents, whose own text they say nothing of. A paragraph is the multiset of its 20 shingles
(a shingle's second occurrence is another element), so all have one size and a Jaccard similarity of 0.8 means 18 common elements.

Equal paragraphs meet by their digest. Near duplicates collide when all ``ROWS`` MinHash values of one of ``BANDS`` bands agree: 4 bands
of 2 find a pair of similarity 0.8 with probability 0.983 and one of 0.9 with 0.999. All paragraphs are banded; of overlapping paragraphs of a
text that have a band's key in common the first stands for the others when collisions are looked for, since they can't repeat each other.
Paragraphs that collide are joined within small buckets and
verified by their exact common elements. In a larger bucket every paragraph is indexed by its 211 subsets of at least 18 elements instead:
two share a subset of 18 exactly if they have 18 in common, so stars over those keys keep every link without
pairing a group's members. Components of the links are the clusters; the occurrence of smallest (doc_id, text, word)
stays, the others are removals. Overlapping paragraphs of a document merge into spans.

The texts are read three times: for the keys, which are counted; for the elements of paragraphs whose keys come again; for the places of those that repeat.
The later passes leave out the rest by a Bloom filter that grows with the number of keys, up to 32 MB; a false positive costs a row and no result.

Defined cases: null, empty and shorter texts have no paragraph; a paragraph repeated within one row counts at each
place that doesn't overlap the one before; rows of one id and text are one document, rows that differ in either are two, and rows without an id never come first;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, bloom_hits, bloom_of, cut, release, table
from .components import components

WORDS, SHINGLE, EVERY = 24, 5, 20
BANDS, ROWS, SMALL = 4, 2, 32
ELEMENTS = WORDS - SHINGLE + 1
#: Words that part the starts of two paragraphs of a text, but for those of lines: at fewer, they would have COMMON elements in common.
APART = 3
#: Common elements of two paragraphs of similarity 0.8: common / (40 - common) >= 0.8.
COMMON = -(-8 * 2 * ELEMENTS // 18)
#: Bytes of texts whose paragraphs are held at once, and of a piece of them that is cut into words at once.
GROUP_BYTES, PIECE_BYTES = 1 << 20, 1 << 22
#: Digests that a task remembers to have sent.
SEEN = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(first: int, n: int) -> np.ndarray:
    return _mix(np.arange(first, first + n, dtype=np.uint64)) | np.uint64(1)


_STEP, _SCALE = _odd(1, SHINGLE), _odd(101, BANDS * ROWS)
#: Factors of a letter by its place in the word, and by 256 places.
_PLACE, _FAR = _odd(1001, 256), _odd(2001, 256)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Letters as numbers, A-Z as a-z.
_LETTER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], np.uint64)


def _running(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``size`` neighbours, by doubling."""
    pick, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= size:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def anchors(h: np.ndarray, text: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Positions whose hash is the least of some ``every`` neighbours in their text, or of the whole text if it has fewer.

    h, text: hash and text of each position, a text's positions in a row. Of positions less than APART from each other the one of least hash stays:
    paragraphs so close would be each other's near duplicates. Equal hashes are ordered by a mix of their positions.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(first, len(h)))
    chosen = (h == np.repeat(np.minimum.reduceat(h, first), size)) & np.repeat(size < every, size)
    if len(h) >= every:
        least = np.where(text[: len(h) - every + 1] == text[every - 1 :], _running(h, every, True), np.uint64(0))
        edge = np.zeros(every - 1, np.uint64)
        chosen |= (_running(np.concatenate([edge, least, edge]), every, False) == h) & np.repeat(size >= every, size)
    left, kept = np.flatnonzero(chosen), [np.zeros(0, np.int64)]
    order = _mix(left.astype(np.uint64))
    while len(left):
        wins, near = np.ones(len(left), bool), np.zeros(len(left), bool)
        pairs = []
        for lag in range(1, min(APART, len(left))):
            a, b = left[:-lag], left[lag:]
            close = (b - a < APART) & (text[a] == text[b])
            before = (h[a] < h[b]) | ((h[a] == h[b]) & (order[:-lag] <= order[lag:]))
            wins[lag:] &= ~(close & before)
            wins[:-lag] &= ~(close & ~before)
            pairs.append((lag, close))
        for lag, close in pairs:
            near[lag:] |= close & wins[:-lag]
            near[:-lag] |= close & wins[lag:]
        kept.append(left[wins])
        stay = ~wins & ~near
        left, order = left[stay], order[stay]
    return np.sort(np.concatenate(kept))


def _pieces(buffer: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a buffer, cut before white space."""
    at, space = 0, re.compile(rb"[\t-\r ]")
    while at < len(buffer):
        found = space.search(buffer, at + PIECE_BYTES) if len(buffer) - at > PIECE_BYTES else None
        end = found.start() if found else len(buffer)
        yield at, buffer[at:end]
        at = end


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, whether a line starts) of each word of several texts, A-Z lower-cased, parted by ASCII white space."""
    buffer = b"\n".join(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, starts, lines, line = [], [], [], 0
    for offset, piece in _pieces(buffer):
        a = np.frombuffer(piece, np.uint8)
        letter = ~_SPACE[a]
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(a == 10)
        lines.append((breaks[start] if len(start) else np.zeros(0, np.int64)) + line)
        line += int(breaks[-1]) if len(breaks) else 0
        starts.append(start + offset)
        if not len(start):
            hashes.append(np.zeros(0, np.uint64))
            continue
        size = end - start
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _LETTER[a[letter]] * _PLACE[place & 255]
        if size.max() > 256:
            value = np.where(place < 256, value, value * _FAR[(place >> 8) & 255])
        hashes.append(_mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _STEP[0]))
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    start, line_of = np.concatenate(starts), np.concatenate(lines)
    return np.concatenate(hashes), np.searchsorted(bounds, start, "right") - 1, np.diff(line_of, prepend=-1) > 0


def elements(parts: np.ndarray) -> np.ndarray:
    """Rows of shingles as rows of sorted, distinct elements: later occurrences become others."""
    s = np.sort(parts, axis=1)
    same = s[:, 1:] == s[:, :-1]
    if same.any():
        times = np.zeros(s.shape, np.uint64)
        for j in range(1, s.shape[1]):
            times[:, j] = np.where(same[:, j - 1], times[:, j - 1] + np.uint64(1), np.uint64(0))
        s = np.sort(np.where(times > 0, _mix(s + times * np.uint64(0x9E3779B97F4A7C15)), s), axis=1)
    return s


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, elements) of the paragraphs of several texts, in order."""
    return _paragraphs(*words_of(texts))


def _paragraphs(w: np.ndarray, text: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(w) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, ELEMENTS), np.uint64)
    n = len(w) - SHINGLE + 1
    h = _mix(sum(w[j : n + j] * _STEP[j] for j in range(SHINGLE)))
    whole = np.flatnonzero(text[: len(w) - WORDS + 1] == text[WORDS - 1 :])
    at = whole[anchors(h[whole], text[whole])]
    begins = np.flatnonzero(line)
    long = begins[np.diff(np.append(begins, len(w))) >= WORDS]
    at = np.union1d(at, long)
    first = np.searchsorted(text, text[at])
    return text[at], at - first, elements(h[at[:, None] + np.arange(ELEMENTS)])


def whole_lines(w: np.ndarray, text: np.ndarray, line: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words, digest) of the lines that have ``least`` words, none if that is None; a digest is an odd number."""
    begins = np.flatnonzero(line)
    if least is None or not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    size = np.diff(np.append(begins, len(w)))
    place = np.arange(len(w)) - np.repeat(begins, size)
    total = np.add.reduceat(w * (_mix(place.astype(np.uint64) + np.uint64(3001)) | np.uint64(1)), begins)
    total = _mix(_mix(total) + size.astype(np.uint64)) | np.uint64(1)
    mine = size >= least
    at = begins[mine]
    return text[at], at - np.searchsorted(text, text[at]), size[mine], total[mine]


def digests(e: np.ndarray) -> np.ndarray:
    """An odd number for each paragraph's elements; it names the paragraph."""
    return _mix(_mix(e).sum(axis=1, dtype=np.uint64)) | np.uint64(1)


def band_keys(e: np.ndarray) -> np.ndarray:
    """An even number for each paragraph and band."""
    least = np.stack([(e * a).min(axis=1) if len(e) else np.zeros(0, np.uint64) for a in _SCALE], axis=1).reshape(len(e), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(e), BANDS)).copy()
    for r in range(ROWS):
        key = _mix(key + least[:, :, r])
    return key & ~np.uint64(1)


def first_of_chain(key: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether no paragraph before it in the same text overlaps it and has the same key."""
    out = np.ones(len(key), bool)
    for lag in range(1, WORDS):
        if lag >= len(key):
            break
        overlaps = (row[lag:] == row[:-lag]) & (word[lag:] - word[:-lag] < WORDS)
        if not overlaps.any():
            break
        out[lag:] &= ~(overlaps & (key[lag:] == key[:-lag]))
    return out


def places(d: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which paragraphs don't overlap the last one taken of their digest and row."""
    order = np.lexsort((word, d, row))
    take = np.ones(len(order), bool)
    take[1:] = (row[order][1:] != row[order][:-1]) | (d[order][1:] != d[order][:-1])
    at, before, last = word[order], -2, 0
    for i in np.flatnonzero(~take).tolist():
        last = at[i - 1] if before != i - 1 else last
        if at[i] - last >= WORDS:
            take[i], last = True, at[i]
        before = i
    out = np.zeros(len(order), bool)
    out[order] = take
    return out


def _filter(keys: DataFrame, c: str):
    """(broadcast Bloom filter, its bits) of the keys, which are cut."""
    held, bits = bloom_of(keys, c)
    return keys.sparkSession.sparkContext.broadcast(held), bits


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _groups(batches: Iterator[pa.RecordBatch], least: int | None = None) -> Iterator[tuple]:
    """(rows, row, first word, elements, lines) of about GROUP_BYTES of texts at a time; the text is the last column. lines: as :func:`whole_lines` of ``least`` words."""
    for b in batches:
        first, size, texts = 0, 0, []
        for i, t in enumerate(b.column(b.num_columns - 1)):
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= GROUP_BYTES or i == b.num_rows - 1:
                found = words_of(texts)
                yield b.slice(first, len(texts)), *_paragraphs(*found), whole_lines(*found, least)
                first, size, texts = i + 1, 0, []


def _keys(least: int | None):
    """(key): each paragraph's digest at each place, and its key of each band; each line's digest if lines are units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, word, e, lines in _groups(batches, least):
            d, keys = digests(e), band_keys(e)
            banded = [keys[first_of_chain(keys[:, j], row, word), j] for j in range(BANDS)]
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([d[places(d, row, word)], *banded, lines[3]]))], names=["key"])

    return run


def _members(shared, bits: int):
    """(cid, keys, sketch, elements) of the paragraphs with a band key of the filter; elements by 32 bits of their hashes. Most copies in a task go out once.

    sketch has the bit of each element's low six bits: two paragraphs with COMMON common elements differ in as many bits as they have others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.frombuffer(shared.value, np.uint8), set()
        for _, _, _, e, _ in _groups(batches):
            d, once = np.unique(digests(e), return_index=True)
            e = e[once]
            keys = band_keys(e)
            hits = bloom_hits(held, bits, keys)
            take = np.array([i for i in np.flatnonzero(hits.any(axis=1)).tolist() if d[i] not in seen], np.int64)
            if len(seen) > SEEN:
                seen.clear()
            seen.update(d[take])
            hits = hits[take]
            ends = np.concatenate([[0], np.cumsum(hits.sum(axis=1))])
            of_keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(keys[take][hits]))
            flat = pa.array(np.ascontiguousarray(e[take].astype(np.uint32)).view(np.int32).reshape(-1))
            of_elements = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1, dtype=np.int32) * ELEMENTS), flat)
            sketch = np.bitwise_or.reduce(np.uint64(1) << (e[take] & np.uint64(63)), axis=1)
            yield pa.RecordBatch.from_arrays([_signed(d[take]), of_keys, _signed(sketch), of_elements], names=["cid", "keys", "sketch", "elements"])

    return run


def _occurrences(shared, bits: int, least: int | None):
    """(cid, row, doc_id, word) of the paragraphs whose digest is in the filter, and of the lines, with their size, if lines are units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for rows, row, word, e, lines in _groups(batches, least):
            d = digests(e)
            take = np.flatnonzero(bloom_hits(held, bits, d))
            take = take[places(d[take], row[take], word[take])]
            some = np.flatnonzero(bloom_hits(held, bits, lines[3]))
            d, row, word = (np.concatenate([x[take], y[some]]) for x, y in ((d, lines[3]), (row, lines[0]), (word, lines[1])))
            of = pa.array(row)
            columns = [_signed(d), rows.column(0).take(of), rows.column(1).take(of), pa.array(word, pa.int64())]
            if least is not None:
                columns.append(pa.array(np.concatenate([np.full(len(take), WORDS), lines[2][some]]), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "row", "doc_id", "word", "size"][: len(columns)])

    return run


def _subsets(shared=None, bits: int = 0):
    """(subset, cid) for each subset of at least COMMON elements; with a filter those of the subsets that it holds."""
    drop = [c for n in range(ELEMENTS - COMMON + 1) for c in combinations(range(ELEMENTS), n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for b in batches:
            e = _mix(b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64).reshape(-1, ELEMENTS))
            total = e.sum(axis=1, dtype=np.uint64)
            keys = np.stack([_mix(total - sum((e[:, i] for i in c), np.zeros(len(e), np.uint64))) for c in drop], axis=1)
            take = bloom_hits(held, bits, keys) if held is not None else np.ones(keys.shape, bool)
            yield pa.RecordBatch.from_arrays([_signed(keys[take]), b.column(0).take(pa.array(np.nonzero(take)[0]))], names=["subset", "cid"])

    return run


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, t): row names an id and a text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("long")
    return docs.select(F.xxhash64(own.isNull(), own, text).alias("row"), own.alias("doc_id"), text.cast("binary").alias("t"))


def colliding(texts: DataFrame, line_words: int | None = None) -> DataFrame:
    """(key): the digests, odd, and band keys, even, that come more than once.

    A count is all that is shuffled for a key. Copies of a row count as well; what only they repeat falls out when places are compared.
    """
    keys = cut(arrow(texts, _keys(line_words), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    release(texts.sparkSession)
    return keys


def near_links(texts: DataFrame, keys: DataFrame) -> DataFrame | None:
    """(u, v): verified links between digests of different paragraphs, or None if no band key is shared."""
    buckets = cut(keys.where("key & 1 = 0"))
    if buckets.isEmpty():
        return None
    members = arrow(texts, _members(*_filter(buckets, "key")), "cid long, keys array<long>, sketch long, elements array<int>")
    members = cut(members.groupBy("cid").agg(*(F.first(c).alias(c) for c in ("keys", "sketch", "elements"))))
    release(texts.sparkSession)
    each = members.select("cid", "sketch", F.explode("keys").alias("key"))
    each = cut(each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))
    small = each.where(F.col("n") <= SMALL)
    u, v = (small.select("key", F.col("cid").alias(c), F.col("sketch").alias(f"s{c}")) for c in ("u", "v"))
    pairs = u.join(v, "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("su").bitwiseXOR(F.col("sv"))) <= 2 * (ELEMENTS - COMMON))).select("u", "v").distinct()
    own = members.select("cid", "elements")
    pairs = pairs.join(own.select(F.col("cid").alias("u"), F.col("elements").alias("x")), "u").join(own.select(F.col("cid").alias("v"), F.col("elements").alias("y")), "v")
    pairs = pairs.where(F.size(F.array_intersect("x", "y")) >= COMMON).select("u", "v")
    large = own.join(each.where(F.col("n") > SMALL).select("cid").distinct(), "cid", "left_semi")
    shared = cut(arrow(large, _subsets(), "subset long, cid long").groupBy("subset").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("subset"))
    keyed = cut(arrow(large, _subsets(*_filter(shared, "subset")), "subset long, cid long").join(shared, "subset", "left_semi"))
    linked = keyed.join(keyed.groupBy("subset").agg(F.min("cid").alias("u")), "subset").where("u != cid").select("u", F.col("cid").alias("v"))
    links = cut(pairs.unionAll(linked).distinct())
    release(texts.sparkSession)
    return links


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int | None = None) -> DataFrame:
    """(doc_id, first_word, end_word, cluster, keeper_doc, kept) of each stretch that repeats.

    Words are counted from 0, end exclusive. ``kept`` marks the occurrence that stays; cluster names the component of the
    stretch's first paragraph, keeper_doc the document that keeps it. ``line_words``: words of the shortest line that is a unit as a whole; None: no line is.
    """
    texts = documents(docs, id_col, text_col)
    keys = colliding(texts, line_words)
    links = near_links(texts.select("t"), keys)
    wanted = keys.where("key & 1 = 1").select(F.col("key").alias("cid"))
    if links is None:
        wanted = wanted.withColumn("cluster", F.col("cid"))
    else:
        roots = components(links).select(F.col("node").alias("cid"), "root")
        wanted = wanted.join(roots, "cid", "full").select("cid", F.coalesce("root", "cid").alias("cluster"))
    wanted = cut(wanted)
    lines = line_words is not None
    size = F.col("size") if lines else F.lit(WORDS)
    found = arrow(texts, _occurrences(*_filter(wanted, "cid"), line_words), "cid long, row long, doc_id long, word long" + ", size long" * lines)
    found = cut(found.join(wanted, "cid").drop("cid"))
    release(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "word")
    # in one document, only stretches that don't overlap repeat each other
    apart = (F.col("first.row") != F.col("last.row")) | (F.col("last.word") - F.col("first.word") >= size)
    keepers = cut(found.groupBy("cluster").agg(F.min(place).alias("first"), F.max(place).alias("last"), *[F.max("size").alias("size")] * lines).where(apart).select("cluster", "first"))
    found = found.join(keepers, "cluster")
    kept = (F.col("row") == F.col("first.row")) & (F.abs(F.col("word") - F.col("first.word")) < size)
    end = F.col("word") + size
    found = found.select("row", "doc_id", "word", *["size"] * lines, "cluster", F.col("first.doc_id").alias("keeper_doc"), kept.alias("kept"))
    of_text = Window.partitionBy("row", "kept").orderBy("word")
    before, upto = of_text.rowsBetween(Window.unboundedPreceding, -1), of_text.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("new", F.coalesce(F.col("word") > F.max(end).over(before), F.lit(True)).cast("int"))
    found = found.withColumn("stretch", F.sum("new").over(upto))
    lead = F.min(F.struct("word", "cluster", "keeper_doc", "doc_id")).alias("l")
    spans = found.groupBy("row", "kept", "stretch").agg(lead, F.max(end).alias("end_word"))
    return spans.select(F.col("l.doc_id").alias("doc_id"), F.col("l.word").alias("first_word"), "end_word", F.col("l.cluster").alias("cluster"), F.col("l.keeper_doc").alias("keeper_doc"), "kept")


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of all documents that repeat."""
    return repeats(table(spark, sf_dir, "documents"))
