"""SentencePiece encoding and decoding as a tropical shortest path through a weighted transducer.

A model file compiles to three transducers. The normaliser rewrites what the model's character map names, longest rule
first, drops surplus white space if the model says so, writes spaces as the meta symbol and adds the
dummy prefix. The piece transducer reads characters and writes piece ids; it is the trie of
all pieces. Byte fallback reads a character without a piece and writes the ids of its UTF-8 bytes at a high weight.
Composing them with a text gives a lattice whose shortest path in the tropical semiring
(min, +) is the encoding.

For a unigram model an arc weighs minus the piece's log probability. For a BPE model the weights
stand on pairs of arcs, so the composed machine's state is (position, last piece): a
pair weighs 0 if merging its joined characters by score yields that very pair, else infinity. Merges
within a pair happen in the same order inside any text, so the one path of finite weight is what the merge
procedure gives; every prefix has one such path, hence one finite state a position.

No piece holds the meta symbol after another character, and none holds a line feed, so the shortest path of a text is
the concatenation of the paths of its segments; those are remembered in a table of bounded size.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole;
repeated rows stay; a text's own meta symbols decode to spaces, as in the public library; further columns are kept or
ignored as the caller selects; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow, fresh, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITY = float("inf")
#: Bytes of segments in each of two generations and number of pairs remembered in a worker, and the longest remembered segment.
REMEMBERED, PAIRS, LONGEST = 32 << 20, 500_000, 48
#: What a remembered segment takes beside its characters and ids.
_ENTRY = 190


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Normaliser:
    """The normaliser of a model as a transducer: rewriting rules, white space and the dummy prefix."""

    def __init__(self, spec: dict, suffix: bool = False):
        self.prefix, self.trim, self.escape, self.suffix = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), suffix
        self.space = META if self.escape else " "
        self.rules = self._rules(spec.get(2, b""))
        #: The longest rule that starts with a character.
        self.longest: dict[str, int] = {}
        for k in self.rules:
            self.longest[k[0]] = max(len(k), self.longest.get(k[0], 0))

    @staticmethod
    def _rules(table: bytes) -> dict[str, str]:
        """The rules of a character map: a double array over UTF-8, then the targets, each ended by a zero byte."""
        if not table:
            return {}
        size = struct.unpack_from("<I", table)[0]
        units, targets = np.frombuffer(table, "<u4", size // 4, 4), table[4 + size :]
        labels, octets = units & 0x800000FF, np.arange(1, 256, dtype=np.int64)
        reach = lambda at: at ^ int(units[at] >> 10) << (int(units[at] & 512) >> 6)
        rules, open_ = {}, [(b"", 0)]
        while open_:
            key, at = open_.pop()
            base = reach(at)
            if units[at] >> 8 & 1:
                target = int(units[base]) & 0x7FFFFFFF
                rules[key.decode()] = targets[target : targets.index(b"\0", target)].decode()
            children = base ^ octets
            children, names = children[children < len(units)], octets[children < len(units)]
            hit = labels[children] == names
            open_ += [(key + bytes([n]), int(c)) for n, c in zip(names[hit], children[hit])]
        return rules

    def __call__(self, text: str) -> str:
        if not self.rules and not self.trim:
            s = text.replace(" ", self.space)
        else:
            s = "".join(self._written(text)) if self.rules else text
            if self.trim:
                s = re.sub(" +", " ", s).strip(" ")
                if not s:
                    return ""
            s = s.replace(" ", self.space)
        if text and self.prefix and not self.suffix:
            s = self.space + s
        # a text's own meta symbols at its end count as white space
        s = s.rstrip(self.space) if self.trim else s
        return s + self.space if text and self.prefix and self.suffix else s

    def _written(self, text: str) -> Iterator[str]:
        """What the rules make of a text, read from the left."""
        i, n = 0, len(text)
        while i < n:
            for size in range(min(self.longest.get(text[i], 0), n - i), 0, -1):
                new = self.rules.get(text[i : i + size])
                if new is not None:
                    yield new
                    i += size
                    break
            else:
                yield text[i]
                i += 1


class PieceTransducer:
    """A compiled model: ``encode`` and ``decode``."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.normalised = Normaliser(normaliser, bool(trainer.get(24, 0)))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}
        #: The nodes of the trie by what they spell: a piece's id, or -1.
        self.prefixes = {p[:n]: self.ids.get(p[:n], -1) for p in self.ids for n in range(1, len(p) + 1)}
        self.unknown = self.kinds.index(UNKNOWN)
        octets = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.octets = [octets.get(b, self.unknown) for b in range(256)]
        #: A segment ends before a meta symbol that follows another character, and around line feeds.
        whole = any(META in p.strip(META) or p.endswith(META) and p.strip(META) for p in self.ids) or any("\n" in p for p in self.ids)
        self._segment = None if whole else re.compile(f"{META}+[^{META}\n]*|\n+|[^{META}\n]+")
        self._worst = -min(self.scores) + 10.0
        self._pairs: dict[int, float] = {}  # by last * pieces + piece
        self._memo = _Memo(self)
        self._out = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(META, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    def merged(self, text: str) -> list[str]:
        """What merging by score makes of a short text: the piece weights of a BPE model rest on it."""
        parts = list(text)
        while True:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, last: int, piece: int) -> float:
        """Of an arc for ``piece`` after ``last`` (negative: start or a character without a piece)."""
        if not self.bpe:
            return -self.scores[piece]
        key = last * len(self.pieces) + piece
        w = self._pairs.get(key)
        if w is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            pair = [self.pieces[piece]] if last < 0 else [self.pieces[last], self.pieces[piece]]
            w = self._pairs[key] = 0.0 if self.merged("".join(pair)) == pair else INFINITY
        return w

    def shortest(self, s: str) -> list[int]:
        """Ids on the shortest path of a normalised text."""
        last, back = self._merged_path(s) if self.bpe else self._likeliest_path(s)
        out, j = [], len(s)
        while j:
            i = back[j]
            out += [last[j]] if last[j] >= 0 else [self.octets[b] for b in reversed(s[i:j].encode())]
            j = i
        return out[::-1]

    def _likeliest_path(self, s: str) -> tuple[list[int], list[int]]:
        """Last piece and its start at each position, for weights that are costs."""
        n, ids, prefixes, weight = len(s), self.ids, self.prefixes, self.weight
        cost, last, back = [INFINITY] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here, j = cost[i], i + 1
            while j <= n and (part := s[i:j]) in prefixes:
                piece = ids.get(part)
                if piece is not None and (w := here + weight(-1, piece)) < cost[j]:
                    cost[j], last[j], back[j] = w, piece, i
                j += 1
            if s[i] not in ids and (w := here + self._worst) < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = w, -1, i
        return last, back

    def _merged_path(self, s: str) -> tuple[list[int], list[int]]:
        """The same where a weight is 0 or infinite: the first path of weight 0 that is found is the shortest.

        Long arcs are tried first and arcs are weighed when they are tried. A position reached at weight 0 has its shortest path, so it is left once at most, and most are never reached.
        """
        n, node, weight, known, size = len(s), self.prefixes.get, self.weight, self._pairs.get, len(self.pieces)
        last, back = [-1] * (n + 1), [-1] * (n + 1)
        i, back[0], arcs = 0, 0, []
        while back[n] < 0:
            if node(s[i], -1) < 0:
                arcs.append((i, i + 1, -1))
            for j in range(i + 1, n + 1):
                piece = node(s[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    arcs.append((i, j, piece))
            while True:
                i, j, piece = arcs.pop()
                if back[j] >= 0:
                    continue
                if piece >= 0:
                    w = known(last[i] * size + piece)
                    if w is None:
                        w = weight(last[i], piece)
                    if w != 0.0:
                        continue
                last[j], back[j] = piece, i
                break
            i = j
        return last, back

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        s = self.normalised(text or "")
        parts = [s] if self._segment is None else self._segment.findall(s)
        return np.frombuffer(b"".join(map(self._memo.__getitem__, parts)), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        text = b"".join(map(self._out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        n = self.normalised
        if n.prefix and n.suffix:
            return text[:-1] if text.endswith(" ") else text
        return (text.lstrip(" ") if n.trim else text[1:] if text.startswith(" ") else text) if n.prefix or n.trim else text


class _Memo(dict):
    """Ids of segments. Two generations: when the younger is full it becomes the elder, so what is in use survives."""

    def __init__(self, fst: PieceTransducer):
        self.fst, self.elder, self.held = fst, {}, 0

    def __missing__(self, s: str) -> bytes:
        found = self.elder.get(s)
        if found is None:
            ids = self.fst.shortest(s)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(s) <= LONGEST:
            if self.held >= REMEMBERED:
                self.elder = dict(self)
                self.clear()
                self.held = 0
            self[s] = found
            self.held += _ENTRY + 2 * len(s) + len(found)
        return found


@lru_cache(maxsize=2)
def compiled(model: bytes) -> PieceTransducer:
    """One transducer for each model in a Python worker."""
    return PieceTransducer(model)


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read on the driver; it travels with the tasks (half a megabyte for 32,000 pieces)."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(df: DataFrame, text_col: str = "text", path: str = MODEL, digest: bool = False) -> DataFrame:
    """``df`` without its text and with ids array<int>, n_tokens and exact (decoding gives the text back).

    With ``digest`` ids_sha256, over the ids as 32-bit little-endian numbers, takes the place of ids.
    """
    model = df.sparkSession.sparkContext.broadcast(model_bytes(path))
    keep = [c for c in df.columns if c != text_col]
    t = fresh(df, "piece_text")
    names = ["ids_sha256" if digest else "ids", "n_tokens", "exact"]
    clash = {n.lower() for n in names}
    keep = [c for c in keep if c.lower() not in clash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, exact = [], []
                for x in part.column(part.num_columns - 1):
                    text = x.as_py()
                    got = fst.encode(text)
                    exact.append(fst.decode(got) == text.replace(META, " "))
                    ids.append((hashlib.sha256(got.tobytes()).hexdigest(), len(got)) if digest else got)
                if digest:
                    made, n = pa.array([x for x, _ in ids], pa.string()), [x for _, x in ids]
                else:
                    n = [len(x) for x in ids]
                    flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, "<i4"), pa.int32())
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made, pa.array(n, pa.int64()), pa.array(exact, pa.bool_())], names=[*part.schema.names[:-1], *names])

    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(t))
    schema = rows.drop(t).schema
    for name, kind in zip(names, (T.StringType() if digest else T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType())):
        schema = schema.add(name, kind)
    return arrow(rows, run, schema)


def op9_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digest of each document's ids, and whether they decode to its text."""
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
