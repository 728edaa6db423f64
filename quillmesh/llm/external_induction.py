"""Suffixes and common prefixes of a text far larger than memory, by external induced sorting.

A text's leftmost S suffixes (those that begin a rising stretch) are put in order first, by recursion on the text of their substrings' names; the
order of all others is induced from theirs, of the L suffixes in a pass upwards and of the S suffixes in a pass downwards. What a pass still has to visit lies in a priority queue of tuples
(first symbol, rank, position, common prefix) that spills sorted runs to a folder on disk, and what it has visited in a file. Common prefixes
are carried: two neighbours that were induced from two suffixes share one symbol more than the least common prefix between those. The few pairs that nothing
induces, and the leftmost S suffixes of the text itself, are compared word by word in it.

Tuples are taken a symbol at a time, so a pass is some array operations for each of a text's symbols and each length of a stretch of equal ones. A string of
names that fits into memory is ordered there by doubling. Only the first ``cap`` symbols count: beyond them order is arbitrary, and no common prefix is longer.
"""

from __future__ import annotations

import heapq
import os

import numpy as np

#: Visited at once.
_STEP = 1 << 16


class SpillingQueue:
    """A priority queue of (symbol, position, value): least symbol first, and first in, first out for one symbol, since a pass pushes in the order of ranks.

    At most ``room`` tuples are in memory; beyond that all go to a sorted run on disk, of which parts are read as they are due.
    """

    def __init__(self, folder: str, room: int):
        self.folder, self.room = folder, max(1, room)
        self.held: dict[int, list] = {}
        self.size, self.runs, self.symbols, self.spilled = 0, [], [], 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, values: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        s, p, v = symbols[order], positions[order], values[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(s)]):
            c = int(s[a])
            if c not in self.held:
                self.held[c] = []
                heapq.heappush(self.symbols, c)
            self.held[c].append((p[a:b], v[a:b]))
        self.size += len(s)
        if self.size > self.room:
            self._spill()

    def _spill(self) -> None:
        path = os.path.join(self.folder, f"run{id(self)}-{self.spilled}")
        self.spilled += 1
        symbols = sorted(self.held)
        counts = [sum(len(p) for p, _ in self.held[c]) for c in symbols]
        with open(path, "wb") as f:
            for k, kind in ((0, "<i8"), (1, "u1")):
                for c in symbols:
                    for part in self.held[c]:
                        f.write(part[k].astype(kind).tobytes())
        ends = np.cumsum(counts).tolist()
        self.runs.append([path, symbols, [0, *ends[:-1]], counts, ends[-1], 0])
        self.held, self.size = {}, 0
        self.symbols = list({r[1][r[5]] for r in self.runs if r[5] < len(r[1])})
        heapq.heapify(self.symbols)

    def least(self) -> int | None:
        while self.symbols:
            c = self.symbols[0]
            if c in self.held or any(r[5] < len(r[1]) and r[1][r[5]] == c for r in self.runs):
                return c
            heapq.heappop(self.symbols)
        return None

    def pop(self, c: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The tuples of the least symbol ``c``, in parts: those of earlier runs were pushed earlier."""
        out = []
        for r in self.runs:
            path, symbols, starts, counts, total, at = r
            if at < len(symbols) and symbols[at] == c:
                n = counts[at]
                for a in range(starts[at], starts[at] + n, self.room):
                    m = min(self.room, starts[at] + n - a)
                    out.append((np.fromfile(path, "<i8", m, offset=8 * a), np.fromfile(path, "u1", m, offset=8 * total + a)))
                r[5] += 1
                if r[5] < len(symbols):
                    heapq.heappush(self.symbols, symbols[r[5]])
                else:
                    os.remove(path)
        self.runs = [r for r in self.runs if r[5] < len(r[1])]
        found = self.held.pop(c, [])
        self.size -= sum(len(p) for p, _ in found)
        if len(found) > 1:
            found = [(np.concatenate([p for p, _ in found]), np.concatenate([v for _, v in found]))]
        return out + found


class _Log:
    """(symbol, positions, values) in the order of a pass, on disk past ``room`` of them, and read back from its end."""

    def __init__(self, path: str, room: int):
        self.path, self.room, self.parts, self.held, self.size, self.n, self.file = path, room, [], [], 0, 0, None

    def add(self, c: int, positions: np.ndarray, values: np.ndarray) -> None:
        self.held.append((c, positions, values))
        self.size += len(positions)
        if self.size > self.room:
            self.file = self.file or open(self.path, "wb")  # noqa: SIM115
            for c, p, v in self.held:
                self.file.write(p.astype("<i8").tobytes() + v.astype("u1").tobytes())
                self.parts.append((c, self.n, len(p)))
                self.n += 9 * len(p)
            self.held, self.size = [], 0

    def backwards(self):
        while self.held:
            yield self.held.pop()
        if self.file:
            self.file.close()
            for c, at, n in reversed(self.parts):
                yield c, np.fromfile(self.path, "<i8", n, offset=at), np.fromfile(self.path, "u1", n, offset=at + 8 * n)
            os.remove(self.path)


def _least_between(values: np.ndarray):
    """A function of two arrays: the least of values[a:b], a < b."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[: len(last) - half], last[half:]))

    def found(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), values.dtype)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(levels[level][a[at]], levels[level][b[at] - (1 << level)])
        return out

    return found


class Suffixes:
    """One text (an array of whole numbers, perhaps mapped from a file) and the passes over it.

    ``carry``: whether common prefixes are wanted, for bytes only; ``room``: tuples that a queue holds in memory; ``memory``: bytes within which arrays of the text's length needn't be mapped from files.
    """

    def __init__(self, text: np.ndarray, folder: str, room: int, cap: int, carry: bool, memory: int = 0):
        self.t, self.n, self.folder, self.room, self.cap, self.carry, self.memory = text, len(text), folder, room, cap, carry, memory
        self.names = 0
        self.rising = self._types()

    def _file(self, kind: str, n: int, what: str) -> np.ndarray:
        if 24 * self.n <= self.memory:
            return np.zeros(n, kind)
        self.names = self.names + 1
        path = os.path.join(self.folder, f"{what}{id(self)}-{self.names}")
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)  # the mapping keeps it as long as it is used
        return out

    def _types(self) -> np.ndarray:
        """Whether each suffix is smaller than the next one, an S suffix."""
        out, carry = self._file("?", self.n, "types"), False  # the end is smaller than any symbol
        step = 1 << 22
        for a in range((self.n - 1) // step * step, -1, -step):
            b = min(self.n, a + step)
            here = np.asarray(self.t[a:b])
            after = np.asarray(self.t[a + 1 : b + 1])
            if len(after) < len(here):
                less, same = here[:-1] < after, here[:-1] == after
                less, same = np.r_[less, False], np.r_[same, False]
            else:
                less, same = here < after, here == after
            at = np.where(same, b - a, np.arange(b - a))
            nearest = np.minimum.accumulate(at[::-1])[::-1]
            out[a:b] = np.r_[less, carry][nearest]
            carry = bool(out[a])
        return out

    def leftmost(self) -> np.ndarray:
        """Positions of the leftmost S suffixes, in the order of the text."""
        parts, step = [np.zeros(0, np.int64)], 1 << 22
        total = 0
        for a in range(1, self.n, step):
            b = min(self.n, a + step)
            found = a + np.flatnonzero(self.rising[a:b] & ~self.rising[a - 1 : b - 1])
            total += len(found)
            parts.append(found)
        out, at = self._file("<i8", max(1, total), "leftmost"), 0
        for p in parts:
            out[at : at + len(p)] = p
            at += len(p)
        return out[:total]

    def _common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs, at most cap; the text has ``cap`` + 8 more bytes behind its end."""
        base = self.t.base if isinstance(self.t.base, np.ndarray) and len(self.t.base) >= self.n + self.cap + 8 else None
        data = base if base is not None else np.r_[self.t, np.zeros(self.cap + 8, np.uint8)]
        words = np.ndarray((self.n + self.cap,), "<u8", data, strides=(1,))
        out, open_ = np.zeros(len(p), np.int64), np.arange(len(p))
        for j in range(0, self.cap, 8):
            x = words[p[open_] + j] ^ words[q[open_] + j]
            same = x == 0
            ends = x[~same]
            low = np.frexp((ends & (~ends + np.uint64(1))).astype(np.float64))[1] - 1  # the place of the lowest bit that differs
            out[open_[~same]] = j + low // 8
            open_ = open_[same]
            if not open_.size:
                return np.minimum(out, self.cap)
        out[open_] = self.cap
        return np.minimum(out, self.cap)

    def _visit(self, queue: SpillingQueue, sign: int, positions: np.ndarray, values: np.ndarray, since: np.ndarray, rising: bool) -> None:
        """Pushes the suffixes that visited ones induce; ``since``: the least common prefix since a symbol's last push."""
        for a in range(0, len(positions), _STEP):
            pos, val = positions[a : a + _STEP], values[a : a + _STEP]
            before = pos - 1
            at = np.flatnonzero((before >= 0) & (self.rising[np.maximum(before, 0)] == rising))
            before = before[at]
            symbols = np.asarray(self.t[before]).astype(np.int64)
            carried = np.zeros(len(at), np.uint8)
            if self.carry:
                if at.size:
                    order = np.argsort(symbols, kind="stable")
                    s, k = symbols[order], at[order]
                    first = np.r_[True, s[1:] != s[:-1]]
                    got = np.empty(len(k), np.int64)
                    got[first] = np.minimum(since[s[first]], np.minimum.accumulate(val)[k[first]])
                    if not first.all():
                        got[~first] = _least_between(val)(k[:-1][~first[1:]] + 1, k[1:][~first[1:]] + 1)
                    carried[order] = np.minimum(got + 1, self.cap)
                    last = np.r_[s[1:] != s[:-1], True]
                    tail = np.r_[np.minimum.accumulate(val[::-1])[::-1], self.cap]
                    np.minimum(since, val.min(), out=since)
                    since[s[last]] = tail[k[last] + 1]
                else:
                    np.minimum(since, val.min(initial=self.cap), out=since)
            queue.push(sign * symbols, before, carried)

    def induced(self, seeds: SpillingQueue, seen) -> None:
        """Visits all suffixes in descending order: ``seen(positions, values)``, each with its common prefix with the next greater one. ``seeds``: the leftmost S suffixes, those of one symbol in their order."""
        up, log = SpillingQueue(self.folder, self.room), _Log(os.path.join(self.folder, f"falling{id(self)}-{self.names}"), self.room)
        self.names += 1
        since = np.full(256 if self.carry else 1, self.cap, np.int64)
        if self.n:
            up.push(np.array([int(self.t[self.n - 1])]), np.array([self.n - 1]), np.zeros(1, np.uint8))
            since[:] = 0
        while (c := min((x for x in (up.least(), seeds.least()) if x is not None), default=None)) is not None:
            last, fresh = None, True
            while up.least() == c:
                for p, v in up.pop(c):
                    if fresh:
                        v = np.r_[np.uint8(0), v[1:]]
                        fresh = False
                    log.add(c, p, v)
                    self._visit(up, 1, p, v, since, False)
                    last = int(p[-1])
            if seeds.least() == c:
                fresh = True
                for p, v in seeds.pop(c):
                    if fresh:
                        v = np.r_[np.uint8(self._common(np.array([last]), p[:1])[0] if last is not None and self.carry else 0), v[1:]]
                        fresh = False
                    self._visit(up, 1, p, v, since, False)
        down, falling = SpillingQueue(self.folder, self.room), log.backwards()
        since[:] = 0
        part, state = next(falling, None), {"held": None}

        def took(p: np.ndarray, v: np.ndarray) -> None:
            seen(p, v)
            self._visit(down, -1, p, v, since, True)

        while (c := max((x for x in (None if down.least() is None else -down.least(), part and part[0]) if x is not None), default=None)) is not None:
            last, fresh = None, True
            while down.least() == -c:
                for p, v in down.pop(-c):
                    if fresh:
                        v = np.r_[np.uint8(0), v[1:]]
                        fresh = False
                    took(p, v)
                    last = int(p[-1])
            above = self._common(np.array([last]), part[1][-1:])[0] if last is not None and part and part[0] == c and self.carry else 0
            while part and part[0] == c:
                p, v = part[1][::-1], part[2]
                took(p, np.r_[np.uint8(above), v[:0:-1]])  # a value belongs to the pair with the next greater one here
                above, part = int(v[0]), next(falling, None)

    def order(self, memory: int) -> np.ndarray:
        """The leftmost S suffixes in order, by names and recursion."""
        at = self.leftmost()
        m = len(at)
        if m < 2:
            return at
        seeds = SpillingQueue(self.folder, self.room)
        for a in range(0, m, self.room):
            p = np.asarray(at[a : a + self.room])
            seeds.push(np.asarray(self.t[p]).astype(np.int64), p, np.zeros(len(p), np.uint8))
        ranked, place = self._file("<i8", m, "ranked"), [m]
        carry, self.carry = self.carry, False

        def seen(p: np.ndarray, _: np.ndarray) -> None:
            inner = p > 0
            own = p[inner][self.rising[p[inner]] & ~self.rising[p[inner] - 1]]
            ranked[place[0] - len(own) : place[0]] = own[::-1]
            place[0] -= len(own)

        self.induced(seeds, seen)
        self.carry = carry
        names, last = self._file("<i8", m, "names"), 0
        step = 1 << 18
        for a in range(0, m, step):
            p = np.asarray(ranked[max(0, a - 1) : a + step])
            fresh = np.r_[a == 0, ~self._equal(p[:-1], p[1:], at)] if a == 0 else ~self._equal(p[:-1], p[1:], at)
            if a == 0:
                fresh[0] = False
            own = p if a == 0 else p[1:]
            name = last + np.cumsum(fresh)
            last = int(name[-1])
            names[np.searchsorted(at, own)] = name
        if last == m - 1:
            return ranked
        if m * 64 <= memory:
            return at[_doubled(np.asarray(names), self.cap)]
        inner = Suffixes(names, self.folder, self.room, self.cap, False, memory)
        return at[inner.sorted(memory)]

    def sorted(self, memory: int) -> np.ndarray:
        """All suffixes in order."""
        out, place = self._file("<i8", self.n, "sorted"), [self.n]

        def seen(p: np.ndarray, _: np.ndarray) -> None:
            out[place[0] - len(p) : place[0]] = p[::-1]
            place[0] -= len(p)

        self.induced(self.seeds(memory), seen)
        return out

    def seeds(self, memory: int) -> SpillingQueue:
        """The leftmost S suffixes in order, with their common prefixes."""
        ordered, out = self.order(memory), SpillingQueue(self.folder, self.room)
        for a in range(0, len(ordered), self.room):
            p = np.asarray(ordered[a : a + self.room])
            v = np.zeros(len(p), np.uint8)
            if self.carry:
                prior = np.r_[ordered[a - 1 : a] if a else p[:1], p[:-1]]
                v = self._common(prior, p).astype(np.uint8)
            out.push(np.asarray(self.t[p]).astype(np.int64), p, v)
        return out

    def _equal(self, p: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the substrings up to the next leftmost S suffix are equal; the last one ends with the text and equals none."""
        ends = lambda x: (lambda k: np.where(k < len(at), at[np.minimum(k, len(at) - 1)] - x + 1, -1 - x))(np.searchsorted(at, x) + 1)
        n, m = ends(p), ends(q)
        out = ((n == m) | ((n > self.cap) & (m > self.cap))) & (n > 0) & (m > 0)
        open_, j = np.flatnonzero(out), 0
        while open_.size and j <= self.cap:
            same = self.t[p[open_] + j] == self.t[q[open_] + j]
            out[open_[~same]] = False
            j += 1
            open_ = open_[same]
            open_ = open_[n[open_] > j]
        return out


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """The order of the suffixes of a string of names that fits into memory, by their first ``cap`` names at least. Only what is still tied is sorted again."""
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    a = names[order]
    rank, slots = np.empty(n, np.int64), np.arange(n)
    while True:
        head = np.r_[True, a[1:] != a[:-1]]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        slots = slots[~(head & np.r_[head[1:], True])]
        if not slots.size or h > cap:
            return order
        p = order[slots]
        after = np.where(p + h < n, rank[np.minimum(p + h, n - 1)] + 1, 0)
        a = rank[p] * (n + 1) + after
        again = np.argsort(a, kind="stable")
        order[slots], a = p[again], a[again]
        h *= 2


def repeated(text: np.ndarray, folder: str, window: int, memory: int) -> np.ndarray:
    """Whether the ``window`` bytes from each position on also start elsewhere in the text; ``text``: the bytes, followed in its base by ``window`` + 8 more."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    s, last = Suffixes(text, folder, max(1024, memory // 64), window, True, memory), [-1]
    marks = s._file("?", n, "marks")

    def seen(p: np.ndarray, v: np.ndarray) -> None:
        far = v >= window
        marks[p[far]] = True
        above = np.r_[last[0], p[:-1]]
        marks[above[far]] = True
        last[0] = int(p[-1])

    s.induced(s.seeds(memory), seen)
    return marks
