"""Centroid clustering in exact integers, by adaptive distance bounds.

Beside its vector a row keeps an upper bound of the distance to its own centroid, the lower bounds of a few of the next nearest
centroids, and one remainder bound below the distance to all others. When centroids move, the bounds are loosened by how far they
moved. A row whose upper bound stays below all others needs no distance; else its own distance is taken, then those of the listed
centroids whose bounds it reaches, and only where the remainder bound is reached too those of all centroids. Bounds are kept in doubles with a margin
and decide only what need not be looked at: what is compared are exact integers, ties go to the smaller number.

The list starts at a quarter of the centroids and shrinks to what the rows of a round reached, an eighth at least.

Rows stay where they are read: a round is one pass over a persisted table without a shuffle, and sends the driver numbers for each centroid, whose
count is a parameter. Sums follow the rows that changed their centroid. A lost executor's rows are computed again from the last checkpoint and the centroids of the rounds since,
which is cut every EVERY rounds.

Vectors that are null, of another length, or hold null or non-finite components take no part; nor do those with a component beyond
RANGE after scaling, whose squared distances no long can hold. Repeated rows are vectors of their own; a null id reads as an empty text in
the order of the first centroids. Fewer vectors than centroids give fewer centroids; an empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, table

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components of the scaled vectors; 64 squares of their differences fit in a long.
RANGE = 1 << 27
#: Rounds after which the lineage is cut.
EVERY = 8
#: Below this the products of whole numbers are exact in doubles.
_EXACT = 1 << 21
#: By how much bounds in doubles may be off, generously.
_SLACK = 1e-9

STATE = "vec_id long, vector binary, was int, cluster int, upper double, near array<int>, lower array<double>, rest double, looked int, depth int"


def scaled(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    fits = lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < float(RANGE))  # noqa: E731  NaN is larger than any number
    rows = df.where((F.size(vector) == dimensions) & F.forall(vector, lambda v: F.coalesce(fits(v), F.lit(False))))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest hash of their id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.orderBy(order, "vec_id", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), len(found[0]["x"]) if found else 0)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT and x.shape[1] <= 512:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def _own(x: np.ndarray, c: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((x - c[at]) ** 2).sum(1)


def _surely_less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * (1 + _SLACK) + _SLACK < b * (1 - _SLACK)


def scanned(x: np.ndarray, c: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """cluster, upper, near, lower and rest of rows by all distances."""
    d = squares(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = root[:, b + 1] if b + 1 < len(c) else np.full(len(x), np.inf)
    return order[:, 0].astype(np.int32), root[:, 0], order[:, 1 : b + 1].astype(np.int32), root[:, 1 : b + 1], rest


@dataclass
class Bounds:
    """The bounds of some rows; ``looked`` counts the distances taken, ``depth`` how far the list was reached."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    looked: np.ndarray = field(default=None)
    depth: np.ndarray = field(default=None)


def advanced(x: np.ndarray, s: Bounds, c: np.ndarray, moved: np.ndarray, b: int) -> Bounds:
    """``s`` after centroids have moved to ``c`` by ``moved``, with lists of ``b`` or fewer centroids."""
    n, k = len(x), len(c)
    away = np.sort(moved)[::-1]
    most = np.where(moved[s.cluster] == away[0], away[min(1, k - 1)], away[0])  # the own centroid is none of the others
    cluster, near = s.cluster.copy(), s.near.copy()
    upper, lower, rest = s.upper + moved[s.cluster], s.lower - moved[s.near] if s.near.size else s.lower.copy(), s.rest - most
    if near.shape[1] > b:
        rest = np.minimum(rest, lower[:, b:].min(1))
        near, lower = near[:, :b].copy(), lower[:, :b].copy()
    looked, depth = np.zeros(n, np.int32), np.zeros(n, np.int32)
    least = np.minimum(rest, lower.min(1, initial=np.inf))
    at = np.flatnonzero(~_surely_less(upper, least))
    if at.size:  # the own distance
        own = _own(x[at], c, cluster[at])
        upper[at] = np.sqrt(own.astype(np.float64))
        looked[at] += 1
        open_ = ~_surely_less(upper[at], least[at])
        at, own = at[open_], own[open_]
    if at.size and near.shape[1]:  # the listed ones within reach
        best, who = own.copy(), cluster[at].copy()
        for j in range(near.shape[1]):
            reach = np.flatnonzero(~_surely_less(upper[at], lower[at, j]))
            rows = at[reach]
            d = _own(x[rows], c, near[rows, j])
            lower[rows, j] = np.sqrt(d.astype(np.float64))
            looked[rows] += 1
            depth[rows] = j + 1
            wins = (d < best[reach]) | ((d == best[reach]) & (near[rows, j] < who[reach]))
            best[reach[wins]], who[reach[wins]] = d[wins], near[rows[wins], j]
        change = np.flatnonzero(who != cluster[at])
        rows, old = at[change], cluster[at[change]]
        place = np.argmax(near[rows] == who[change][:, None], axis=1)
        lower[rows, place], near[rows, place] = upper[rows], old
        cluster[rows], upper[rows] = who[change], np.sqrt(best[change].astype(np.float64))
        at = at[~_surely_less(upper[at], rest[at])]
    if at.size:  # the order cannot be certified
        cluster[at], upper[at], near[at], lower[at], rest[at] = scanned(x[at], c, near.shape[1])
        looked[at] += k
        depth[at] = near.shape[1]
    order = np.argsort(lower, axis=1, kind="stable")
    return Bounds(cluster, upper, np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1), rest, looked, depth)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1), kind))


def _batch(vec_id: pa.Array, x: np.ndarray, was: np.ndarray, s: Bounds) -> pa.RecordBatch:
    data = np.ascontiguousarray(x, "<i4")
    packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (data.shape[1] * 4)), pa.py_buffer(data.tobytes())])
    zero = np.zeros(len(x), np.int32)
    looked, depth = (zero if v is None else v for v in (s.looked, s.depth))
    return pa.RecordBatch.from_arrays(
        [vec_id, packed, pa.array(was.astype(np.int32)), pa.array(s.cluster.astype(np.int32)), pa.array(s.upper), _lists(s.near, pa.int32()), _lists(s.lower, pa.float64()), pa.array(s.rest), pa.array(looked), pa.array(depth)],
        ["vec_id", "vector", "was", "cluster", "upper", "near", "lower", "rest", "looked", "depth"],
    )


def _vectors(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(n, -1).astype(np.int64)


def _square(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def seeded(vectors: DataFrame, c: np.ndarray, b: int) -> DataFrame:
    """The state of each vector by all distances to the first centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                x = _square(batch["x"], n)
                s = Bounds(*scanned(x, c, b), looked=np.full(n, len(c), np.int32))
                yield _batch(batch["vec_id"], x, np.full(n, -1), s)

    return arrow(vectors, run, STATE)


def stepped(state: DataFrame, c: np.ndarray, moved: np.ndarray, b: int) -> DataFrame:
    """The next round's state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                x, flat = _vectors(batch["vector"], n), lambda name: batch[name].to_numpy(zero_copy_only=False)  # noqa: B023
                s = Bounds(flat("cluster"), flat("upper"), _square(batch["near"], n), _square(batch["lower"], n), flat("rest"))
                yield _batch(batch["vec_id"], x, s.cluster, advanced(x, s, c, moved, b))

    return arrow(state, run, STATE)


def changes(state: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """By how much each centroid's count and sums change, exact; the distances taken; the depth reached. A row for each centroid, component and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, looked, depth = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), 0, 0
        for batch in batches:
            n = batch.num_rows
            was, now = (batch[c].to_numpy(zero_copy_only=False) for c in ("was", "cluster"))
            looked, depth = looked + int(batch["looked"].to_numpy().sum()), max(depth, int(batch["depth"].to_numpy().max(initial=0)))
            at = np.flatnonzero(was != now)
            if at.size:
                x = _vectors(batch["vector"].take(pa.array(at)), at.size)
                for place, sign in ((now[at], 1), (was[at], -1)):
                    held = place >= 0
                    np.add.at(sums, place[held], sign * x[held])
                    counts += sign * np.bincount(place[held], minlength=k)
        n = k * (dimensions + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.concatenate([sums.reshape(-1), counts])), pa.array(np.full(n, looked)), pa.array(np.full(n, depth, np.int64))], ["at", "change", "looked", "depth"])

    parts = arrow(state.select("was", "cluster", "vector", "looked", "depth"), run, "at long, change long, looked long, depth long")
    rows = parts.groupBy("at").agg(F.sum(F.col("change").cast("decimal(20,0)")).alias("change"), F.sum("looked").alias("looked"), F.max("depth").alias("depth")).collect()
    out = np.zeros(k * (dimensions + 1), object)
    for r in rows:
        out[r["at"]] = int(r["change"])
    return out[: k * dimensions].reshape(k, dimensions), out[k * dimensions :], max((r["looked"] for r in rows), default=0), max((r["depth"] for r in rows), default=0)


@dataclass
class Clustering:
    """``state`` has the rows' vec_id, vector and cluster; ``looked``: the distances taken in each round, the first being of all."""

    state: DataFrame
    centroids: np.ndarray
    looked: list[int]


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Clustering:
    """Lloyd's rounds over ``vectors`` (vec_id, x), then one more assignment."""
    c = first_centroids(vectors, k, seed)
    k, dims = c.shape
    if not k:
        return Clustering(vectors.sparkSession.createDataFrame([], STATE), c, [])
    b = min(max(1, -(-k // 4)), k - 1)
    state = seeded(vectors, c, b).persist(StorageLevel.MEMORY_AND_DISK)
    sums, counts, looked, old = np.zeros((k, dims), object), np.zeros(k, object), [], None
    for r in range(rounds):
        more, n, seen, depth = changes(state, k, dims)  # this fills the persisted state, which no longer needs the one before
        if old is not None:
            old.unpersist()
        sums, counts, looked = sums + more, counts + n, [*looked, seen]
        new = np.array([[int(s) // int(n) for s in row] if n else list(was) for row, n, was in zip(sums, counts, c)], np.int64)
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
        if r:
            b = min(b, max(depth, -(-k // 8)))
        old, c = state, new
        state = stepped(old, c, moved, b)
        state = (cut(state) if r % EVERY == EVERY - 1 else state).persist(StorageLevel.MEMORY_AND_DISK)
    return Clustering(state, c, looked)


def measured(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row; a sum beyond a long is null."""
    c = found.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                d = _own(_vectors(batch["vector"], n), c, batch["cluster"].to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(d)], ["vec_id", "cluster", "distance"])

    rows = arrow(found.state.select("vec_id", "vector", "cluster"), run, "vec_id long, cluster int, distance long")
    sums = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}  # a row for each centroid
    whole = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    by_cluster = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1) if values else F.lit(None)
    inertia = by_cluster([whole(sums.get(i, 0)) for i in range(len(c))])
    digest = by_cluster([F.lit(hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for row in c.tolist()])
    return rows.select("vec_id", "cluster", "distance", inertia.cast("long").alias("cluster_inertia"), whole(sum(sums.values())).alias("inertia"), digest.cast("string").alias("centroid_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` in 8 clusters, after 10 rounds."""
    return measured(clustered(scaled(table(spark, sf_dir, "embeddings"))))


def _sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} as materialized (select rid, c, sum((q - m) * (q - m)) as dist from parts join c{r} using (pos) group by rid, c),
a{r} as materialized (select rid, arg_min(c, (dist, c)) as c, min(dist) as dist from d{r} group by rid)""")
        if r < ROUNDS:
            steps.append(f"""s{r} as materialized (select c, pos, sum(q) as s, count(*) as n from parts join a{r} using (rid) group by c, pos),
c{r + 1} as materialized (select o.c, o.pos, case when n is null then m else (s - ((s % n) + n) % n) // n end as m from c{r} o left join s{r} using (c, pos))""")
    return f"""with given as (select row_number() over () as rid, vec_id, embedding from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {DIMENSIONS}),
kept as materialized (select rid, vec_id, list_transform(embedding, lambda v: cast(floor({SCALE} * cast(v as double)) as bigint)) as x from given),
parts as materialized (select rid, unnest(range({DIMENSIONS})) as pos, cast(unnest(x) as hugeint) as q from kept),
chosen as (select x, row_number() over (order by sha256('{SEED}:' || coalesce(cast(vec_id as varchar), '')), vec_id, x) - 1 as c from kept),
c0 as materialized (select c, unnest(range({DIMENSIONS})) as pos, cast(unnest(x) as hugeint) as m from chosen where c < {CLUSTERS}),
{",\n".join(steps)},
sums as (select c, sum(dist) as own from a{ROUNDS} group by c),
names as (select c, sha256(string_agg(cast(m as varchar), ',' order by pos)) as name from c{ROUNDS} group by c)
select k.vec_id, cast(a.c as int) as cluster, cast(a.dist as bigint) as distance, cast(own as bigint) as cluster_inertia, cast((select sum(dist) from a{ROUNDS}) as bigint) as inertia, name as centroid_sha256
from a{ROUNDS} a join kept k using (rid) join sums using (c) join names using (c)"""


SQL = _sql()
