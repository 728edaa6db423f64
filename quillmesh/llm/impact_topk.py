"""Exact top-k inner-product search with an impact-ordered, score-at-a-time index.

A vector's integer components are postings: (dimension, row, value). A block's rows stand by descending norm, so each
dimension's posting list falls into segments of SEGMENT rows, the large rows first; a segment has a quantised
impact, |query component| times its largest value, in powers of two below the query's largest. Segments are processed
in rounds of descending impact, adding to one accumulator for each query and row of the block.
What is still open of a row adds at most the norm of the query's open components times the norm of the row's (Cauchy-Schwarz), so
after a round each score lies between two bounds. A row is a possible member of the top k while its upper bound
reaches the k-th largest lower bound; a query stops when that proof leaves few rows, and those are
rescored exactly. Without such a proof the last round has processed every segment.

The first block of rows is searched before the others. Each query's k-th score there is a floor that all of them share:
segments of rows whose norm can't reach it are never read.

Rows and queries meet in blocks of bounded size by an equality cogroup on (dimensions, row block, query
block), so neither side is broadcast or collected whole; the best k of each block are merged by a window. A row is sent once for
QUERY_BLOCK queries, which are searched QUERY_BATCH at a time.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without an id; only vectors of equal dimension meet; a query's own id is never its candidate; equal
scores rank by smaller id; repeated rows of a query count once, repeated candidates each; fewer than
k candidates give fewer rows; further columns are ignored. Vectors of any width go through the index; where components are so large that doubles round, the bounds are
wider by what that can amount to, and the rescoring is of whole numbers. Scores must fit a signed long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a block of candidates and of a block of queries, for WIDTH dimensions; wider vectors come in smaller blocks.
ROW_BLOCK, QUERY_BLOCK, WIDTH = 4096, 16_384, 64
#: Queries searched at a time, rows of a segment, rounds of impact.
QUERY_BATCH, SEGMENT, ROUNDS = 256, 512, 4
#: A query stops once its possible members are at most so many times k.
STOP = 16


def quantised(c: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as a double; null if the vector takes no part."""
    d = F.transform(c, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(c.isNotNull() & (F.size(c) > 0) & ~bad, F.transform(d, lambda x: F.floor(x * scale).cast("long")))


class ImpactIndex:
    """A block's postings in segments of descending norm; ``top`` searches it exactly. ``read`` counts the postings processed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        squares = vectors.astype(np.float64) ** 2
        order = np.argsort(-squares.sum(axis=1), kind="stable")
        self.ids, self.exact = ids[order], vectors[order]
        #: Posting lists by dimension, and the squares of their values.
        self.postings = np.ascontiguousarray(self.exact.T, dtype=np.float64)
        self.squares = np.ascontiguousarray(squares[order].T)
        self.segments = [slice(at, at + SEGMENT) for at in range(0, len(ids), SEGMENT)]
        #: The largest magnitude of each (segment, dimension), and the largest norm of a segment's rows.
        self.upper = np.array([np.abs(self.postings[:, s]).max(axis=1) for s in self.segments])
        self.norms = np.array([np.sqrt(self.squares[:, s].sum(axis=0).max()) for s in self.segments])
        self.largest = float(np.abs(self.postings).max(initial=0))
        self.read = 0

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(query id, row id, score) of each query's k best rows that reach its floor."""
        floor = np.full(len(queries), -np.inf) if floor is None else np.nextafter(floor, -np.inf)  # a score may have been rounded up
        found = []
        for at in range(0, len(queries), QUERY_BATCH):
            part = slice(at, at + QUERY_BATCH)
            found += self._search(query_ids[part], queries[part], k, floor[part])
        return found

    def _search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
        q = queries.astype(np.float64)
        # accumulators of doubles are exact up to 2**53; beyond, they are off by this at most
        sizes = np.abs(q).max(axis=1, initial=0) * self.largest * q.shape[1]
        off = np.where(sizes < 2.0**53, 0, sizes * 2.0**-52 * (q.shape[1] + 3))[:, None]
        impact = np.abs(q)[:, None, :] * self.upper[None]  # query, segment, dimension
        share = impact / np.maximum(impact.max(axis=(1, 2), initial=0), 1e-300)[:, None, None]
        level = np.minimum(ROUNDS - 1, np.floor(-np.log2(np.maximum(share, 1e-300)))).astype(np.int8)
        within = np.sqrt((q * q).sum(axis=1))[:, None] * self.norms[None] * (1 + 1e-9) + 1 + off >= floor[:, None]
        acc, left, alive, found = np.zeros((len(q), len(self.ids))), np.repeat(off, len(self.ids), 1), np.arange(len(q)), []
        for r in range(ROUNDS):
            maybe = query_ids[alive][:, None] != self.ids[None]
            for n, s in enumerate(self.segments):
                at = np.flatnonzero(within[alive, n])
                maybe[np.flatnonzero(~within[alive, n]), s] = False
                if not len(at):
                    continue
                now = np.where(level[alive[at], n] == r, q[alive[at]], 0)
                if now.any():
                    acc[at, s] += now @ self.postings[:, s]
                    self.read += int(np.count_nonzero(now)) * self.postings[:, s].shape[1]
                later = np.where(level[alive[at], n] > r, q[alive[at]], 0)
                wide = (later * later).sum(axis=1)[:, None] * ((later != 0).astype(np.float64) @ self.squares[:, s])
                left[at, s] = np.where(wide > 0, np.sqrt(wide) * (1 + 1e-9) + 1, 0) + off[alive[at]]
            kth = floor[alive][:, None]
            if len(self.ids) > k:
                low = np.where(maybe, acc - left, -np.inf)
                kth = np.maximum(kth, np.partition(low, -k, axis=1)[:, -k][:, None])
            maybe &= acc + left >= kth
            stop = (maybe.sum(axis=1) <= STOP * k) | (r == ROUNDS - 1)
            for i in np.flatnonzero(stop):
                rows = np.flatnonzero(maybe[i])
                scores = self.exact[rows] @ queries[alive[i]]
                order = np.lexsort((self.ids[rows], -scores))[:k]
                found += zip([int(query_ids[alive[i]])] * len(order), self.ids[rows][order].tolist(), scores[order].tolist())
            alive, acc, left = alive[~stop], acc[~stop], left[~stop]
            if not len(alive):
                break
        return found


def _vectors(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.int64)


def _search(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if rows.empty or queries.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        v, q = _vectors(rows["v"]), _vectors(queries["w"])
        ids, query_ids = rows["id"].to_numpy(), queries["query_id"].to_numpy()
        found = ImpactIndex(ids, v).top(query_ids, q, k, queries["floor"].fillna(-np.inf).to_numpy())
        return pd.DataFrame(found, columns=names).astype("int64")

    return run


def _blocks(df: DataFrame, n: int) -> int:
    """Blocks of ``n`` rows of WIDTH dimensions that the vectors fill."""
    rows, components = df.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    return max(1, -(-rows // n), -(-components // (n * WIDTH)))


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products; both sides are (id, v array<long>), v null where a row takes no part."""
    ready = lambda df: df.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dims"))
    rows, queries = cut(ready(rows)), cut(ready(queries).dropDuplicates(["id", "v"]))
    row_blocks, query_blocks = _blocks(rows, ROW_BLOCK), _blocks(queries, QUERY_BLOCK)
    queries = queries.select(F.col("id").alias("query_id"), F.col("v").alias("w"), F.col("dims").alias("width"))
    # repeated rows are dealt by their places, which the checkpoint fixes; queries are distinct
    left = rows.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int"))
    right = queries.withColumn("other", F.pmod(F.xxhash64("query_id", "w"), F.lit(query_blocks)).cast("int")).withColumn("floor", F.lit(None).cast("double"))
    search = lambda a, b: a.cogroup(b).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    # the first block gives the floors of the others
    found = search(left.where("part = 0").withColumn("other", _every(query_blocks)).groupBy("dims", "other"), right.groupBy("width", "other"))
    if row_blocks > 1:
        found = cut(_ranked(found, k))
        floors = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        right = right.drop("floor").join(floors, "query_id", "left").withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(row_blocks - 1))))
        others = left.where("part > 0").withColumn("other", _every(query_blocks)).groupBy("dims", "part", "other")
        found = found.drop("rank").union(search(others, right.groupBy("width", "part", "other")))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op4_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of each query, a row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 50 = 0"), 5)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from (select distinct * from v where vec_id % 50 = 0) q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v))
select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s) where rank <= 5
"""
