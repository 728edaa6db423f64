"""Tables of one row a key that grow by batches: what a batch reads of them follows the batch.

A batch adds a run, a folder of Parquet files with a Bloom filter over the key, sorted by it, and dealt to folders by hash bits of the key as its size asks for.
FANOUT runs of one level are merged to one of the next, so a key is rewritten once for each level, and the runs number FANOUT times the
logarithm of the batches at most. A few keys are looked up by value: Spark prunes folders by their hash, row groups by the Bloom filters and pages by the sort order. Many are
joined, with the folders that they hash to.

Rows of one key from several runs are combined by the table's ``merge``, aggregates that give the same whatever the order and however often a row is given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources import files

FANOUT = 8
#: Rows of a folder of hash bits, and the most bits.
BUCKET_ROWS, MOST_BITS = 1 << 20, 14
#: Rows of the runs of level 0; each level has FANOUT times more.
FIRST_ROWS = 1 << 12
#: Keys that are looked up by value at most.
POINTS = 256


@dataclass(frozen=True)
class Keyed:
    """``name`` of its folder; ``schema`` of its rows, with a string column ``key``; ``merge``: (column, SQL aggregate) of the others."""

    name: str
    schema: str
    merge: tuple[tuple[str, str], ...]

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(*(F.expr(how).alias(c) for c, how in self.merge))


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("key"), 64 - bits).cast("int") if bits else F.lit(0)


def _level(n: int) -> int:
    level = 0
    while n > FIRST_ROWS * FANOUT**level:
        level += 1
    return level


def write(rows: DataFrame, table: Keyed, path: str, run: str, n: int) -> dict | None:
    """Writes a run of ``n`` rows at most and describes it; None if there were no rows."""
    bits = min(MOST_BITS, max(0, (max(n, 1) - 1) // BUCKET_ROWS).bit_length())
    dealt = rows.withColumn("bucket", _bucket(bits)).repartitionById(1 << bits, "bucket").sortWithinPartitions("bucket", "key")
    bloom = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(max(1, min(n, BUCKET_ROWS)))}
    dealt.write.options(**bloom).option("parquet.page.size", 1 << 16).partitionBy("bucket").parquet(f"{path}/{table.name}/{run}")
    n = rows.sparkSession.read.schema("key string").parquet(f"{path}/{table.name}/{run}").count()  # of the files' footers
    if not n:
        files.remove(rows.sparkSession, f"{path}/{table.name}/{run}")
        return None
    return {"run": run, "bits": bits, "level": _level(n), "rows": n}


def read(spark: SparkSession, table: Keyed, path: str, live: list[dict]) -> DataFrame:
    """The table's rows, one a key."""
    runs = [_run(spark, table, path, r).drop("bucket") for r in live]
    return table.merged(reduce(DataFrame.unionByName, runs)) if runs else spark.createDataFrame([], table.schema)


def _run(spark: SparkSession, table: Keyed, path: str, run: dict) -> DataFrame:
    return spark.read.schema(f"{table.schema}, bucket int").parquet(f"{path}/{table.name}/{run['run']}")


def _any_of(column: Column, values: list[str]) -> Column:
    """Equality with one of the values, as a balanced tree: a long list would reach the files as its least and greatest alone."""
    if len(values) == 1:
        return column == values[0]
    half = len(values) // 2
    return _any_of(column, values[:half]) | _any_of(column, values[half:])


def find(spark: SparkSession, table: Keyed, path: str, live: list[dict], keys: DataFrame, most: int) -> DataFrame:
    """The rows of ``keys`` (key), of which there are ``most`` at most, repeats included."""
    if not live:
        return spark.createDataFrame([], table.schema)
    keys = keys.where("key is not null").distinct()
    if most <= POINTS:
        values = [r["key"] for r in keys.collect()]
        if not values:
            return spark.createDataFrame([], table.schema)
        places = {r["bits"]: [x["b"] for x in spark.createDataFrame([(v,) for v in values], "key string").select(_bucket(r["bits"]).alias("b")).distinct().collect()] for r in live if r["bits"]}
        some = lambda r, df: df.where(F.col("bucket").isin(places[r["bits"]])) if r["bits"] else df
        runs = [some(r, _run(spark, table, path, r)).where(_any_of(F.col("key"), values)) for r in live]
    else:
        runs = [_run(spark, table, path, r).join(keys.withColumn("bucket", _bucket(r["bits"])), ["bucket", "key"], "left_semi") for r in live]
    return table.merged(reduce(DataFrame.unionByName, (r.drop("bucket") for r in runs)))


def due(live: list[dict]) -> list[dict]:
    """Runs of one level that are to be merged, of the lowest such level."""
    for level in sorted({r["level"] for r in live}):
        same = [r for r in live if r["level"] == level]
        if len(same) >= FANOUT:
            return same
    return []


def merge(spark: SparkSession, table: Keyed, path: str, live: list[dict], runs: list[dict], name: str, keep: Column | None = None) -> list[dict]:
    """``live`` with ``runs`` as one run, of the rows that ``keep`` holds for."""
    rows = read(spark, table, path, runs)
    n = sum(r["rows"] for r in runs)
    new = write(rows if keep is None else rows.where(keep), table, path, name, n)
    rest = [r for r in live if r not in runs]
    if new is None:
        return rest
    return [*rest, new | {"level": max(new["level"], 1 + max(r["level"] for r in runs) if len(runs) > 1 else 0)}]
