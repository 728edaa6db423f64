"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a row's hash. A bucket whose rows hold more
than the byte limit splits on one more bit; a bucket that fits stays as it is, so buckets
have different local depths. The tree comes from a histogram of hash prefixes, ``step``
bits at a time: one aggregation gives the bytes below each prefix of up to ``step`` bits,
and a further one runs only for the prefixes that are still too large.

Defined cases: null text counts as empty and null ids are hashed as such; equal rows get
different hashes by their copy number, so that copies of one document can be split as well;
a row that alone exceeds the limit has a shard to itself; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, each_copy, table

#: Bytes of text that one shard may hold.
SHARD_BYTES = 32 << 20
#: Hash bits looked at in one aggregation: its result has at most 2 ** STEP rows an open bucket.
STEP = 12
BITS = 64


def hashed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bytes, bits) of each row; bits: 64 hash bits as a string of 0 and 1.

    Equal rows are counted before the shuffle and told apart afterwards, so a document
    copied to a third of the corpus is one row for each task of the exchange.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.md5(text.cast("binary")).alias("digest"))
    rows = rows.groupBy("id", "bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = each_copy(rows, "n", "copy").withColumn("copy", F.col("copy") + 1)
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "digest", F.col("copy").cast("string"))
    bits = F.lpad(F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 2), BITS, "0")
    return rows.select("id", "bytes", bits.alias("bits"))


def _prefix(bits: str, depth) -> F.Column:
    return F.expr(f"left({bits}, {depth})")


def _split(rows: DataFrame, base: int, step: int, max_bytes: int) -> DataFrame:
    """(bucket, leaf, shard_bytes, shard_docs) for each prefix of base + step bits in ``rows``; leaf is null where the bucket is still too large."""
    top = min(BITS, base + step)
    hist = rows.groupBy(_prefix("bits", top).alias("bucket")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    paths = hist.select("bucket", "b", "n", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
    paths = paths.select("bucket", "depth", _prefix("bucket", "depth").alias("prefix"), "b", "n")
    nodes = paths.groupBy("prefix", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)
    # a child never holds more than its parent: the shallowest prefix that fits is the leaf
    leaf = F.min(F.when(fits, F.struct("depth", F.col("prefix").alias("leaf"), "shard_bytes", "shard_docs")))
    return paths.join(nodes, ["prefix", "depth"]).groupBy("bucket").agg(leaf.alias("l")).select("bucket", F.col("l.leaf").alias("leaf"), F.col("l.shard_bytes").alias("shard_bytes"), F.col("l.shard_docs").alias("shard_docs"))


def assign_shards(rows: DataFrame, max_bytes: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """(id, bytes, shard, local_depth, shard_bytes, shard_docs) of each row of ``hashed_rows``.

    ``shard`` is the bucket's hash prefix, "" for the whole table. The driver learns only
    whether a bucket is still open, at most 64 / step times.
    """
    rows = cut(rows)
    done, base = None, 0
    while True:
        buckets = cut(_split(rows, base, step, max_bytes))
        found = buckets.where(F.col("leaf").isNotNull())
        top = min(BITS, base + step)
        keyed = rows.withColumn("bucket", _prefix("bits", top))
        # the first round has at most 2 ** step buckets, whatever the input
        part = keyed.join(F.broadcast(found) if base == 0 and step <= STEP else found, "bucket")
        part = part.select("id", "bytes", F.col("leaf").alias("shard"), F.length("leaf").alias("local_depth"), "shard_bytes", "shard_docs")
        done = part if done is None else done.unionAll(part)
        still = buckets.where(F.col("leaf").isNull()).select("bucket")
        if still.isEmpty():
            return done
        rows, base = cut(keyed.join(still, "bucket", "left_semi").drop("bucket")), top


def directory(assigned: DataFrame) -> DataFrame:
    """The directory: for each index of ``global_depth`` bits the shard it points to.

    Its size is 2 ** global_depth: a lookup structure to be read by prefix, not to be collected.
    """
    shards = assigned.groupBy("shard").agg(F.first("local_depth").alias("local_depth"), F.first("shard_bytes").alias("shard_bytes"), F.first("shard_docs").alias("shard_docs"))
    depth = shards.agg(F.max("local_depth").alias("global_depth"))
    free = F.expr("cast(shiftleft(1L, global_depth - local_depth) as bigint)")
    index = F.expr("shard || if(global_depth = local_depth, '', lpad(bin(suffix), global_depth - local_depth, '0'))")
    return shards.join(F.broadcast(depth), F.lit(True)).withColumn("suffix", F.explode(F.sequence(F.lit(0).cast("long"), free - 1))).select(index.alias("index"), "shard", "local_depth", "global_depth", "shard_bytes", "shard_docs")


def op10_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard under SHARD_BYTES."""
    return assign_shards(hashed_rows(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


_NIBBLES = "translate(substr(md5(key), 1, 16), '0123456789abcdef', 'ghijklmnopqrstuv')"
for _i in range(16):
    _NIBBLES = f"replace({_NIBBLES}, '{chr(103 + _i)}', '{_i:04b}')"

SQL = f"""
with rows as (select doc_id, octet_length(encode(coalesce(text, ''))) bytes, md5(coalesce(text, '')) digest from documents),
copies as (select *, row_number() over (partition by doc_id, bytes, digest) as copy from rows),
keys as (select doc_id, bytes, coalesce(cast(doc_id as varchar), 'null') || ':' || digest || ':' || cast(copy as varchar) as key from copies),
bits as (select doc_id, bytes, key, {_NIBBLES} as bits from keys),
paths as (select doc_id, bytes, key, d as depth, left(bits, cast(d as bigint)) as prefix from bits, range(0, 65) t(d)),
nodes as (select prefix, depth, sum(bytes) shard_bytes, count(*) shard_docs from paths group by all),
fit as (select doc_id, bytes, key, p.depth, p.prefix, shard_bytes, shard_docs, row_number() over (partition by key order by p.depth) rn
  from paths p join nodes n on p.prefix = n.prefix and p.depth = n.depth
  where shard_bytes <= {SHARD_BYTES} or shard_docs = 1 or p.depth = 64)
select doc_id, cast(bytes as bigint) as bytes, prefix as shard, cast(depth as int) as local_depth, cast(shard_bytes as bigint) as shard_bytes, cast(shard_docs as bigint) as shard_docs
from fit where rn = 1
"""
