"""A folder of our own in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillmesh-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what is derived from it reads columns instead of computing them again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition of ``spread``.
SPREAD_ROWS = 1 << 15


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` over as many partitions as there are cores, and as ``rows`` a partition ask for, if its files are fewer: so tasks become more, not longer, as a table grows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
