"""Connected components of a graph that is larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of each node that has an edge; root is the smallest node that it reaches.

    Parents are hooked onto smaller grandparents and paths are halved until nothing changes, so
    the rounds grow with the logarithm of a component's diameter. A round is cut by a
    checkpoint, which leaves each join with two exchanges: Spark can then split the partition of
    a parent that a third of the nodes share. Null nodes take no part; no edges give no rows.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u != v")
    e = cut(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    f = cut(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("f")))
    while True:
        up = f.select(F.col("node").alias("f"), F.col("f").alias("g"))
        g = cut(f.join(up, "f").select("node", "f", "g"))
        seen = e.join(g.select(F.col("node").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        hooked = cut(g.join(seen.withColumnRenamed("u", "node"), "node").select("node", "f", "g", "m"))
        roots = cut(hooked.groupBy("f").agg(F.min("m").alias("r")).select(F.col("f").alias("node"), "r"))
        new = hooked.join(roots, "node", "left").select("node", F.col("f").alias("old"), F.least("f", "g", "m", "r").alias("f"))
        new = cut(new)
        if new.where("old != f").isEmpty():
            return new.select("node", F.col("f").alias("root"))
        f = new.select("node", "f")
