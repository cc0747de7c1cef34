"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Up to so many edges are contracted in one partition, where a round needs no shuffle.
FEW = 100_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that a link joins to another; root is the component's least node.

    A large star links each node's greater neighbours to its least one, a small star its lesser ones; edges never grow
    in number and end as stars. Null ends and loops are ignored, repeated links count once, no links give no rows.
    Only a count and a hash of each round's edges reach the driver.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(hi.alias("hi"), lo.alias("lo")).where("hi <> lo").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        if seen[0] <= FEW:
            edges = edges.coalesce(1)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m")), F.struct(F.col("lo").alias("hi"), F.col("m")))).alias("e"))
        edges = cut(near.select(F.col("e.hi").alias("hi"), F.col("e.m").alias("lo")).where("hi <> lo").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo"), F.col("lo")).distinct())
