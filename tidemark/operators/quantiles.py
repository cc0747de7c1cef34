"""Exact quantiles by ranks over counted values.

Rows are counted by key and value first. Values are dealt into ranges of one width, whose counts say in which range each
wanted rank lies and how many values come before it; only those ranges are looked into. So a key with very many rows, or
with very many different values, is spread over tasks: no buffer and no window holds more than one range of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different whole numbers of a range.
WIDTH = 1 << 16


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], width: int = WIDTH) -> DataFrame:
    """keys and a double column for each of points (name: share from 0 to 1), interpolated between the two nearest ranks.

    value is a column of whole numbers; nulls are left out, and keys without any other value have no row. Null keys are a
    key of their own. Without keys there is one row, or none for an empty table.
    """
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    v, part = F.col(value).cast("long"), F.floor(F.col("_v") / width)
    counts = rows.where(F.col(value).isNotNull()).select(*[F.col(f"`{k}`").alias(n) for k, n in names.items()], v.alias("_v")).groupBy(*names.values(), "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", part)
    own = list(names.values()) or [F.lit(1)]
    before = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*names.values(), "_part").agg(F.sum("_n").alias("_size"))
    placed = parts.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_all": F.sum("_size").over(Window.partitionBy(*own))})
    place = {p: (F.col("_all") - 1) * F.lit(float(p)) for p in points.values()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place.values()])))
    asked = placed.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size")))).where(F.size("_ranks") > 0)
    same = asked.select(*[F.col(n).alias(f"{n}_") for n in names.values()], F.col("_part").alias("_part_"), "_before", "_all", "_ranks")
    match = F.col("_part") == F.col("_part_")
    for n in names.values():
        match = match & F.col(n).eqNullSafe(F.col(f"{n}_"))
    within = Window.partitionBy(*names.values(), "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.join(same, match).withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    hits = upto.select(*names.values(), "_v", "_all", F.explode(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))).alias("_rank"))

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    found = hits.groupBy(*names.values()).agg(F.max("_all").alias("_all"), *[x for i, p in enumerate(points.values()) for x in (at(F.floor(place[p])).alias(f"_a{i}"), at(F.ceil(place[p])).alias(f"_b{i}"))])
    out = []
    for i, (name, p) in enumerate(points.items()):
        x, a, b = place[p], F.col(f"_a{i}").cast("double"), F.col(f"_b{i}").cast("double")
        out.append(F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b).alias(name))
    return found.select(*[F.col(n).alias(k) for k, n in names.items()], *out)
