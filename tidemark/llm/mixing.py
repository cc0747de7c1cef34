"""Mixing sources to target weights by fitting budgets exactly.

A source's documents are counted by length. Whole passes are taken first; what is left of the budget, but for its last
words, is shared over the lengths in proportion, and a bounded knapsack by dynamic programming over the lengths fits the
last words exactly. Which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, packed, unpacked

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Columns that mix adds.
FIGURES = ("size", "source_size", "target", "taken")
#: Hash ranges into which the documents of one source and length are dealt, so that none is a task of its own.
RANGES = 1024
#: Rows of the plan that may be broadcast; a longer plan is joined by a shuffle.
BROADCAST_ROWS = 50_000
#: The knapsack's table: at least this many words, and at least two documents of the greatest length.
TABLE = 1 << 17


def targets(sizes: dict, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> dict:
    """Words wanted from each source, as fractions.

    Sources in code point order, null last, have the weights in turn and share the sum of all sizes. A target stops at
    `most` times its source's size; the excess is shared among the others by weight until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, found = Fraction(sum(sizes.values())), {}
    free = list(names)
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            found |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            found[s] = Fraction(most * sizes[s])
            rest -= found[s]
        free = [s for s in free if s not in found]
    return found


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their words come as near to the budget as they can."""
    total = sum(s * c for s, c in zip(sizes, counts))
    budget = max(0, min(budget, total))
    if not budget:
        return [0] * len(sizes)
    table = max(TABLE, 2 * max(sizes))
    take = [c * max(0, budget - table) // total if s else 0 for s, c in zip(sizes, counts)]
    rest = budget - sum(s * t for s, t in zip(sizes, take))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        if rest > table and sizes[i]:
            n = min(counts[i] - take[i], (rest - table) // sizes[i])
            take[i] += n
            rest -= n * sizes[i]
    #: reached[w]: some choice of what is left has w words; by[w]: the item that reached it first
    reached, by, items = np.zeros(rest + max(sizes) + 1, dtype=bool), np.full(rest + max(sizes) + 1, -1, dtype=np.int32), []
    reached[0] = True
    for i in order:
        left, n = counts[i] - take[i] if sizes[i] else 0, 1
        while left and not reached[rest]:
            n = min(n, left)
            step = n * sizes[i]
            if step < len(reached):
                new = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
                reached[new] = True
                by[new] = len(items)
                items.append((i, n))
            left -= n
            n *= 2
        if reached[rest]:
            break
    at = np.flatnonzero(reached)
    w = int(at[np.abs(at - rest).argmin()])
    while w:
        i, n = items[by[w]]
        take[i] += n
        w -= n * sizes[i]
    return take


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES, seed: int = 11) -> DataFrame:
    """docs with size, source_size, target and taken: how many of a document's words the mix takes, repeats counted.

    A document is taken whole, up to `most` times. A null text has size zero and is never taken. Repeated rows count
    each; which of equal rows is taken makes no difference. Reruns agree, since the draw hashes seed, doc_id and text.
    Columns of these names are replaced, all others pass through, whatever their names. An empty table gives no rows.
    Texts are whole, of any length. Totals by source reach the driver, and nothing else does; one source's counts by length
    are fitted in one task, in some bytes for each word of the longest document.
    """
    kept = docs.drop(*FIGURES)
    return unpacked(_planned(kept, weights, most, seed), kept.columns, *[F.col(c) for c in FIGURES])


def _planned(docs: DataFrame, weights: tuple, most: int, seed: int) -> DataFrame:
    """docs packed, with size, source_size, target and taken."""
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = packed(docs, F.col("source").cast("string").alias("source"), size.alias("size"), draw.alias("_draw"))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_draw", 64 - (RANGES - 1).bit_length()).cast("int"))
    ranges = cut(rows.groupBy("source", "size", "_range").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["source"]: int(r["words"]) for r in ranges.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    if not sizes:
        return rows.drop("_draw", "_range").select("*", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    wanted = targets(sizes, weights, most)
    passes = {s: min(most, int(wanted[s] // sizes[s])) if sizes[s] else 0 for s in sizes}
    budget = {s: max(0, round(wanted[s]) - passes[s] * sizes[s]) if passes[s] < most else 0 for s in sizes}
    of_source = docs.sparkSession.createDataFrame([(s, sizes[s], float(wanted[s]), passes[s], budget[s]) for s in sizes], "s string, source_size long, target double, passes int, budget long")

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame["take"] = fit(frame["size"].tolist(), frame["n"].tolist(), int(frame["budget"].iloc[0]))
        return frame[["s", "size", "take"]]

    lengths = ranges.groupBy(F.col("source").alias("s"), "size").agg(F.sum("n").alias("n"))
    counts = lengths.join(of_source.select("s", "budget"), lengths["s"].eqNullSafe(of_source["s"])).select(lengths["s"], "size", "n", "budget")
    chosen = counts.groupBy("s").applyInPandas(fitted, "s string, size long, take long")
    # the hash range in which a length's draw ends, and how many of it are still taken
    before = ranges.alias("a").join(chosen, ranges["source"].eqNullSafe(chosen["s"]) & (ranges["size"] == chosen["size"]))
    per = before.groupBy("s", chosen["size"]).agg(F.first("take").alias("take"), F.array_sort(F.collect_list(F.struct("_range", "n"))).alias("ranges"))
    spent = F.aggregate(
        "ranges",
        F.struct(F.col("take").alias("left"), F.lit(-1).alias("last"), F.lit(0).cast("long").alias("rest")),
        lambda acc, x: F.when(acc["left"] <= 0, acc).otherwise(F.struct((acc["left"] - x["n"]).alias("left"), x["_range"].alias("last"), F.least(acc["left"], x["n"]).alias("rest"))),
    )
    plan = per.select(F.col("s").alias("s"), F.col("size").alias("z"), spent.alias("x")).select("s", "z", F.col("x.last").alias("_last"), F.col("x.rest").alias("_rest"))
    plan = cut(plan.join(of_source.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2", "budget"))
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    known = rows.join(plan, rows["source"].eqNullSafe(plan["s"]) & (rows["size"] == plan["z"])).drop("s", "z")
    edge = known.where("_range = _last").selectExpr("*", "row_number() OVER (PARTITION BY source, size ORDER BY _draw) <= _rest AS _in")
    sure = known.where("_range <> _last").withColumn("_in", F.col("_range") < F.col("_last"))
    taken = (F.col("passes") + F.col("_in").cast("int")) * F.col("size")
    return sure.unionByName(edge).withColumn("taken", taken.cast("long")).drop("_draw", "_range", "_last", "_rest", "_in", "passes")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES, seed: int = 11) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    rows = _planned(docs, weights, most, seed).where("taken > 0")
    copies = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return unpacked(rows.withColumn("_copy", F.explode(copies)), docs.columns)
