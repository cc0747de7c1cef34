"""Accounts with very many rows, which are worked on apart from all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise

#: Rows of an account that one task may hold together.
FEW = 100_000


def apart(rows: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """rows of accounts (acc) with at most `few` of them, and those of the others, None if there are none.

    The others are written once; there are fewer of them than rows / few. Null accounts stay with the first.
    """
    hubs = materialise(rows.where("acc IS NOT NULL").groupBy("acc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("acc"), "hubs")
    if hubs.isEmpty():
        return rows, None
    return rows.join(F.broadcast(hubs), "acc", "left_anti"), rows.join(F.broadcast(hubs), "acc", "left_semi")
