"""Exact quantiles beside sorted lists."""

import random

import numpy as np
import pytest

from tidemark.operators.features import account_features
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import profile, queries

SF = "/root/testdata/sf0.001"
POINTS = {"least": 0.0, "p25": 0.25, "median": 0.5, "p99": 0.99, "greatest": 1.0}


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_quantiles_are_those_of_sorted_values(spark, width):
    draw, rows = random.Random(width), []
    for i in range(900):
        key = "hub" if i % 3 == 0 else draw.choice([None, "a", "b", "c"])
        rows.append((key, draw.choice([None, 5, draw.randrange(-300, 300), draw.randrange(2)])))
    rows.append(("only null", None))
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: tuple(r)[1:] for r in exact_quantiles(df, ["k"], "v", POINTS, width).collect()}
    by = {k: [v for x, v in rows if x == k and v is not None] for k in {k for k, _ in rows}}
    assert got.keys() == {k for k, v in by.items() if v}
    for k, v in got.items():
        assert v == pytest.approx([np.quantile(by[k], p) for p in POINTS.values()], abs=1e-9)
    (whole,) = exact_quantiles(df, [], "v", POINTS, width).collect()
    assert tuple(whole) == pytest.approx([np.quantile([v for _, v in rows if v is not None], p) for p in POINTS.values()], abs=1e-9)
    assert exact_quantiles(df.limit(0), ["k"], "v", POINTS, width).collect() == []


def test_no_buffer_holds_a_hubs_amounts(spark):
    plan = account_features(queries.ledger(spark, SF))._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "median(" not in plan
    whole = profile.amount_percentiles(queries.ledger(spark, SF)).collect()
    amounts = [r[0] for r in queries.ledger(spark, SF).select("amount_paise").collect()]
    assert len(whole) == 1 and whole[0]["p95"] == pytest.approx(np.quantile(amounts, 0.95)) and whole[0]["least"] == min(amounts)


@pytest.mark.parametrize("size", [1, 3, 1_000_000])
def test_inversions_in_ranges_of_any_size(spark, size):
    draw = random.Random(size)
    rows = [(i * (1 + i % 3), draw.randrange(50)) for i in range(200)]
    rows = sorted({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "row_id long, epoch_s long")
    assert profile.inversions(df, size).first()[0] == sum(a[1] > b[1] for a, b in zip(rows, rows[1:]))
