"""Accounts gathered by one shuffle beside the same accounts spread over tasks, and what either costs."""

import random

import pytest

from tidemark.operators import features, velocity
from tidemark.plans import queries
from tidemark.sources import ledger as source

SF = "/root/testdata/sf0.001"


def by_account(df):
    return {r["account_number"]: r.asDict() for r in df.collect()}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def same(got, want):
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k] == pytest.approx(row, abs=1e-9) if all(isinstance(v, (int, float)) for v in row.values()) else {c: pytest.approx(v) if isinstance(v, float) else v for c, v in row.items()} == got[k]


def test_features_are_gathered_by_one_shuffle(spark):
    rows = queries.ledger(spark, SF)
    whole = features.account_features(rows)
    assert shuffles(whole) == 1
    same(by_account(whole), by_account(features.account_features(rows, few=0)))
    same(by_account(whole), by_account(features.account_features(rows, few=150)))  # some are hubs


def test_velocity_is_gathered_by_one_shuffle(spark):
    rows = queries.ledger(spark, SF)
    whole = velocity.velocity_accounts(rows)
    assert shuffles(whole) <= 1  # none where there is one part
    same(by_account(whole), by_account(velocity.velocity_accounts(rows, few=0)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_velocity_of_many_transfers_of_a_second(spark, seed):
    draw = random.Random(seed)
    drawn = [(i, f"T{i}", draw.choice("ABCD"), draw.choice("ABCD"), draw.choice([100, 100, 250, 900]), draw.choice([0, 60, 61, 240, 241, 960, 961, 1_000, 90_000, 90_001])) for i in range(120)]
    rows = spark.createDataFrame(drawn, "row_id long, transaction_id string, sender_account string, receiver_account string, amount_paise long, epoch_s long")
    same(by_account(velocity.velocity_accounts(rows)), by_account(velocity.velocity_accounts(rows, few=0)))


def test_rows_are_numbered_without_a_second_shuffle(spark):
    draw = random.Random(5)
    keys = draw.sample(range(10_000), 3_000)
    numbered = source.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), ["k"])
    assert shuffles(numbered) <= 1  # the counts of ranges
    assert [r["k"] for r in numbered.orderBy("row_id").collect()] == sorted(keys)
    assert sorted(r["row_id"] for r in numbered.collect()) == list(range(3_000))


@pytest.mark.parametrize("few", [0, 100_000])
def test_velocity_without_times_amounts_or_receivers(spark, few):
    """Transfers without a time are in no band, those without a receiver are one sum; accounts' sums need not fit a BIGINT together; gathering needs no window."""
    most = 2**61
    drawn = [("X", "A", most, 0), ("A", "B", most, 200), ("B", "C", 7, 500), ("A", "C", 9, None), ("X", "A", 5, None), ("X", None, 4, 3), ("Y", None, 8, 9), ("C", "D", 3, 900), ("E", "F", None, 0), ("F", "G", 6, 300)]
    rows = spark.createDataFrame([(i, f"T{i}", *r) for i, r in enumerate(drawn)], "row_id long, transaction_id string, sender_account string, receiver_account string, amount_paise long, epoch_s long")
    found = velocity.velocity_accounts(rows, few=few)
    assert (few == 0) == ("Window" in found._jdf.queryExecution().optimizedPlan().toString())
    got = {k: (r["pass_through_event_count"], r["median_incoming_to_outgoing_seconds"], r["pass_through_incoming_volume"], r["pass_through_attributed_volume"]) for k, r in by_account(found).items()}
    assert got == {
        "A": (1, 200.0, (most + 5) / 100, most / 100), "B": (1, 300.0, most / 100, 0.07), "C": (1, 400.0, 0.16, 0.03), "D": (0, None, 0.03, 0.0),
        None: (0, None, 0.12, 0.0), "F": (1, 300.0, None, 0.06), "G": (0, None, 0.06, 0.0),
    }
