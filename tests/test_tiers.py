"""What queries write before they have their result."""

import pytest

from tidemark.operators import syndicate
from tidemark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(spark, monkeypatch):
    """The kinds of tiers that a query writes, in a session that has none."""

    def kinds(name):
        kept = {}
        monkeypatch.setattr(queries, "_kept", kept)
        rows = queries.QUERIES[name](spark, SF).collect()
        assert rows
        return {kind for kind, _, _ in kept}

    return kinds


def test_the_detail_of_one_account_writes_its_own_transfers_only(written):
    assert written("account_detail") == {"ledger", f"own-{queries.HUB}"}


def test_policies_are_compared_without_the_dimension(written):
    """Labels are made for the accounts of the account table, which are those of the dimension."""
    assert written("policy_confusion") == {"ledger", "features", "scored", "accounts"}


def test_links_come_from_one_scan(spark):
    """Both kinds of links start from one written table, and no plan after it reads the ledger."""
    rows = [("C1", "D", 1), ("C1", "D", 2), ("D", "T", 3), ("C2", "D", 4), ("D", "X", 5), ("C3", "E", 6), ("F", "T", 7), (None, "D", 8)]
    ledger = spark.createDataFrame(rows, "sender_account string, receiver_account string, row_id long")
    accounts = spark.createDataFrame([(a, a in "DEF", a == "T") for a in ("C1", "C2", "C3", "D", "E", "F", "T", "X")], "account_number string, pass_through_candidate boolean, layer3_candidate boolean")
    first, second = syndicate.links(ledger, accounts)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert key(first, "collector", "distributor") == [("C1", "D"), ("C2", "D"), (None, "D")] and key(second, "distributor", "terminal") == [("D", "T")]
    for found in (first, second):
        assert "row_id" not in (plan := found._jdf.queryExecution().analyzed().toString()) and "LogicalRDD" not in plan
