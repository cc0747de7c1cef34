"""Small ledgers with known attribution."""

import pytest

from tidemark.config import Trace
from tidemark.operators import fifo, graph, velocity

SCHEMA = "row_id long, transaction_id string, sender_account string, receiver_account string, epoch_s long, amount_paise long"


@pytest.fixture
def ledger(spark):
    def make(*rows):
        return spark.createDataFrame([(i, f"T{i}", *r) for i, r in enumerate(rows)], SCHEMA)

    return make


def edges(df, account):
    rows = fifo.fifo_edges(df).where(f"account = '{account}'").orderBy("destination_row_id", "source_row_id").collect()
    return [(r["source_row_id"], r["destination_row_id"], r["attributed_paise"], r["delay_s"]) for r in rows]


def test_one_inflow_funds_one_outflow(ledger):
    assert edges(ledger(("X", "A", 0, 1000), ("A", "Y", 300, 700)), "A") == [(0, 1, 700, 300)]


def test_partial_consumption(ledger):
    df = ledger(("X", "A", 0, 1000), ("X", "A", 10, 500), ("A", "Y", 20, 700), ("A", "Z", 30, 600))
    assert edges(df, "A") == [(0, 2, 700, 20), (0, 3, 300, 30), (1, 3, 300, 20)]


@pytest.mark.parametrize(("rows", "reason", "left"), [([("A", "Y", 5, 5000)], "NO_PRIOR_INFLOW", 5000), ([("X", "A", 0, 1000), ("A", "Y", 5, 1500)], "INFLOW_DEPLETED", 500)])
def test_uncovered(ledger, rows, reason, left):
    found = fifo.fifo_unallocated(ledger(*rows)).where("account = 'A'").collect()
    assert [(r["reason"], r["unallocated_paise"]) for r in found] == [(reason, left)]


@pytest.mark.parametrize(("horizon", "expected"), [(500, (None, "HORIZON_EXCEEDED")), (2000, (0, None))])
def test_horizon(ledger, horizon, expected):
    found = fifo.horizon_records(ledger(("X", "A", 0, 1000), ("A", "Y", 1000, 400)), horizon).where("account = 'A'").collect()
    assert [(r["source_row_id"], r["reason"]) for r in found] == [expected]


def test_same_second_follows_row_order(ledger):
    assert edges(ledger(("X", "A", 0, 800), ("A", "Y", 0, 800)), "A") == [(0, 1, 800, 0)]
    assert edges(ledger(("A", "Y", 0, 800), ("X", "A", 0, 800)), "A") == []


def test_totals_conserve(ledger):
    df = ledger(("X", "A", 0, 5000), ("A", "B", 1, 4000), ("B", "C", 2, 3500), ("C", "D", 3, 2000))
    for r in fifo.fifo_totals(df).collect():
        assert r["attributed_paise"] + r["unallocated_paise"] == r["outgoing_paise"]


def test_trace_over_hops_and_cycle(ledger):
    rows = graph.attribution_trace(ledger(("A", "B", 0, 1000), ("B", "C", 1, 900), ("C", "B", 2, 800)), "A", config=Trace(hops=4)).orderBy("hop").collect()
    assert [(r["hop"], r["account"], r["destination_account"], r["attributed_paise"], r["cycle"]) for r in rows] == [(1, "A", "B", 1000, False), (2, "B", "C", 900, False), (3, "C", "B", 800, True)]


@pytest.mark.parametrize(("delay", "inside"), [(179, 0), (180, 1), (900, 1), (901, 0)])
def test_velocity_band(ledger, delay, inside):
    assert velocity.velocity_pairs(ledger(("X", "A", 0, 100), ("A", "Y", delay, 100))).count() == inside


def test_empty(ledger, spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fifo.fifo_edges(none).count() == 0 and velocity.velocity_accounts(none).count() == 0


def test_accounts_cut_into_blocks_have_the_same_edges(spark):
    """A hub with over a third of all transfers, in blocks of a few rows, beside a plain queue."""
    import random

    draw = random.Random(5)
    names = ["HUB", *[f"A{i}" for i in range(6)]]
    rows = []
    for i in range(400):
        a, b = (draw.choice(names) if draw.random() < 0.5 else "HUB", draw.choice(names[1:]))
        rows.append((i, f"T{i}", *((a, b) if draw.random() < 0.5 else (b, a)), draw.randrange(150) * (1 + i % 3), draw.randrange(1, 500)))
    df = spark.createDataFrame(rows, SCHEMA)
    plain = []
    for acc in names:
        queue = []
        for row, _, s, r, at, paise in sorted(rows, key=lambda x: (x[4], x[0])):
            if s == acc:
                need = paise
                while need and queue:
                    take = min(need, queue[0][1])
                    plain.append((acc, queue[0][0], row, take))
                    need -= take
                    queue[0][1] -= take
                    if not queue[0][1]:
                        queue.pop(0)
            if r == acc:
                queue.append([row, paise])
    for few in (7, 40, 100_000):
        got = sorted((r["account"], r["source_row_id"], r["destination_row_id"], r["attributed_paise"]) for r in fifo.fifo_edges(df, few).collect())
        assert got == sorted(plain), few
    lines = [sorted(map(tuple, fifo.money_line(df, few).select("acc", "row_id", "side", "lo", "hi", "came_in").collect())) for few in (7, 100_000)]
    assert lines[0] == lines[1]


def hub_ledger(spark, seed, n=300):
    """Transfers of few accounts, over a third of them a hub's, many in the same seconds."""
    import random

    draw = random.Random(seed)
    names = ["HUB", *[f"A{i}" for i in range(6)]]
    rows = []
    for i in range(n):
        a, b = (draw.choice(names) if draw.random() < 0.5 else "HUB", draw.choice(names))
        rows.append((i, f"T{i}", *((a, b) if draw.random() < 0.5 else (b, a)), draw.randrange(150) * (1 + i % 3), draw.randrange(0, 500)))
    return rows, spark.createDataFrame(rows, SCHEMA), names


def plain_horizon(rows, names, horizon):
    """Inflows as a queue from which each outflow takes what is no older than the horizon."""
    out = []
    for acc in names:
        queue, came = [], 0
        for row, _, s, r, at, paise in sorted(rows, key=lambda x: (x[4], x[0])):
            if s == acc:
                while queue and queue[0][2] < at - horizon:
                    queue.pop(0)
                need = paise
                while need and queue:
                    take = min(need, queue[0][1])
                    if take:
                        out.append((acc, queue[0][0], row, take, at - queue[0][2], None, None))
                    need -= take
                    queue[0][1] -= take
                    if not queue[0][1]:
                        queue.pop(0)
                if need:
                    young = [t for t in inflows(rows, acc, row, at) if t >= at - horizon]
                    why = "NO_PRIOR_INFLOW" if not came else "INFLOW_DEPLETED" if young else "HORIZON_EXCEEDED"
                    out.append((acc, None, row, None, None, need, why))
            if r == acc:
                queue.append([row, paise, at])
                came += 1
    return out


def inflows(rows, acc, row, at):
    """Seconds of an account's inflows before a transfer."""
    return [x[4] for x in rows if x[3] == acc and (x[4], x[0]) < (at, row)]


@pytest.mark.parametrize(("horizon", "few"), [(0, 7), (20, 7), (60, 40), (150, 7), (60, 100_000), (10_000, 7)])
def test_a_horizon_in_blocks_is_that_of_a_queue(spark, horizon, few):
    rows, df, names = hub_ledger(spark, horizon + few)
    key = lambda r: tuple((x is None, x or 0) for x in r[:6]) + (r[6] or "",)
    got = sorted(map(tuple, fifo.horizon_records(df, horizon, few).collect()), key=key)
    assert got == sorted(plain_horizon(rows, names, horizon), key=key)


def test_no_account_is_one_group_under_a_horizon(spark):
    """A hub's blocks become clamps of their own, and no clamp holds most of its outflows."""
    rows, df, _ = hub_ledger(spark, 3)
    lines, of_hubs, steps = fifo.horizon_lines(fifo.events(df), len(rows), 60, 7)
    assert of_hubs is not None and steps.count() == of_hubs.select("acc").distinct().count() > 0
    heavy = fifo._heavy(fifo.events(df), len(rows), 7)
    blocks = fifo._placed(fifo.events(df), heavy).where("width IS NOT NULL").groupBy("acc", "block").count()
    assert blocks.where("acc = 'HUB'").count() > 10


def test_clamps_compose_in_any_blocks():
    import numpy as np

    draw = np.random.default_rng(1)
    add, low, high = (draw.integers(0, 50, 400) for _ in range(3))
    high = low + high
    group = np.sort(draw.integers(0, 9, 400))
    a, b, c = fifo.composed((add, low, high), group)
    for x in (0, 17, 900):
        for g in range(9):
            at, value = np.flatnonzero(group == g), x
            for i in at:
                value = min(max(value + add[i], low[i]), high[i])
                assert value == min(max(x + a[i], b[i]), c[i])


def test_one_account_and_a_horizon_over_batches(spark):
    """Small Arrow batches carry what was consumed from one to the next."""
    rows, df, names = hub_ledger(spark, 9)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = fifo.horizon_records(df, 60).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sum(r["attributed_paise"] or 0 for r in got) == sum(r[3] or 0 for r in plain_horizon(rows, names, 60))
    own = fifo.account_fifo(df, "HUB")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, fifo.fifo_edges(df).where("account = 'HUB'").collect()))


def test_a_horizon_shuffles_each_event_once(spark):
    """Accounts with few events need one shuffle and no written table; only ids, seconds and money are moved."""
    rows, df, names = hub_ledger(spark, 4)
    found = fifo.horizon_records(df, 60)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "parquet" not in plan and "transaction_id" not in plan.split("Repartition")[0]
    assert len(found.collect()) == len(plain_horizon(rows, names, 60))


def test_accounts_whose_sums_do_not_fit_together(spark):
    """Each account's money fits a BIGINT, that of two does not; transfers without a time fund nothing."""
    most = 2**60
    rows = [(i, f"T{i}", *r) for i, r in enumerate([("X", "A", 5, most), ("A", "B", 6, most - 3), ("B", "C", 9, most), ("C", "D", None, 7), ("A", "E", 30, 9), ("X", "F", None, 5), ("F", "G", 3, 4)])]
    got = {tuple(r)[:4] + (r["unallocated_paise"], r["reason"]) for r in fifo.horizon_records(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    none = "NO_PRIOR_INFLOW"
    assert got == {
        ("X", None, 0, None, most, none), ("A", 0, 1, most - 3, None, None), ("B", 1, 2, most - 3, None, None), ("B", None, 2, None, 3, "INFLOW_DEPLETED"),
        ("C", None, 3, None, 7, none), ("A", None, 4, None, 9, "HORIZON_EXCEEDED"), ("X", None, 5, None, 5, none), ("F", None, 6, None, 4, "HORIZON_EXCEEDED"),
    }


@pytest.mark.parametrize("few", [7, 100_000])
def test_row_ids_of_any_size_do_not_mix_up_seconds(spark, few):
    """Transfers go by second first: ids above ten million, in another order than time, only order those of one second."""
    rows, _, names = hub_ledger(spark, 11)
    rows = [(i * 7919 % 300 * 1_000_003, *r[1:]) for i, r in enumerate(rows)]
    key = lambda r: tuple((x is None, x or 0) for x in r[:6]) + (r[6] or "",)
    got = sorted(map(tuple, fifo.horizon_records(spark.createDataFrame(rows, SCHEMA), 60, few).collect()), key=key)
    assert got == sorted(plain_horizon(rows, names, 60), key=key) and all(r[4] is None or r[4] >= 0 for r in got)
