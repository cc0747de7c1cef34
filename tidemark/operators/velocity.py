"""Pass-through velocity: how much of what comes in leaves again within minutes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Velocity
from .gather import fresh, gathered, numbers
from .hubs import FEW, apart


def _sides(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    ins = ledger.select(F.col("receiver_account").alias("acc"), F.col("row_id").alias("in_row"), F.col("transaction_id").alias("in_tx"), F.col("epoch_s").alias("in_s"), F.col("amount_paise").alias("in_paise"))
    outs = ledger.select(F.col("sender_account").alias("acc"), F.col("row_id").alias("out_row"), F.col("transaction_id").alias("out_tx"), F.col("epoch_s").alias("out_s"), F.col("amount_paise").alias("out_paise"))
    return ins, outs


def velocity_pairs(ledger: DataFrame, config: Velocity = Velocity()) -> DataFrame:
    """Every inflow and outflow of an account whose delay is within the band, ends included.

    A band join on (account, time bucket): each outflow looks in the buckets that its band touches, so a hub's inflows
    and outflows meet within buckets of the band's width only, and a hub is no single task's work.
    """
    return _in_band(*_sides(ledger), config)


def _in_band(ins: DataFrame, outs: DataFrame, config: Velocity) -> DataFrame:
    width = config.high
    at = ins.withColumn("b", F.floor(F.col("in_s") / width))
    probe = outs.withColumn("b", F.explode(F.sequence(F.floor((F.col("out_s") - config.high) / width), F.floor((F.col("out_s") - config.low) / width))))
    delay = F.col("out_s") - F.col("in_s")
    return at.join(probe, ["acc", "b"]).where(delay.between(config.low, config.high)).withColumn("delay_s", delay).drop("b")


def _outflow_flags(ins: DataFrame, outs: DataFrame, config: Velocity) -> DataFrame:
    """Per account: outflows that follow some inflow too soon, or late but within the horizon; by range frames over its seconds, without pairs."""
    each = ins.select("acc", F.col("in_s").alias("s"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(outs.select("acc", F.col("out_s").alias("s"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    events = each.groupBy("acc", "s").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    by = Window.partitionBy("acc").orderBy("s")
    seen = lambda lo, hi: F.sum("i").over(by.rangeBetween(lo, hi)) > 0
    marked = events.select("acc", "o", seen(-(config.low - 1), 0).alias("soon"), seen(-config.horizon, -(config.high + 1)).alias("late"))
    total = lambda c, name: F.coalesce(F.sum(F.when(F.col(c), F.col("o"))), F.lit(0)).alias(name)
    return marked.where("o > 0").groupBy("acc").agg(total("soon", "under_3_minute_event_count"), total("late", "over_15_minute_event_count"))


def _spread(ins: DataFrame, sent: DataFrame, config: Velocity) -> DataFrame:
    """Figures of accounts of any size: inflows and outflows meet by seconds, in a join on (account, time bucket)."""
    by_second = ins.groupBy("acc", "in_s").agg(F.sum("in_paise").alias("in_paise"), F.count(F.lit(1)).alias("n"))
    met = _in_band(by_second, sent.select("acc", "out_s").distinct(), config)
    band = met.groupBy("acc", "out_s").agg(F.sum("in_paise").alias("in_paise"), F.percentile("delay_s", 0.5, F.col("n")).alias("delay"))
    per_out = sent.join(band, ["acc", "out_s"]).select("acc", "out_paise", "delay", F.least("out_paise", "in_paise").alias("paise"))
    outs = per_out.groupBy("acc").agg(F.sum("paise").alias("attributed"), F.sum("out_paise").alias("rapid"), F.count(F.lit(1)).alias("n"), F.median("delay").alias("delay"))
    total = ins.groupBy("acc").agg(F.sum("in_paise").alias("inflow"))
    return total.join(outs, "acc", "left").join(_outflow_flags(ins, sent, config), "acc", "left")


#: What an account's transfers tell.
_FIGURES = "acc string, inflow long, attributed long, rapid long, n long, delay double, under_3_minute_event_count long, over_15_minute_event_count long"


def _of_accounts(rows: pa.Table, acc: pa.DictionaryArray, config: Velocity) -> pa.RecordBatch:
    """The columns of _spread for whole accounts, from their transfers (s, side, paise) by account and second.

    Inflows lie by account and second, so those of an outflow's band are neighbours. Transfers without a time are in no band.
    """
    begins = fresh(acc)
    group, side, paise = np.cumsum(begins) - 1, numbers(rows, "side"), numbers(rows, "paise")
    known, timed = rows["paise"].is_valid().to_numpy(), rows["s"].is_valid().to_numpy()
    count = int(group[-1]) + 1
    by = lambda at, weights: _sums(group[at], weights[at], count)
    came = side == 0
    inflow, counted = by(came, paise), by(came, known.astype(np.int64))
    i, o = np.flatnonzero(came & timed), np.flatnonzero(~came & timed)
    least = pc.min(rows["s"]).as_py() or 0
    s = numbers(rows, "s", least)
    last = int(s.max())
    place = lambda g, x: g * (last - least + 3) + np.clip(x, least - 1, last + 1) - least + 1
    seconds, gout, sout = place(group[i], s[i]), group[o], s[o]
    until = lambda x, which: np.searchsorted(seconds, place(gout, sout - x), which)
    soon = until(0, "right") > until(config.low - 1, "left")
    late = until(config.high + 1, "right") > until(config.horizon, "left")
    a, b = until(config.high, "left"), until(config.low, "right")
    line, lined = (np.concatenate([[0], np.cumsum(x[i])]) for x in (paise, known))
    hit = np.flatnonzero(b > a)
    a, b, o_hit = a[hit], b[hit], o[hit]
    band, pays = line[b] - line[a], paise[o_hit]
    # the lesser of both, or the one that is known
    paid = np.where(~known[o_hit], band, np.where(lined[b] == lined[a], pays, np.minimum(pays, band)))
    middle = (s[i[(a + b - 1) // 2]] + s[i[(a + b) // 2]]) / 2
    ghit, delay = gout[hit], sout[hit] - middle
    n = np.bincount(ghit, minlength=count)
    ranked = delay[np.lexsort((delay, ghit))]
    start, some = np.cumsum(n) - n, n > 0
    median = np.full(count, np.nan)
    median[some] = (ranked[(start + (n - 1) // 2)[some]] + ranked[(start + n // 2)[some]]) / 2
    figures = [
        acc.dictionary.take(acc.indices.filter(pa.array(begins))), pa.array(inflow, mask=counted == 0), pa.array(_sums(ghit, paid, count)), pa.array(_sums(ghit, pays, count)),
        pa.array(n), pa.array(median, mask=~some), pa.array(np.bincount(gout[soon], minlength=count)), pa.array(np.bincount(gout[late], minlength=count)),
    ]
    has = pa.array(np.bincount(group[came], minlength=count) > 0)
    return pa.RecordBatch.from_arrays(figures, names=[c.split()[0] for c in _FIGURES.split(", ")]).filter(has)


def _sums(group: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of whole numbers by group."""
    out = np.zeros(count, dtype=np.int64)
    np.add.at(out, group, values)
    return out


def _gathered(moves: DataFrame, rows: int, config: Velocity) -> DataFrame:
    """The columns of _spread for accounts with few transfers, each of which is shuffled once. rows: how many transfers there are, of either side."""
    return gathered(moves, rows, ["s"], lambda part, acc: _of_accounts(part, acc, config), _FIGURES)


def velocity_accounts(ledger: DataFrame, config: Velocity = Velocity(), few: int = FEW) -> DataFrame:
    """Velocity figures of every account that has an inflow.

    An outflow is credited with at most its own amount of the inflows in its band; inflows may count for several
    outflows, so the ratio may exceed one. Inflows and outflows meet by seconds, not one by one: what an outflow's band
    holds depends on its second alone. Accounts with more than `few` transfers are spread over tasks.
    """
    side = lambda acc, n: F.struct(F.col(acc).alias("acc"), F.lit(n).alias("side"))
    moves = ledger.select(F.col("epoch_s").alias("s"), F.col("amount_paise").alias("paise"), F.inline(F.array(side("receiver_account", 0), side("sender_account", 1))))
    light, hubs = apart(moves.where("acc IS NOT NULL"), few)
    # transfers without a receiver are one sum
    nobody = ledger.where("receiver_account IS NULL").groupBy(F.col("receiver_account").alias("acc")).agg(F.sum("amount_paise").alias("inflow"))
    joined = _gathered(light, 2 * ledger.count(), config).unionByName(nobody, allowMissingColumns=True)
    if hubs is not None:
        of = lambda n, s: hubs.where(F.col("side") == n).select("acc", F.col("s").alias(f"{s}_s"), F.col("paise").alias(f"{s}_paise"))
        joined = joined.unionByName(_spread(of(0, "in"), of(1, "out"), config))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    exact = zero("attributed") / F.col("inflow")
    return joined.select(
        F.col("acc").alias("account_number"),
        F.when(F.col("inflow") > 0, F.round(exact, 6)).alias("pass_through_ratio"),
        zero("n").alias("pass_through_event_count"),
        F.col("delay").alias("median_incoming_to_outgoing_seconds"),
        zero("n").alias("rapid_outflow_count"),
        (F.col("inflow").cast("long") / F.lit(100)).alias("pass_through_incoming_volume"),
        (zero("attributed") / F.lit(100)).alias("pass_through_attributed_volume"),
        zero("n").alias("pass_through_outgoing_transaction_count"),
        (zero("rapid") / F.lit(100)).alias("pass_through_outgoing_volume"),
        zero("under_3_minute_event_count").alias("under_3_minute_event_count"),
        zero("over_15_minute_event_count").alias("over_15_minute_event_count"),
        F.coalesce((F.col("inflow") > 0) & (exact >= config.ratio) & (F.col("n") >= config.outflows), F.lit(False)).alias("pass_through_candidate"),
    )


def with_velocity(features: DataFrame, velocity: DataFrame) -> DataFrame:
    """features joined with velocity; accounts without inflow are no candidates."""
    return features.join(velocity, "account_number", "left").withColumn("pass_through_candidate", F.coalesce("pass_through_candidate", F.lit(False)))


def velocity_events(ledger: DataFrame, account: str, config: Velocity = Velocity(), limit: int = 100) -> DataFrame:
    """An account's pairs in order, each credited with the lesser amount."""
    own = ledger.where((F.col("sender_account") == account) | (F.col("receiver_account") == account))
    pairs = velocity_pairs(own, config).where(F.col("acc") == account).withColumn("attributed_paise", F.least("in_paise", "out_paise"))
    return pairs.orderBy("out_s", "out_row", "in_s", "in_row").limit(limit)


def velocity_summary(accounts: DataFrame) -> DataFrame:
    return accounts.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if("pass_through_candidate").alias("candidates"),
        F.sum("pass_through_event_count").alias("events"),
        F.sum("under_3_minute_event_count").alias("under_3min"),
        F.sum("over_15_minute_event_count").alias("over_15min"),
        F.max("pass_through_ratio").alias("max_ratio"),
    )
