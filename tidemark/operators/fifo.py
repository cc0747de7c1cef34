"""First-in-first-out attribution of outflows to earlier inflows, in whole paise.

Let I be what came in before an outflow and O what went out up to it. What is attributed up to it is
O + min(0, running min of I - O). Inflows and attributed outflows tile one line of money from zero, so an edge is a
stretch of that line between two neighbouring boundaries: windows find all edges of an account in the order of its
transfers, without joining inflows to outflows.

With a horizon an outflow also skips what has expired. It maps what was consumed before it to
max(lo, min(hi, before + paise)) with bounds lo and hi that windows know. Such clamps compose into clamps, so a block of
transfers is one clamp, blocks are composed in order, and each is replayed from what was consumed before it.

Under a horizon, accounts with few transfers are gathered by one shuffle each, and a task finds the records of its accounts.

An account with very many transfers is cut into blocks, of time for the line and of money for the edges. Windows and
clamps run within blocks, and what a block needs from those before it (sums, the least difference, the composed clamp, the
last inflow and outflow) comes from one row a block. So no task holds a hub, unless most of its transfers are of one second.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.store import materialise
from .gather import fresh, gathered, numbers


def events(ledger: DataFrame) -> DataFrame:
    """Each transfer as an inflow (side 0) and an outflow (side 1); a row's outflow comes first, so it never funds itself."""
    side = lambda acc, cp, n: F.struct(F.col(acc).alias("acc"), F.col(cp).alias("cp"), F.lit(n).alias("side"))
    both = F.array(side("receiver_account", "sender_account", 0), side("sender_account", "receiver_account", 1))
    return ledger.select("row_id", "transaction_id", "epoch_s", F.col("amount_paise").alias("paise"), F.inline(both)).where("acc IS NOT NULL")


#: Accounts with more than this part of all events, and with more than FEW, are cut; there are fewer of them than this number.
HEAVY, FEW = 10_000, 100_000


def _out() -> Column:
    return F.col("side") == 1


def _heavy(e: DataFrame, rows: int, few: int) -> DataFrame | None:
    """(acc, from_s, to_s, width) of the accounts of events `e` to cut, width being the seconds of a block; None if there are none.

    Written once, at most HEAVY rows. rows: how many transfers there are.
    """
    part = max(few, 2 * rows // HEAVY)
    many = materialise(e.groupBy("acc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part), "many")
    if many.isEmpty():
        return None
    per = e.join(F.broadcast(many), "acc").groupBy("acc").agg(F.max("n").alias("n"), F.min("epoch_s").alias("from_s"), F.max("epoch_s").alias("to_s"))
    return materialise(per.select("acc", "from_s", "to_s", F.greatest(F.lit(1), F.ceil((F.col("to_s") - F.col("from_s") + 1) / F.ceil(F.col("n") / part))).alias("width")), "heavy")


def _placed(e: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Events with their block of time, 0 but for heavy accounts, and its width, null but for them."""
    if heavy is None:
        return e.withColumns({"block": F.lit(0), "width": F.lit(None).cast("long"), "to_s": F.lit(None).cast("long")})
    block = F.coalesce(F.floor((F.col("epoch_s") - F.col("from_s")) / F.col("width")), F.lit(0)).cast("int")
    return e.join(F.broadcast(heavy), "acc", "left").withColumn("block", block).drop("from_s")


def _in_block(last: int) -> WindowSpec:
    """A block's rows in the order of time, up to so many after the current one."""
    return Window.partitionBy("acc", "block").orderBy("epoch_s", "row_id", F.col("side").desc()).rowsBetween(Window.unboundedPreceding, last)


def _earlier() -> WindowSpec:
    """An account's blocks before the current one."""
    return Window.partitionBy("acc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _within(placed: DataFrame) -> DataFrame:
    """Sums of either side and the least difference before an outflow, so far within each block."""
    sums = placed.withColumns({f"c{i}": F.sum(F.when(F.col("side") == i, F.col("paise")).otherwise(0)).over(_in_block(0)) for i in (0, 1)})
    return sums.withColumn("low", F.min(F.when(_out(), F.col("c0") - F.col("c1"))).over(_in_block(0)))


def _before_blocks(placed: DataFrame) -> DataFrame:
    """(acc, block, o0, o1, ol, came): of heavy accounts, both sides' sums and the least difference before each block, and all that comes in."""
    ends = _within(placed.where("width IS NOT NULL")).groupBy("acc", "block").agg(F.max("c0").alias("b0"), F.max("c1").alias("b1"), F.min("low").alias("bl"))
    sums = ends.withColumns({f"o{i}": F.coalesce(F.sum(f"b{i}").over(_earlier()), F.lit(0)) for i in (0, 1)})
    least = sums.withColumn("ol", F.min(F.col("bl") + F.col("o0") - F.col("o1")).over(_earlier()))
    return least.select("acc", "block", "o0", "o1", "ol", F.sum("b0").over(Window.partitionBy("acc")).alias("came"))


def _lined(placed: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """placed rows with lo and hi; blocks: what comes before each block of heavy accounts, if there are any."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    sums = _within(placed)
    if blocks is None:
        sums = sums.withColumns({"o0": zero, "o1": zero, "ol": none})
    else:
        sums = sums.join(F.broadcast(blocks.select("acc", "block", "o0", "o1", "ol")), ["acc", "block"], "left").na.fill(0, ["o0", "o1"])
    floor = F.least(F.lit(0), F.col("low") + F.col("o0") - F.col("o1"), F.col("ol"))
    lined = sums.withColumn("c0", F.col("c0") + F.col("o0")).withColumn("hi", F.when(_out(), F.col("c1") + F.col("o1") + floor).otherwise(F.col("c0")))
    before = F.coalesce(F.max(F.when(_out(), F.col("hi"))).over(_in_block(-1)), F.col("o1") + F.least(F.lit(0), F.col("ol")))
    return lined.withColumn("lo", F.when(_out(), before).otherwise(F.col("c0") - F.col("paise"))).withColumnRenamed("c0", "came_in").drop("c1", "low", "o0", "o1", "ol", "block", "width", "to_s")


def _lines(ledger: DataFrame, few: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """All events on their account's line, those of heavy accounts alone, and what comes before the blocks of these; None without any."""
    e = events(ledger)
    heavy = _heavy(e, ledger.count(), few)
    placed = _placed(e, heavy)
    if heavy is None:
        return _lined(placed, None), None, None
    hubs = materialise(placed.where("width IS NOT NULL"), "hubs")
    blocks = materialise(_before_blocks(hubs), "blocks")
    of_hubs = _lined(hubs, blocks)
    return _lined(placed.where("width IS NULL"), None).unionByName(of_hubs), of_hubs, blocks


def money_line(ledger: DataFrame, few: int = FEW) -> DataFrame:
    """events with lo and hi, the stretch of the account's line that an inflow fills or an outflow consumes, and what came in before."""
    return _lines(ledger, few)[0]


def _steps(blocks: DataFrame | None) -> DataFrame | None:
    """(acc, step): the money of a block of heavy accounts, which have as many of them as blocks of time."""
    return None if blocks is None else F.broadcast(blocks.groupBy("acc").agg(F.ceil((F.max("came") + 1) / F.count(F.lit(1))).alias("step")))


#: A row that ends an outflow's stretch; it comes before what begins at the same place.
_END = -1


def _met(lines: DataFrame, of_hubs: DataFrame | None, steps: DataFrame | None) -> DataFrame:
    """(acc, i, o, attributed_paise) for each inflow and outflow whose stretches of the line overlap.

    Rows: side 0 for inflows, 1 for outflows, _END where an outflow's stretch ends and the next does not begin at once.
    """
    what = F.struct(F.when(F.col("side") != _END, F.col("row_id")).alias("row_id"), *[c for c in ("transaction_id", "cp", "epoch_s", "paise") if c in lines.columns])
    order, inward, outward = F.struct("lo", "side", "row_id"), F.col("side") == 0, F.col("side") != 0
    block = F.lit(0) if steps is None else F.coalesce(F.floor(F.col("lo") / F.col("step")), F.lit(0))
    cut = lambda rows: (rows if steps is None else rows.join(steps, "acc", "left")).where("hi > lo").withColumn("block", block)
    at = Window.partitionBy("acc", "block").orderBy("lo", "side", "row_id")
    until = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut(lines).select(
        "acc",
        "block",
        "lo",
        F.last(F.when(inward, what), ignorenulls=True).over(until).alias("i"),
        F.last(F.when(outward, what), ignorenulls=True).over(until).alias("o"),
        F.lead("lo").over(at).alias("next"),
        F.max(F.when(_out(), F.col("hi"))).over(Window.partitionBy("acc", "block")).alias("end"),
    )
    end, then = F.col("end"), F.coalesce("next", "end")
    if of_hubs is not None:
        # the last inflow and outflow before each block, the first boundary after it, and the line's end
        ends = cut(of_hubs).groupBy("acc", "block").agg(
            F.min("lo").alias("first"), F.max_by(what, F.when(inward, order)).alias("li"), F.max_by(what, F.when(outward, order)).alias("lo_"), F.max(F.when(_out(), F.col("hi"))).alias("top")
        )
        around = ends.select(
            "acc", "block", F.last("li", ignorenulls=True).over(_earlier()).alias("pi"), F.last("lo_", ignorenulls=True).over(_earlier()).alias("po"),
            F.lead("first").over(Window.partitionBy("acc").orderBy("block")).alias("after"), F.max("top").over(Window.partitionBy("acc")).alias("whole"),
        )
        joined = joined.join(F.broadcast(around), ["acc", "block"], "left").withColumns({"i": F.coalesce("i", "pi"), "o": F.coalesce("o", "po")})
        end = F.coalesce("whole", "end")
        then = F.coalesce("next", "after", end)
    found = joined.select("acc", "i", "o", (F.least(then, end) - F.col("lo")).alias("attributed_paise"))
    return found.where("attributed_paise > 0 AND i IS NOT NULL AND o.row_id IS NOT NULL")


def fifo_edges(ledger: DataFrame, few: int = FEW) -> DataFrame:
    """One row for each inflow and outflow that share money: ids, attributed paise, delay, and the outflow's second."""
    lines, of_hubs, blocks = _lines(ledger, few)
    return _met(lines, of_hubs, _steps(blocks)).select(
        F.col("acc").alias("account"),
        F.col("i.row_id").alias("source_row_id"), F.col("i.transaction_id").alias("source_transaction_id"), F.col("i.cp").alias("source_account"), F.col("i.paise").alias("source_paise"),
        F.col("o.row_id").alias("destination_row_id"), F.col("o.transaction_id").alias("destination_transaction_id"), F.col("o.cp").alias("destination_account"), F.col("o.paise").alias("destination_paise"),
        F.col("o.epoch_s").alias("destination_epoch_s"), "attributed_paise", (F.col("o.epoch_s") - F.col("i.epoch_s")).alias("delay_s"),
    )


def fifo_unallocated(ledger: DataFrame) -> DataFrame:
    """Outflows that earlier inflows don't cover, with the reason."""
    outs = money_line(ledger).where("side = 1")
    left = F.col("paise") - (F.col("hi") - F.col("lo"))
    return outs.select(
        F.col("acc").alias("account"), F.col("row_id").alias("destination_row_id"), F.col("transaction_id").alias("destination_transaction_id"), F.col("cp").alias("destination_account"),
        F.col("paise").alias("destination_paise"), (F.col("hi") - F.col("lo")).alias("attributed_paise"), left.alias("unallocated_paise"),
        F.when(F.col("came_in") == 0, "NO_PRIOR_INFLOW").otherwise("INFLOW_DEPLETED").alias("reason"),
    ).where("unallocated_paise > 0")


def fifo_totals(ledger: DataFrame) -> DataFrame:
    """In, out, attributed and unallocated paise of each account; attributed and unallocated add up to out."""
    line = money_line(ledger)
    part = lambda n, x: F.coalesce(F.sum(F.when(F.col("side") == n, x)), F.lit(0)).cast("long")
    used = F.col("hi") - F.col("lo")
    return line.groupBy(F.col("acc").alias("account")).agg(
        part(0, F.col("paise")).alias("incoming_paise"), part(1, F.col("paise")).alias("outgoing_paise"), part(1, used).alias("attributed_paise"), part(1, F.col("paise") - used).alias("unallocated_paise"),
        F.count_if(F.col("side") == 0).alias("incoming_count"), F.count_if(F.col("side") == 1).alias("outgoing_count"),
    )


def account_fifo(ledger: DataFrame, account: str) -> DataFrame:
    return fifo_edges(ledger.where((F.col("sender_account") == account) | (F.col("receiver_account") == account))).where(F.col("account") == account)


def transaction_fifo(ledger: DataFrame, transaction_id: str, row_id: int | None = None) -> DataFrame:
    """The edges into one transfer (without row_id: the id's least row) and what they leave; no rows if it does not exist."""
    rows = ledger.where(F.col("transaction_id") == transaction_id)
    row = rows.where(F.col("row_id") == row_id) if row_id is not None else rows.orderBy("row_id").limit(1)
    one = row.select(F.col("sender_account").alias("payer"), F.col("row_id").alias("wanted"), F.col("amount_paise").alias("amount"))
    own = ledger.join(F.broadcast(one.select("payer")), (F.col("sender_account") == F.col("payer")) | (F.col("receiver_account") == F.col("payer")), "left_semi")
    edges = fifo_edges(own).select("account", "source_row_id", "destination_row_id", "attributed_paise", "delay_s")
    joined = F.broadcast(one).join(edges, (F.col("payer") == F.col("account")) & (F.col("wanted") == F.col("destination_row_id")), "left")
    return joined.select("wanted", "source_row_id", "attributed_paise", "delay_s", F.greatest(F.lit(0), F.col("amount") - F.coalesce(F.sum("attributed_paise").over(Window.partitionBy("wanted")), F.lit(0))).alias("remaining_paise")).withColumnRenamed("wanted", "destination_row_id")


#: An inflow's row when it expires; it comes before the transfers of the same second.
_EXPIRY = -1


def _bounds(placed: DataFrame) -> DataFrame:
    """placed rows with the sums and numbers of the inflows before them (have, n_in), and of the expired ones (gone, n_gone), within their block."""
    side = F.col("side")
    until = Window.partitionBy("acc", "block").orderBy("epoch_s", (side != _EXPIRY), "row_id", side.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda kind, x: F.sum(F.when(side == kind, x).otherwise(0)).over(until)
    return placed.withColumns({"have": run(0, F.col("paise")), "n_in": run(0, F.lit(1)), "gone": run(_EXPIRY, F.col("paise")), "n_gone": run(_EXPIRY, F.lit(1))})


Clamps = tuple[np.ndarray, np.ndarray, np.ndarray]


def composed(clamps: Clamps, group: np.ndarray) -> Clamps:
    """For each row the composition of the clamps x -> min(max(x + add, low), high) of its group up to it; rows of a group lie together.

    A parallel prefix: each round composes with what ends one, two, four, ... rows before.
    """
    add, low, high = clamps
    step = 1
    while step < len(add):
        with_ = np.flatnonzero(group[step:] == group[:-step]) + step
        if not len(with_):
            break
        before = with_ - step
        first = (add[before], low[before], high[before])
        a, b, c = add[with_], low[with_], high[with_]
        add, low, high = add.copy(), low.copy(), high.copy()
        add[with_] = first[0] + a
        low[with_], high[with_] = np.clip(first[1] + a, b, c), np.clip(first[2] + a, b, c)
        step *= 2
    return add, low, high


def _as_clamp(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for a block's outflows: their clamps composed."""
    f = frame.sort_values(["epoch_s", "row_id"])
    columns = tuple(f[c].to_numpy(dtype=np.int64) for c in ("paise", "low", "high"))
    add, low, high = (x[-1] for x in composed(columns, np.zeros(len(f), dtype=np.int64)))
    return pd.DataFrame({"acc": [f["acc"].iloc[0]], "block": [f["block"].iloc[0]], "add": [add], "low": [low], "high": [high]})


def _done_before(frame: pd.DataFrame) -> pd.DataFrame:
    """What an account has consumed before each of its blocks."""
    f = frame.sort_values("block")
    add, low, high = composed(tuple(f[c].to_numpy(dtype=np.int64) for c in ("add", "low", "high")), np.zeros(len(f), dtype=np.int64))
    done = np.clip(add, low, high)
    return pd.DataFrame({"acc": f["acc"], "block": f["block"], "done0": np.concatenate([[0], done[:-1]])})


def _replayed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outflows, sorted by account, block and time, with lo and hi, the stretch of the line that each consumes.

    Only the last account, block and consumed sum are carried from batch to batch.
    """
    last, carried = None, 0
    for b in batches:
        if not len(b):
            continue
        get = lambda c, b=b: b.column(b.schema.get_field_index(c))
        acc, block = get("acc").dictionary_encode(), get("block").to_numpy()
        code = acc.indices.to_numpy()
        fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])
        group = np.cumsum(fresh)
        start = get("done0").to_numpy().copy()
        key = lambda i: (acc.dictionary[int(code[i])].as_py(), int(block[i]))  # noqa: B023, E731
        if key(0) == last:
            start[group == 1] = carried
        add, low, high = composed(tuple(get(c).to_numpy() for c in ("paise", "low", "high")), group)
        hi = np.clip(start + add, low, high)
        before = np.where(fresh, start, np.concatenate([[0], hi[:-1]]))
        last, carried = key(-1), int(hi[-1])
        names = [n for n in b.schema.names if n not in ("low", "high", "done0")]
        yield pa.RecordBatch.from_arrays([get(n) for n in names] + [pa.array(np.maximum(before, get("gone").to_numpy())), pa.array(hi)], names=[*names, "lo", "hi"])


def _consumed(bounds: DataFrame, hubs: bool) -> DataFrame:
    """The outflows of rows with bounds, with lo and hi."""
    outs = bounds.where(_out()).withColumns({"high": F.col("have"), "low": F.least(F.col("gone") + F.col("paise"), F.col("have"))})
    if hubs:
        # one clamp a block, and these in order: at most 2 * HEAVY rows
        each = outs.where("width IS NOT NULL").select("acc", "block", "epoch_s", "row_id", "paise", "low", "high")
        clamps = materialise(each.groupBy("acc", "block").applyInPandas(_as_clamp, "acc string, block int, add long, low long, high long"), "clamps")
        before = clamps.groupBy("acc").applyInPandas(_done_before, "acc string, block int, done0 long")
        outs = outs.join(F.broadcast(before), ["acc", "block"], "left").na.fill(0, ["done0"])
    else:
        outs = outs.withColumn("done0", F.lit(0).cast("long"))
    sorted_ = outs.drop("have", "width", "to_s").repartition("acc", "block").sortWithinPartitions("acc", "block", "epoch_s", "row_id")
    schema = ", ".join(f"{c} {t}" for c, t in sorted_.dtypes if c not in ("low", "high", "done0")) + ", lo long, hi long"
    return sorted_.mapInArrow(_replayed, schema)


def horizon_lines(e: DataFrame, rows: int, horizon_s: int, few: int = FEW, heavy: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Inflows and outflows of events `e` with lo and hi under a horizon, those of heavy accounts, and (acc, step), the money of their blocks.

    heavy: the accounts to cut, where they are known.
    """
    heavy = _heavy(e, rows, few) if heavy is None else heavy
    expiry = e.where("side = 0").withColumns({"epoch_s": F.col("epoch_s") + horizon_s + 1, "side": F.lit(_EXPIRY)})
    placed = _placed(e.unionByName(expiry), heavy).where("side >= 0 OR to_s IS NULL OR epoch_s <= to_s")
    sums, steps = ("have", "n_in", "gone", "n_gone"), None
    bounds = _bounds(placed)
    if heavy is not None:
        bounds = materialise(bounds, "bounds")
        ends = bounds.where("width IS NOT NULL").groupBy("acc", "block").agg(*[F.max(c).alias(c) for c in sums])
        offsets = materialise(ends.select("acc", "block", *[F.coalesce(F.sum(c).over(_earlier()), F.lit(0)).alias(f"o_{c}") for c in sums], F.sum("have").over(Window.partitionBy("acc")).alias("came")), "offsets")
        bounds = bounds.join(F.broadcast(offsets.drop("came")), ["acc", "block"], "left").na.fill(0, [f"o_{c}" for c in sums])
        bounds = bounds.withColumns({c: F.col(c) + F.col(f"o_{c}") for c in sums}).drop(*[f"o_{c}" for c in sums])
        steps = _steps(offsets)
    outs = materialise(_consumed(bounds, heavy is not None), "consumed")
    keep = [c for c in ("acc", "row_id", "transaction_id", "cp", "epoch_s", "paise", "side", "n_in", "n_gone", "lo", "hi") if c in outs.columns]
    ins = bounds.where("side = 0").withColumns({"lo": F.col("have") - F.col("paise"), "hi": F.col("have")})
    lines = ins.select(*keep).unionByName(outs.select(*keep))
    return lines, lines.join(F.broadcast(heavy.select("acc")), "acc", "left_semi") if heavy is not None else None, steps


def _with_ends(lines: DataFrame) -> DataFrame:
    return lines.unionByName(lines.where("side = 1 AND hi > lo").withColumns({"side": F.lit(_END), "lo": F.col("hi"), "hi": F.col("hi") + 1}))


def attributed(e: DataFrame, horizon_s: int | None) -> DataFrame:
    """(acc, i, o, attributed_paise) for the inflows and outflows of events `e` that share money; for a few accounts with few events, which are not cut."""
    if horizon_s is None:
        return _met(_lined(_placed(e, None), None), None, None)
    return _met(_with_ends(horizon_lines(e, 0, horizon_s, 1 << 62)[0]), None, None)


#: What horizon_records returns.
_RECORD = "account string, source_row_id long, destination_row_id long, attributed_paise long, delay_s long, unallocated_paise long, reason string"


def _of_accounts(rows: pa.Table, acc: pa.DictionaryArray, horizon_s: int) -> pa.RecordBatch:
    """The records of whole accounts, from their events in the order of acc, second, row, outflow first.

    The accounts' lines of money lie one behind the other on one line, which is as long as all that comes in. Transfers
    without a time come first and fund nothing.
    """
    code = acc.indices.to_numpy()
    side, row, paise = numbers(rows, "side"), numbers(rows, "row_id"), numbers(rows, "paise")
    least = pc.min(rows["epoch_s"]).as_py() or 0
    at = numbers(rows, "epoch_s", least - 1)
    group = np.cumsum(fresh(acc)) - 1
    i, o = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    gin, gout = group[i], group[o]
    # ends of the inflows' stretches; how many inflows come before an account, before an outflow, and are gone for it
    line = np.concatenate([[0], np.cumsum(paise[i])])
    first = np.searchsorted(gin, gout)
    n_in = np.cumsum(side == 0)[o]
    span = int(at.max()) - least + 2
    n_gone = np.minimum(np.searchsorted(gin * span + (at[i] - least + 1), gout * span + (np.maximum(at[o] - horizon_s, least) - least + 1)), n_in)
    base, pays = line[first], paise[o]
    have, gone = line[n_in] - base, line[n_gone] - base
    hi = np.clip(*composed((pays, np.minimum(gone + pays, have), have), gout))
    before = np.concatenate([[0], np.where(gout[1:] == gout[:-1], hi[:-1], 0)])[: len(o)]
    lo = np.maximum(before, gone)
    # from the inflow in which an outflow's stretch begins to the one in which it ends
    start, end = lo + base, hi + base
    a, b = np.searchsorted(line[1:], start, "right"), np.searchsorted(line[1:], end, "left")
    n = np.where(end > start, b - a + 1, 0)
    by = np.repeat(np.arange(len(o)), n)
    of = a[by] + np.arange(len(by)) - (np.cumsum(n) - n)[by]
    paid = np.minimum(line[of + 1], end[by]) - np.maximum(line[of], start[by])
    of, by, paid = of[paid > 0], by[paid > 0], paid[paid > 0]
    left = pays - (hi - lo)
    bare = np.flatnonzero(left > 0)
    why = np.where(n_in == first, "NO_PRIOR_INFLOW", np.where(n_gone == n_in, "HORIZON_EXCEEDED", "INFLOW_DEPLETED"))[bare]
    names = acc.dictionary.take(pa.array(code[o[np.concatenate([by, bare])]]))
    edges, rest = len(by), len(bare)
    both = lambda x, y: pa.concat_arrays([pa.nulls(edges, y.type) if x is None else x, pa.nulls(rest, x.type) if y is None else y])
    columns = [
        names, both(pa.array(row[i[of]]), None), pa.array(row[o[np.concatenate([by, bare])]]), both(pa.array(paid), None),
        both(pa.array(at[o[by]] - at[i[of]]), None), both(None, pa.array(left[bare])), both(None, pa.array(why, pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RECORD.split(", ")])


def _gathered(e: DataFrame, rows: int, horizon_s: int) -> DataFrame:
    """The records of accounts with few events, each of which is shuffled once. rows: how many events there are."""
    return gathered(e, rows, ["epoch_s", "row_id", F.col("side").desc()], lambda part, acc: _of_accounts(part, acc, horizon_s), _RECORD)


def horizon_records(ledger: DataFrame, horizon_s: int, few: int = FEW) -> DataFrame:
    """Edges under a horizon, and rows without a source for outflows left uncovered, with the reason.

    An inflow is gone for outflows more than horizon_s seconds later. Accounts with few events are gathered, the others are
    cut into blocks, so no task holds a hub: see the module's head.
    """
    e, count = events(ledger).drop("cp", "transaction_id"), ledger.count()
    heavy = _heavy(e, count, few)
    if heavy is None:
        return _gathered(e, 2 * count, horizon_s)
    one = F.broadcast(heavy.select("acc"))
    return _gathered(e.join(one, "acc", "left_anti"), 2 * count, horizon_s).unionByName(_in_blocks(e.join(one, "acc", "left_semi"), count, horizon_s, few, heavy))


def _in_blocks(e: DataFrame, rows: int, horizon_s: int, few: int, heavy: DataFrame) -> DataFrame:
    """The records of heavy accounts, from their events."""
    lines, of_hubs, steps = horizon_lines(e, rows, horizon_s, few, heavy)
    met = _met(_with_ends(lines), None if of_hubs is None else _with_ends(of_hubs), steps)
    none = F.lit(None).cast("long")
    edges = met.select(
        F.col("acc").alias("account"), F.col("i.row_id").alias("source_row_id"), F.col("o.row_id").alias("destination_row_id"), "attributed_paise", (F.col("o.epoch_s") - F.col("i.epoch_s")).alias("delay_s"), none.alias("unallocated_paise"), F.lit(None).cast("string").alias("reason"),
    )
    left = F.col("paise") - (F.col("hi") - F.col("lo"))
    why = F.when(F.col("n_in") == 0, "NO_PRIOR_INFLOW").when(F.col("n_gone") == F.col("n_in"), "HORIZON_EXCEEDED").otherwise("INFLOW_DEPLETED")
    bare = lines.where("side = 1").where(left > 0).select(F.col("acc").alias("account"), none.alias("source_row_id"), F.col("row_id").alias("destination_row_id"), none.alias("attributed_paise"), none.alias("delay_s"), left.alias("unallocated_paise"), why.alias("reason"))
    return edges.unionByName(bare)
