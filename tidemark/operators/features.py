"""The account dimension and the behavioural feature store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import START, entity_view
from .hubs import FEW, apart
from .quantiles import exact_quantiles

DAY, HOUR = 86_400, 3_600


def rupees(paise: Column) -> Column:
    return paise.cast("long") / F.lit(100)


def _when(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def _hours() -> Column:
    """The hour of the day as one bit of 24."""
    return F.expr(f"shiftleft(1, cast(floor(epoch_s / {HOUR}) % 24 AS int))")


def by_value(e: DataFrame, **kinds: Column) -> DataFrame:
    """(acc, kind, n, is_in, is_out, hours): a row for each account, kind and different value, how many transfers have it, on which sides, and in which hours of the day.

    An account's values are counted by (account, kind, value) before they are counted by account, with partial sums in both
    steps, so no task and no row holds all that a hub has. Nulls are no value.
    """
    each = F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("string").alias("value")) for k, x in kinds.items()])
    rows = e.select("acc", "is_in", "is_out", _hours().alias("hours"), F.inline(each)).where(F.col("value").isNotNull())
    return rows.groupBy("acc", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("is_in").alias("is_in"), F.max("is_out").alias("is_out"), F.bit_or("hours").alias("hours")).drop("value")


def _values(kind: str, side: str | None = None) -> Column:
    """How many different values of a kind an account has, of all its rows or those of one side."""
    return F.count_if((F.col("kind") == kind) & (F.col(side) == 1) if side else F.col("kind") == kind)


def _at(epoch: Column, start: str) -> Column:
    return F.timestamp_add("SECOND", epoch, F.lit(start).cast("timestamp_ntz"))


def accounts_dimension(ledger: DataFrame, start: str = START) -> DataFrame:
    """Eighteen columns by account; a transfer to oneself counts on both sides."""
    e, inward, outward = entity_view(ledger), F.col("is_in") == 1, F.col("is_out") == 1
    total = lambda c: F.sum(F.when(c, F.col("amount_paise")).otherwise(0))
    values = by_value(e, cp=F.col("cp"), ifsc=F.col("ifsc"), ip=F.col("ip_address"), device=F.col("device_type"), mode=F.col("payment_mode"))
    different = values.groupBy("acc").agg(
        _values("cp", "is_in").alias("unique_senders"),
        _values("cp", "is_out").alias("unique_receivers"),
        _values("cp").alias("counterparty_count"),
        _values("ifsc", "is_out").alias("sender_ifsc_count"),
        _values("ifsc", "is_in").alias("receiver_ifsc_count"),
        _values("ip").alias("unique_ip_count"),
        _values("device").alias("unique_device_count"),
        _values("mode").alias("unique_payment_mode_count"),
    )
    sums = e.groupBy("acc").agg(
        rupees(total(inward)).alias("total_inflow"),
        rupees(total(outward)).alias("total_outflow"),
        rupees(total(inward) - total(outward)).alias("net_flow_delta"),
        F.sum("is_in").cast("long").alias("incoming_txn_count"),
        F.sum("is_out").cast("long").alias("outgoing_txn_count"),
        F.count(F.lit(1)).alias("transaction_count"),
        _at(F.min("epoch_s"), start).alias("first_seen_timestamp"),
        _at(F.max("epoch_s"), start).alias("last_seen_timestamp"),
    )
    return sums.join(different, "acc").select(
        F.col("acc").alias("account_number"), "total_inflow", "total_outflow", "net_flow_delta", "incoming_txn_count", "outgoing_txn_count", "transaction_count",
        "unique_senders", "unique_receivers", "counterparty_count", "first_seen_timestamp", "last_seen_timestamp", "sender_ifsc_count", "receiver_ifsc_count",
        "unique_ip_count", "unique_device_count", "unique_payment_mode_count", F.lit("DERIVED").alias("provenance"),
    )


#: Devices and payment modes with a counter of their own.
DEVICES = {"android": "Android", "ios": "iOS", "windows_browser": "Windows_Browser", "web_emulator": "Web_Emulator", "linux_script": "Linux_Script"}
MODES = {"upi": "UPI", "imps": "IMPS", "neft": "NEFT", "rtgs": "RTGS"}


def _stats(side: str, flag: Column) -> list[Column]:
    """Statistics of one side's amounts, from whole paise; null where the side is empty."""
    x = F.when(flag, F.col("amount_paise"))
    shaped = {"min": F.min(x), "max": F.max(x), "mean": F.avg(x), "stddev": F.stddev_pop(x)}
    return [(F.round(v) / F.lit(100)).alias(f"{side}_amount_{k}") for k, v in shaped.items()]


def _medians(e: DataFrame) -> DataFrame:
    """(acc, incoming_amount_median, outgoing_amount_median), found by ranks: a hub's amounts are in no one's buffer."""
    per = exact_quantiles(e, ["acc", "is_in"], "amount_paise", {"median": 0.5})
    of = lambda side: F.round(F.max(F.when(F.col("is_in") == side, F.col("median")))) / F.lit(100)
    return per.groupBy("acc").agg(of(1).alias("incoming_amount_median"), of(0).alias("outgoing_amount_median"))


def _sums() -> list[Column]:
    """What sums, extremes and bits of an account's rows say."""
    inward, outward = F.col("is_in") == 1, F.col("is_out") == 1
    paise, hour = F.col("amount_paise"), F.floor(F.col("epoch_s") / HOUR) % 24
    vol_in, vol_out = F.sum(F.when(inward, paise).otherwise(0)), F.sum(F.when(outward, paise).otherwise(0))
    blank = F.col("narration").isNull() | (F.trim("narration") == "")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("is_in").cast("long").alias("incoming_txn_count"),
        F.sum("is_out").cast("long").alias("outgoing_txn_count"),
        rupees(vol_in).alias("incoming_volume"),
        rupees(vol_out).alias("outgoing_volume"),
        rupees(vol_in - vol_out).alias("net_flow_delta"),
        F.min("epoch_s").alias("first_s"),
        F.max("epoch_s").alias("last_s"),
        _when(hour.between(0, 5)).alias("night_transaction_count"),
        _when(blank).alias("empty_narration_count"),
        *[_when(F.col("device_type") == v).alias(f"{k}_txn_count") for k, v in DEVICES.items()],
        *[_when(F.col("payment_mode") == v).alias(f"{k}_txn_count") for k, v in MODES.items()],
        *_stats("incoming", inward),
        *_stats("outgoing", outward),
        F.bit_count(F.bit_or(_hours())).cast("long").alias("unique_active_hours"),
    ]


def _spread(e: DataFrame) -> DataFrame:
    """Sums, counts of different values and medians of accounts of any size.

    Counts of different values, and the busiest address, come from an aggregation that counts by value first; medians from
    amounts counted by value.
    """
    values = by_value(e, cp=F.col("cp"), day=F.floor(F.col("epoch_s") / DAY), device=F.col("device_type"), ip=F.col("ip_address"), narration=F.col("narration"))
    different = values.groupBy("acc").agg(
        _values("cp", "is_in").alias("fan_in"),
        _values("cp", "is_out").alias("fan_out"),
        _values("cp").alias("unique_counterparties"),
        _values("day").alias("active_day_count"),
        F.coalesce(F.sum(F.when(F.col("kind") == "day", F.bit_count("hours"))), F.lit(0)).cast("long").alias("active_hour_count"),
        _values("device").alias("unique_device_count"),
        _values("ip").alias("unique_ip_count"),
        _values("narration").alias("unique_narration_count"),
        F.max(F.when(F.col("kind") == "ip", F.col("n"))).alias("top_ip_transaction_count"),
    )
    return e.groupBy("acc").agg(*_sums()).join(different, "acc").join(_medians(e), "acc", "left")


def _longest_run(values: Column) -> Column:
    """How often the most frequent value of a sorted array is in it; null for an empty one."""
    run = lambda s, x: F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1).cast("long"))
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))
    step = lambda s, x: F.struct(x.alias("last"), run(s, x).alias("run"), F.greatest(s["best"], run(s, x)).alias("best"))
    return F.aggregate(values, zero, step, lambda s: F.nullif(s["best"], F.lit(0).cast("long")))


def _middle(paise: str) -> Column:
    """The median of a sorted array of paise, in rupees; null for an empty one."""
    return F.round(F.expr(f"(get({paise}, (size({paise}) - 1) div 2) + get({paise}, size({paise}) div 2)) / 2")) / F.lit(100)


def _deviation(paise: str) -> Column:
    """The standard deviation of an array of paise around its known mean, in rupees; the rows' order has no influence on halves of a paisa."""
    square = lambda x: (x - F.col(f"{paise}_mean")) * (x - F.col(f"{paise}_mean"))
    total = F.aggregate(paise, F.lit(0.0), lambda s, x: s + square(x))
    return F.when(F.size(paise) > 0, F.round(F.sqrt(total / F.size(paise))) / F.lit(100))


def _gathered(e: DataFrame) -> DataFrame:
    """The columns of _spread for accounts with few rows: each row is shuffled once, and a row's group holds its account's values."""
    each = e.where("acc IS NOT NULL").select("acc", "cp", "is_in", "is_out", "amount_paise", "epoch_s", "payment_mode", "device_type", "ip_address", "narration").repartition("acc")
    of = lambda side, c: F.when(F.col(side) == 1, F.col(c))
    lists = each.groupBy("acc").agg(
        *_sums(),
        F.collect_set(of("is_in", "cp")).alias("senders"),
        F.collect_set(of("is_out", "cp")).alias("receivers"),
        F.collect_set(F.floor(F.col("epoch_s") / HOUR)).alias("each_hour"),
        F.collect_set("device_type").alias("devices"),
        F.sort_array(F.collect_list("ip_address")).alias("ips"),
        F.collect_set("narration").alias("narrations"),
        F.sort_array(F.collect_list(of("is_in", "amount_paise"))).alias("came"),
        F.sort_array(F.collect_list(of("is_out", "amount_paise"))).alias("went"),
        F.avg(of("is_in", "amount_paise")).alias("came_mean"),
        F.avg(of("is_out", "amount_paise")).alias("went_mean"),
    )
    size = lambda x: F.size(x).cast("long")
    counts = {
        "fan_in": size("senders"),
        "fan_out": size("receivers"),
        "unique_counterparties": size(F.array_union("senders", "receivers")),
        "active_day_count": size(F.array_distinct(F.transform("each_hour", lambda h: F.floor(h * HOUR / DAY)))),
        "active_hour_count": size("each_hour"),
        "unique_device_count": size("devices"),
        "unique_ip_count": size(F.array_distinct("ips")),
        "unique_narration_count": size("narrations"),
        "top_ip_transaction_count": _longest_run(F.col("ips")),
        "incoming_amount_median": _middle("came"),
        "outgoing_amount_median": _middle("went"),
        "incoming_amount_stddev": _deviation("came"),
        "outgoing_amount_stddev": _deviation("went"),
    }
    return lists.withColumns(counts).drop("senders", "receivers", "each_hour", "devices", "ips", "narrations", "came", "went", "came_mean", "went_mean")


def account_features(ledger: DataFrame, start: str = START, few: int = FEW) -> DataFrame:
    """The feature store: one row by account.

    Accounts with at most `few` rows are gathered by one shuffle; what others have is spread over tasks.
    """
    light, hubs = apart(entity_view(ledger), few)
    found = _gathered(light)
    if hubs is not None:
        found = found.unionByName(_spread(hubs))
    n = F.col("n")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    share = lambda c: F.round(F.col(c) / n, 4)
    return found.select(
        F.col("acc").alias("account_number"),
        n.alias("transaction_count"),
        "incoming_txn_count", "outgoing_txn_count", "incoming_volume", "outgoing_volume", "net_flow_delta",
        "fan_in", "fan_out", "unique_counterparties",
        ratio(F.col("outgoing_volume"), F.col("incoming_volume")).alias("outflow_to_inflow_ratio"),
        ratio(F.col("incoming_volume"), F.col("outgoing_volume")).alias("inflow_to_outflow_ratio"),
        _at(F.col("first_s"), start).alias("first_seen_timestamp"),
        _at(F.col("last_s"), start).alias("last_seen_timestamp"),
        (F.col("last_s") - F.col("first_s")).alias("activity_span_seconds"),
        "active_day_count", "active_hour_count",
        F.round(n / F.col("active_day_count"), 2).alias("transactions_per_active_day"),
        *[f"{s}_amount_{k}" for s in ("incoming", "outgoing") for k in ("min", "max", "mean", "median", "stddev")],
        "unique_device_count", *[f"{k}_txn_count" for k in DEVICES],
        share("web_emulator_txn_count").alias("web_emulator_ratio"), share("linux_script_txn_count").alias("linux_script_ratio"),
        "unique_ip_count", F.round(n / F.col("unique_ip_count"), 2).alias("transactions_per_unique_ip"),
        "top_ip_transaction_count", share("top_ip_transaction_count").alias("top_ip_transaction_ratio"),
        *[f"{k}_txn_count" for k in MODES], *[share(f"{k}_txn_count").alias(f"{k}_ratio") for k in MODES],
        "unique_narration_count", "empty_narration_count",
        F.round((n - F.col("unique_narration_count")) / n, 4).alias("narration_repeat_ratio"),
        F.col("active_day_count").alias("unique_active_dates"), "unique_active_hours",
        "night_transaction_count", share("night_transaction_count").alias("night_transaction_ratio"),
        F.lit("v1").alias("feature_version"), F.lit("DERIVED").alias("provenance"),
    )
