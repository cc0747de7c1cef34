"""Role candidates: collectors, distributors and terminals, with the signals that made them."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Roles

_INT = lambda c: c.cast("int")


def reason(when: Column, code: str, value: Column, threshold: object, text: Column | str, **more) -> Column:
    """A reason struct where `when` holds, else null; null flags count as false."""
    fields = [F.lit(code).alias("code"), value.cast("string").alias("observed_value"), F.lit(str(threshold)).alias("threshold"), (F.lit(text) if isinstance(text, str) else text).alias("description")]
    return F.when(when, F.struct(*fields, *[v.alias(k) for k, v in more.items()]))


def present(reasons: list[Column]) -> Column:
    return F.filter(F.array(*reasons), lambda x: x.isNotNull())


def decimal(c: Column, scale: int) -> Column:
    """A double as decimal text. Halves of the scaled double go away from zero, as SQL casts them: 0.145 is 14.499999999999998 hundredths, so 0.14."""
    return (F.round(c * F.lit(10.0**scale)).cast("decimal(22,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(20,{scale})").cast("string")


def money(c: Column | str) -> Column:
    """A volume as plain decimal text; doubles print differently from engine to engine."""
    return decimal(F.col(c) if isinstance(c, str) else c, 2)


def classify_roles(features: DataFrame, config: Roles = Roles()) -> DataFrame:
    """features with layer{1,2,3}_candidate (never null), _signal_count and _reasons; one pass, no shuffle."""
    c, d, t = config.collector, config.distributor, config.terminal
    f = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("fan_in", "fan_out", "incoming_txn_count", "outgoing_txn_count", "incoming_volume", "outgoing_volume", "net_flow_delta", "web_emulator_txn_count", "linux_script_txn_count", "top_ip_transaction_ratio")}
    one = lambda k: F.coalesce(F.col(k), F.lit(1.0))
    l1 = [f["fan_in"] >= c.fan, f["incoming_txn_count"] >= c.count, f["incoming_volume"] >= c.volume, (f["net_flow_delta"] > 0) | (f["fan_in"] > f["fan_out"]) | (one("inflow_to_outflow_ratio") >= c.ratio)]
    l2 = [f["fan_out"] >= d.fan, f["outgoing_txn_count"] >= d.count, f["outgoing_volume"] >= d.volume, (f["net_flow_delta"] < 0) | (f["fan_out"] > f["fan_in"]) | (one("outflow_to_inflow_ratio") >= d.ratio)]
    auto = f["web_emulator_txn_count"] + f["linux_script_txn_count"]
    sink = (f["incoming_volume"] >= t.sink_volume) & (f["incoming_txn_count"] >= t.sink_count) & (f["outgoing_txn_count"] <= t.sink_out)
    drain = (auto > 0) & (f["outgoing_volume"] >= t.drain_volume) & (f["outgoing_txn_count"] >= t.drain_count) & ((f["outgoing_volume"] >= f["incoming_volume"]) | (f["outgoing_txn_count"] >= f["incoming_txn_count"]))
    ip = (f["top_ip_transaction_ratio"] >= t.ip_ratio) & (f["incoming_volume"] >= t.ip_volume) & (f["outgoing_txn_count"] <= t.ip_out)
    is1, is2, is3 = l1[0] & l1[1] & l1[2], l2[0] & l2[1] & l2[2], sink | drain | ip
    count = lambda xs: reduce(add, map(_INT, xs))
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    r1 = [
        reason(l1[0], "HIGH_FAN_IN", f["fan_in"], c.fan, text(f["fan_in"], " senders paid into the account.")),
        reason(l1[1], "HIGH_INBOUND_TRANSACTION_COUNT", f["incoming_txn_count"], c.count, text(f["incoming_txn_count"], " transfers came in.")),
        reason(l1[2], "HIGH_INBOUND_VOLUME", money("incoming_volume"), c.volume, text("Inbound volume is ", money("incoming_volume"), ".")),
        reason(l1[3], "INBOUND_FLOW_DOMINANCE", decimal(one("inflow_to_outflow_ratio"), 2), c.ratio, "More money or senders come in than go out."),
    ]
    r2 = [
        reason(l2[0], "HIGH_FAN_OUT", f["fan_out"], d.fan, text(f["fan_out"], " receivers were paid by the account.")),
        reason(l2[1], "HIGH_OUTBOUND_TRANSACTION_COUNT", f["outgoing_txn_count"], d.count, text(f["outgoing_txn_count"], " transfers went out.")),
        reason(l2[2], "HIGH_OUTBOUND_VOLUME", money("outgoing_volume"), d.volume, text("Outbound volume is ", money("outgoing_volume"), ".")),
        reason(l2[3], "OUTBOUND_FLOW_DOMINANCE", decimal(one("outflow_to_inflow_ratio"), 2), d.ratio, "More money or receivers go out than come in."),
    ]
    held = text("The account keeps ", money("incoming_volume"), " from ", f["incoming_txn_count"], " transfers.")
    r3 = [
        reason(sink, "TERMINAL_FLOW_SINK", money("incoming_volume"), t.sink_volume, held),
        reason(sink, "ZERO_OUTBOUND_DISBURSEMENT", F.lit("0"), t.sink_out, "Nothing went out."),
        reason(drain, "AUTOMATION_DEVICE_ACTIVITY", auto, 1, text(auto, " transfers came from automated devices.")),
        reason(drain, "HIGH_OUTBOUND_DISBURSEMENT", money("outgoing_volume"), t.drain_volume, text("Automated outbound volume is ", money("outgoing_volume"), ".")),
        reason(drain, "OUTBOUND_FLOW_DOMINANCE", decimal(one("outflow_to_inflow_ratio"), 2), 1.0, "At least as much goes out as comes in."),
        reason(ip, "HIGH_IP_CONCENTRATION", decimal(f["top_ip_transaction_ratio"] * 100, 1), round(t.ip_ratio * 100, 1), "One address has a large share of the transfers."),
        reason(ip & ~sink, "TERMINAL_FLOW_SINK", money("incoming_volume"), t.ip_volume, held),
    ]
    out = {}
    for i, (is_it, reasons, signals) in enumerate([(is1, r1, count(l1)), (is2, r2, count(l2)), (is3, r3, 2 * _INT(sink) + 3 * _INT(drain) + 2 * _INT(ip & ~sink))], 1):
        out[f"layer{i}_candidate"] = F.coalesce(is_it, F.lit(False))
        out[f"layer{i}_signal_count"] = F.when(is_it, signals).otherwise(0)
        out[f"layer{i}_reasons"] = F.filter(F.when(is_it, present(reasons)), lambda x: x.isNotNull())
    done = features.withColumns(out)
    empty = {f"layer{i}_reasons": F.coalesce(F.col(f"layer{i}_reasons"), F.array().cast(done.schema[f"layer{i}_reasons"].dataType)) for i in (1, 2, 3)}
    return done.withColumns(empty)


def role_label() -> Column:
    """MIXED where more than one role holds."""
    n = reduce(add, [_INT(F.col(f"layer{i}_candidate")) for i in (1, 2, 3)])
    return F.when(n > 1, "MIXED").when(F.col("layer1_candidate"), "L1_COLLECTOR").when(F.col("layer2_candidate"), "L2_DISTRIBUTOR").when(F.col("layer3_candidate"), "L3_TERMINAL").otherwise("NONE")


def investigation_label() -> Column:
    """One role by precedence: terminal, distributor, collector."""
    return F.when(F.col("layer3_candidate"), "L3_TERMINAL").when(F.col("layer2_candidate"), "L2_DISTRIBUTOR").when(F.col("layer1_candidate"), "L1_COLLECTOR").otherwise("NONE")


def overlaps(roles: DataFrame) -> DataFrame:
    """One row of counts: each role, each pair, all three, any."""
    a, b, c = (F.col(f"layer{i}_candidate") for i in (1, 2, 3))
    named = {"layer1": a, "layer2": b, "layer3": c, "layer1_layer2": a & b, "layer1_layer3": a & c, "layer2_layer3": b & c, "all_three": a & b & c, "any_role": a | b | c}
    return roles.agg(*[F.count_if(v).alias(k) for k, v in named.items()])
