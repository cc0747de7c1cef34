"""The two-axis risk index: behaviour and structure, with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .roles import money, present, reason


def ladder(*steps: tuple[Column, float], other: float = 0.0) -> Column:
    """The first step that holds gives the points."""
    out = None
    for cond, points in steps:
        out = F.when(cond, float(points)) if out is None else out.when(cond, float(points))
    return out.otherwise(float(other))


def climb(x: Column, *steps: tuple[float, float], other: float = 0.0) -> Column:
    return ladder(*[(x >= at, points) for at, points in steps], other=other)


#: The families of the index's breakdown, and the columns that hold their points.
FAMILIES = {
    "VELOCITY": "b_vel", "AUTOMATION": "b_auto", "FLOW_PARITY": "b_parity", "BURST_TEMPORAL": "b_burst", "DEGREE": "s_degree", "INTERMEDIARY": "s_intermediary", "VOLUME_SCALE": "s_volume", "ROLE_EVIDENCE": "s_role",
    "BEHAVIORAL_TOTAL": "behavioral_risk_index", "STRUCTURAL_TOTAL": "structural_risk_index", "COMPOSITE_TOTAL": "mule_risk_index",
}


def score_risk(features: DataFrame) -> DataFrame:
    """features (with roles and velocity) plus the parts, both indices, the composite, its band, signal, families and reasons.

    Nulls count as zero. All is one projection; reasons come after the scores, to keep generated code small.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    i = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    ratio, events, outs = zero("pass_through_ratio"), zero("pass_through_event_count"), zero("pass_through_outgoing_transaction_count")
    tx_in, tx_out, vol_in, vol_out = zero("incoming_txn_count"), zero("outgoing_txn_count"), zero("incoming_volume"), zero("outgoing_volume")
    total, auto = tx_in + tx_out, zero("web_emulator_txn_count") + zero("linux_script_txn_count")
    top_ip, night, burst = zero("top_ip_transaction_ratio"), zero("night_transaction_count"), zero("transactions_per_active_day")
    fan_in, fan_out = zero("fan_in"), zero("fan_out")
    most, least = F.greatest(fan_in, fan_out), F.least(fan_in, fan_out)
    of = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    moved = (events >= 1) & (outs >= 2)
    parity = of(F.least(vol_in, vol_out), F.greatest(vol_in, vol_out))
    both = (vol_in > 0) & (vol_out > 0)
    parts = {
        "b_vel": F.when(moved, climb(ratio, (0.90, 40), (0.70, 30), (0.40, 20), (0.20, 10), other=5)).when((events >= 1) & (outs == 1), climb(ratio, (0.80, 15), (0.40, 8))).otherwise(0.0),
        "b_auto": F.least(F.lit(30.0), ladder(((auto >= 2) | (of(auto, total) >= 0.5), 22), (auto >= 1, 12)) + ladder(((total >= 5) & (top_ip >= 0.90), 8), ((total >= 3) & (top_ip >= 0.75), 4))),
        "b_parity": F.when(both, climb(parity, (0.85, 20), (0.65, 14), (0.45, 8))).when((tx_out == 0) & (vol_in >= 150_000), 14.0).otherwise(0.0),
        "b_burst": F.least(F.lit(10.0), climb(burst, (10, 5), (5, 3)) + ladder(((total >= 5) & (of(night, total) >= 0.30), 5), (night >= 2, 2))),
        "s_degree": climb(most, (100, 35), (95, 25), (75, 15), (50, 8), (20, 4)),
        "s_intermediary": ladder((least >= 95, 25), ((most >= 50) & (least <= 5), 20), (least >= 50, 12), ((most >= 20) & (least <= 3), 10), (least >= 20, 6)),
        "s_volume": climb(vol_in + vol_out, (1_000_000, 20), (500_000, 14), (250_000, 8), (100_000, 4)),
        "s_role": F.least(F.lit(20.0), (i("layer1_candidate") + i("layer2_candidate") + i("layer3_candidate")) * F.lit(10.0)),
    }
    scored = features.withColumns(parts)
    sums = {"behavioral_risk_index": ("b_vel", "b_auto", "b_parity", "b_burst"), "structural_risk_index": ("s_degree", "s_intermediary", "s_volume", "s_role")}
    scored = scored.withColumns({k: F.round(F.least(F.lit(100.0), sum((F.col(c) for c in v[1:]), F.col(v[0]))), 1) for k, v in sums.items()})
    b, s = F.col("behavioral_risk_index"), F.col("structural_risk_index")
    scored = scored.withColumn("mule_risk_index", F.round(F.least(F.lit(100.0), b * 0.5 + s * 0.5 + F.when((b >= 50) & (s >= 50), 10.0).otherwise(0.0)), 1))
    x = F.col("mule_risk_index")
    p = {k: F.col(k) for k in parts}
    family = lambda name, c: {"family": F.lit(name), "points": c}
    step = lambda c, hi, lo: (c >= hi, (c >= lo) & (c < hi))
    pct, sides = (ratio * 100).cast("decimal(12,1)"), F.concat(fan_in.cast("string"), F.lit(" in, "), fan_out.cast("string"), F.lit(" out"))
    v_hi, v_lo = step(p["b_vel"], 30, 10)
    a_hi, a_lo = step(p["b_auto"], 18, 10)
    d_hi, d_lo = step(p["s_degree"], 25, 8)
    m_hi, m_lo = step(p["s_intermediary"], 20, 10)
    w_hi, w_lo = step(p["s_volume"], 14, 4)
    balanced = (p["b_parity"] >= 14) & both
    reasons = [
        reason(v_hi, "CRITICAL_PASS_THROUGH_VELOCITY", pct, 70.0, "Most of what came in left within minutes.", **family("VELOCITY", p["b_vel"])),
        reason(v_lo, "ELEVATED_PASS_THROUGH_VELOCITY", pct, 20.0, "Part of what came in left within minutes.", **family("VELOCITY", p["b_vel"])),
        reason(a_hi, "HEAVY_AUTOMATED_DEVICE_USAGE", auto, 2, "Transfers came from automated devices.", **family("AUTOMATION", p["b_auto"])),
        reason(a_lo, "AUTOMATED_DEVICE_DETECTED", auto, 1, "A transfer came from an automated device.", **family("AUTOMATION", p["b_auto"])),
        reason(balanced, "BALANCED_TRANSIT_FLOW", parity.cast("decimal(10,2)"), 0.65, "About as much goes out as comes in.", **family("FLOW_STRUCTURE", p["b_parity"])),
        reason((p["b_parity"] >= 14) & ~both & (tx_out == 0), "TERMINAL_ACCUMULATION_SINK", money(vol_in), 150000, "Money comes in and stays.", **family("FLOW_STRUCTURE", p["b_parity"])),
        reason(p["b_burst"] >= 5, "HIGH_BURST_FREQUENCY", burst.cast("decimal(12,1)"), 5.0, "Many transfers on each active day.", **family("TRANSACTION_BEHAVIOR", p["b_burst"])),
        reason(d_hi, "EXTREME_COUNTERPARTY_DEGREE", most, 95, "Very many counterparties.", **family("NETWORK_STRUCTURE", p["s_degree"])),
        reason(d_lo, "ELEVATED_COUNTERPARTY_DEGREE", most, 50, "Many counterparties.", **family("NETWORK_STRUCTURE", p["s_degree"])),
        reason(m_hi, "INTERMEDIARY_CONDUIT_TOPOLOGY", sides, "50:50", "Money passes through in both directions.", **family("NETWORK_STRUCTURE", p["s_intermediary"])),
        reason(m_lo, "ASYMMETRIC_FLOW_DISPERSAL", sides, "20:3", "Counterparties are mostly on one side.", **family("NETWORK_STRUCTURE", p["s_intermediary"])),
        reason(w_hi, "HIGH_MONETARY_THROUGHPUT", money(vol_in + vol_out), 500000, "Large total volume.", **family("FLOW_STRUCTURE", p["s_volume"])),
        reason(w_lo, "ELEVATED_MONETARY_VOLUME", money(vol_in + vol_out), 100000, "Raised total volume.", **family("FLOW_STRUCTURE", p["s_volume"])),
        *[reason(F.col(f"layer{n}_candidate"), code, F.lit("True"), "True", "Role candidate.", **family("ROLE_SUPPORT", F.lit(10.0))) for n, code in ((1, "LAYER1_COLLECTOR_ROLE_CANDIDATE"), (2, "LAYER2_DISTRIBUTOR_ROLE_CANDIDATE"), (3, "LAYER3_TERMINAL_ROLE_CANDIDATE"))],
    ]
    return scored.withColumns(
        {
            "risk_band": F.when(x >= 75, "VERY_HIGH").when(x >= 50, "HIGH").when(x >= 25, "MODERATE").otherwise("LOW"),
            "evidence_signal": F.when((b >= 50) & (s >= 50), "MULTI-MODAL EVIDENCE").when(s >= 50, "ELEVATED STRUCTURAL INDICATORS").when(b >= 50, "ELEVATED BEHAVIORAL INDICATORS").when((b + s) / 2 >= 35, "REVIEW REQUIRED").otherwise("LOW CURRENT INDICATOR"),
            "risk_family_scores": F.map_from_arrays(F.array(*[F.lit(k) for k in FAMILIES]), F.array(*[F.col(c) for c in FAMILIES.values()])),
            "risk_reasons": present(reasons),
        }
    )
