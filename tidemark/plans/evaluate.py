"""Detector evaluation: policies over account features against labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each policy's name and its test on the finished account table.
POLICIES = {
    "L1_candidate": "layer1_candidate",
    "L2_candidate": "layer2_candidate",
    "L3_candidate": "layer3_candidate",
    "Any_Mule_Role": "layer1_candidate OR layer2_candidate OR layer3_candidate",
    **{f"Risk_GE_{x}": f"mule_risk_index >= {x}" for x in (35, 40, 45, 50, 55, 60, 70, 85)},
    "Behavioral_AND_Role": "behavioral_risk_index >= 50 AND (layer1_candidate OR layer2_candidate OR layer3_candidate)",
    "PassThrough": "pass_through_candidate",
    "Forensic_Syndicate_Subgraph": "predicted_mule_candidate",
}
#: Words for labels.
POSITIVE = ("MULE", "1", "TRUE", "YES", "POSITIVE", "MULE_ACCOUNT", "MULE ACCOUNT")
NEGATIVE = ("REGULAR", "0", "FALSE", "NO", "NEGATIVE", "NORMAL", "NON_MULE", "NON-MULE")


def read_labels(raw: DataFrame) -> DataFrame:
    """(account_number, label, known) from a table with account_number, account_id or account, and label."""
    name = next((c for c in ("account_number", "account_id", "account") if c in raw.columns), None)
    if name is None or "label" not in raw.columns:
        raise ValueError("labels need an account column and a label column")
    word = F.upper(F.trim(F.col("label").cast("string")))
    label = F.when(word.isin(*POSITIVE), True).when(word.isin(*NEGATIVE), False)
    return raw.select(F.trim(F.col(name)).alias("account_number"), label.alias("label"), label.isNotNull().alias("known"))


def label_audit(labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row: labelled accounts, those repeated, unrecognised labels, labelled accounts that are missing, unlabelled ones."""
    once = labels.groupBy("account_number").agg(F.count(F.lit(1)).alias("n"))
    missing = once.join(accounts.select("account_number"), "account_number", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    without = accounts.join(once, "account_number", "left_anti").agg(F.count(F.lit(1)).alias("unlabelled"))
    sums = once.agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("n") > 1).alias("repeated"))
    return sums.crossJoin(labels.agg(F.count_if(~F.col("known")).alias("unrecognised"))).crossJoin(missing).crossJoin(without)


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 4)


def confusion(labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """Counts and rates of each policy over the labelled accounts; an account without data is predicted negative.

    All policies are counted in one pass; of repeated labels the first in order (negative first) counts.
    """
    truth = labels.where("known").groupBy("account_number").agg(F.min("label").alias("label"))
    tests = accounts.select("account_number", *[F.expr(sql).alias(name) for name, sql in POLICIES.items()])
    joined = truth.join(tests, "account_number", "left").na.fill(False, list(POLICIES))
    y = F.col("label")
    rows = joined.select("label", F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("hit")) for n in POLICIES])))
    hit = F.col("hit")
    counts = rows.groupBy("policy").agg(F.count_if(hit & y).alias("tp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select("policy", "tp", "tn", "fp", "fn", (tp + tn + fp + fn).alias("total"), _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"), _rate(2 * tp, 2 * tp + fp + fn).alias("f1"), _rate(tn, tn + fp).alias("specificity"), _rate(fp, fp + tn).alias("fpr"))


def policy_counts(accounts: DataFrame) -> DataFrame:
    counted = accounts.agg(*[F.count_if(F.expr(sql)).alias(n) for n, sql in POLICIES.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("accounts")) for n in POLICIES])))


def definitions(spark: SparkSession) -> DataFrame:
    """(policy, definition): each policy's test."""
    return spark.createDataFrame(list(POLICIES.items()), "policy string, definition string")


def report(accounts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A row for each policy, to be written as a report: its definition and predictions, and with labels its counts and rates.

    With labels: predicted, tp, tn, fp, fn, total, precision, recall, f1, specificity, fpr over the labelled accounts, and the
    cohort's integrity: labelled, repeated, unrecognised, missing and unlabelled accounts. Without: predicted, population,
    positive_rate over all accounts, and a status that says that labels are awaited.
    """
    named = F.broadcast(definitions(accounts.sparkSession))
    if labels is None:
        counted = policy_counts(accounts).crossJoin(F.broadcast(accounts.agg(F.count(F.lit(1)).alias("population"))))
        return counted.join(named, "policy").select("policy", "definition", F.col("accounts").alias("predicted"), "population", _rate(F.col("accounts"), F.col("population")).alias("positive_rate"), F.lit("AWAITING_GROUND_TRUTH").alias("status"))
    rows = confusion(labels, accounts).join(named, "policy").crossJoin(F.broadcast(label_audit(labels, accounts)))
    return rows.select("policy", "definition", (F.col("tp") + F.col("fp")).alias("predicted"), *[c for c in rows.columns if c not in ("policy", "definition")])


def latency_stats(ms: list[float]) -> dict:
    x = sorted(ms)
    return {"min": x[0], "median": (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2, "mean": sum(x) / len(x), "p95": x[-1] if len(x) < 5 else x[min(len(x) - 1, int(0.95 * len(x)))], "max": x[-1]}


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
