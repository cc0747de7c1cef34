"""Chains of collector, pass-through distributor and terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialise


def links(ledger: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collector, distributor) and (distributor, terminal) links of distributors that have both; written once, from one scan of the ledger."""
    through = accounts.where("pass_through_candidate").select(F.col("account_number").alias("distributor"))
    ends = accounts.where("layer3_candidate").select(F.col("account_number").alias("other"))
    side = lambda acc, cp, onward: F.struct(F.col(acc).alias("distributor"), F.col(cp).alias("other"), F.lit(onward).alias("onward"))
    both = ledger.select(F.inline(F.array(side("receiver_account", "sender_account", False), side("sender_account", "receiver_account", True))))
    near = both.join(through, "distributor", "left_semi").distinct()
    met = materialise(near.join(ends.withColumn("ends", F.lit(True)), "other", "left").where("NOT onward OR ends").select("distributor", "other", "onward"), "links")
    whole = met.groupBy("distributor").agg(F.min("onward").alias("from"), F.max("onward").alias("to")).where("NOT from AND to").select("distributor")
    of = lambda onward, name: met.where(F.col("onward") == onward).join(whole, "distributor", "left_semi").select("distributor", F.col("other").alias(name))
    return of(False, "collector"), of(True, "terminal")


def syndicate_nodes(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every account on a chain, with its stage or MULTI_STAGE. Chains themselves, in × out of each distributor, are never listed."""
    first, second = links(ledger, accounts)
    staged = [
        first.select(F.col("collector").alias("account_number"), F.lit("STAGE_1_COLLECTOR").alias("stage")),
        first.select("distributor", F.lit("STAGE_2_DISTRIBUTOR")),
        second.select("terminal", F.lit("STAGE_3_TERMINAL")),
    ]
    every = staged[0].union(staged[1]).union(staged[2])
    stage = F.when(F.min("stage") != F.max("stage"), "MULTI_STAGE").otherwise(F.max("stage"))
    return every.groupBy("account_number").agg(stage.alias("syndicate_stage"))


def chain_metrics(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct collectors, distributors and terminals, and the number of chains, as the sum of products of degrees."""
    first, second = links(ledger, accounts)
    paths = first.groupBy("distributor").agg(F.count(F.lit(1)).alias("a")).join(second.groupBy("distributor").agg(F.count(F.lit(1)).alias("b")), "distributor")
    return (
        paths.agg(F.count(F.lit(1)).alias("distributors"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias("chains"))
        .crossJoin(first.agg(F.countDistinct("collector").alias("collectors")))
        .crossJoin(second.agg(F.countDistinct("terminal").alias("terminals")))
        .select("collectors", "distributors", "terminals", "chains")
    )


#: What evidence says of every account on a chain.
POLICY, LINEAGE = "Forensic_Syndicate_Subgraph", "Victim/Source -> Collector -> Pass-Through Distributor -> Terminal Cash-Out"


def evidence() -> Column:
    """The evidence of an account's stage as JSON, an empty object where it is on no chain."""
    fields = F.struct(F.col("syndicate_stage").alias("stage"), F.lit(True).alias("in_connected_chain"), F.lit(POLICY).alias("policy"), F.lit(LINEAGE).alias("lineage"))
    return F.when(F.col("syndicate_stage").isNotNull(), F.to_json(fields)).otherwise("{}")


def with_syndicate(accounts: DataFrame, nodes: DataFrame) -> DataFrame:
    """accounts with syndicate_stage, predicted_mule_candidate and syndicate_evidence."""
    marked = accounts.join(nodes, "account_number", "left")
    return marked.withColumns({"predicted_mule_candidate": F.col("syndicate_stage").isNotNull(), "syndicate_evidence": evidence()})
