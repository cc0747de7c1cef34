"""Networks around an account: neighbourhoods, structural paths, and attribution over several hops.

Each hop is one join of the frontier with the ledger; hops are a loop on the driver over at most six joins. Where node,
branch and edge caps bound frontiers and results, the frontier is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Trace
from ..sources.store import materialise
from . import fifo


def edge_id() -> Column:
    """sender_receiver_transaction_epoch_row, unique by its row."""
    return F.concat_ws("_", "sender_account", "receiver_account", "transaction_id", F.col("epoch_s").cast("string"), F.col("row_id").cast("string"))


def _kept(df: DataFrame) -> DataFrame:
    """Rows of a bounded result, kept as a local table to cut the lineage of a hop."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def neighbourhood(ledger: DataFrame, account: str, hops: int = 1, max_nodes: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """nodes(account, hop) and edges(edge_id, row_id, source, target, amount_paise, epoch_s) within `hops` undirected steps.

    At most max_nodes nodes, nearest first and then by account. Edges join kept nodes only and touch a node nearer than
    the last hop. Without max_nodes all are kept: hops are distributed joins, each written to the shared folder.
    """
    spark = ledger.sparkSession
    small = F.broadcast if max_nodes is not None else (lambda df: df)
    nodes = spark.createDataFrame([(account, 0)], "account string, hop int")
    ends = F.array(F.struct(F.col("sender_account").alias("a"), F.col("receiver_account").alias("b")), F.struct(F.col("receiver_account").alias("a"), F.col("sender_account").alias("b")))
    sides = ledger.select(F.inline(ends))
    for hop in range(1, hops + 1):
        front = nodes.where(F.col("hop") == hop - 1).select(F.col("account").alias("a"))
        reached = sides.join(small(front), "a", "left_semi").select(F.col("b").alias("account")).where("account IS NOT NULL").distinct()
        fresh = reached.join(small(nodes), "account", "left_anti").withColumn("hop", F.lit(hop))
        if max_nodes is None:
            nodes = materialise(nodes.unionByName(fresh), "neighbourhood")
        else:
            nodes = _kept(nodes.unionByName(fresh.orderBy("account").limit(max_nodes)).orderBy("hop", "account").limit(max_nodes))
    inner = nodes.where(F.col("hop") < hops).select("account")
    near = lambda c: small(nodes.select(F.col("account").alias(c)))
    touching = ledger.join(near("sender_account"), "sender_account", "left_semi").join(near("receiver_account"), "receiver_account", "left_semi")
    own = small(inner)
    flagged = touching.join(own.select(F.col("account").alias("sender_account"), F.lit(True).alias("f")), "sender_account", "left").join(own.select(F.col("account").alias("receiver_account"), F.lit(True).alias("g")), "receiver_account", "left")
    edges = flagged.where("f OR g").select(edge_id().alias("edge_id"), "row_id", F.col("sender_account").alias("source"), F.col("receiver_account").alias("target"), "amount_paise", "epoch_s")
    return nodes, edges


@dataclass(frozen=True)
class Structure:
    """nodes(account, hop), edges(edge_id, row_id, source, target, transaction_id, amount_paise, epoch_s, hop), paths(path, rank), and whether a cap cut something."""

    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    truncated: bool


def structural_trace(ledger: DataFrame, account: str, hops: int = 4, max_nodes: int = 1000, keep: int = 100) -> Structure:
    """The network that money could flow through: simple paths of outflows from an account, of at most `hops` steps.

    A hop offers the 3 * max_nodes largest outflows of the accounts where paths end, by amount and row. Candidates (a path and
    an outflow to an account not on it) come in the order of their paths, then of the outflows; the first max_nodes accounts
    in that order are the nodes, and nothing after the candidate that fills them counts. Parallel transfers are edges of
    their own; a path is its accounts. The `keep` longest paths are returned, ranked by length and order of discovery: those
    of full length, those whose last account pays nothing on, and, where the trace is cut, those that could not go on.

    Paths are tables, joined with a broadcast list of at most 3 * max_nodes outflows, and written after each hop.
    """
    spark, most = ledger.sparkSession, 3 * max_nodes
    out = ledger.select("row_id", "transaction_id", "sender_account", "receiver_account", "amount_paise", "epoch_s").where("sender_account IS NOT NULL AND receiver_account IS NOT NULL")
    paths = spark.createDataFrame([([account], [])], "path array<string>, place array<int>")
    nodes, edges, found, truncated = {account: 0}, None, [], False
    for hop in range(1, hops + 1):
        front = paths.select(F.element_at("path", -1).alias("sender_account")).distinct()
        largest = out.join(F.broadcast(front), "sender_account", "left_semi").orderBy(F.desc("amount_paise"), "row_id").limit(most)
        steps = _kept(largest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("amount_paise"), "row_id"))))  # at most 3 * max_nodes rows
        paying = F.broadcast(steps.select("sender_account").distinct())
        ended = F.element_at("path", -1) == F.col("sender_account")
        found.append(paths.join(paying, ended, "left_anti").where(F.size("path") > 1).select("path", "place"))
        candidates = paths.join(F.broadcast(steps), ended).where(~F.array_contains("path", F.col("receiver_account")))
        candidates = materialise(candidates.withColumn("order", F.concat("place", F.array("n"))), "candidates")
        known = F.broadcast(spark.createDataFrame([(n,) for n in nodes], "receiver_account string"))
        fresh = candidates.join(known, "receiver_account", "left_anti").groupBy("receiver_account").agg(F.min("order").alias("order"))
        room = max_nodes - len(nodes)
        named = [(r["receiver_account"], list(r["order"])) for r in fresh.orderBy("order", "receiver_account").limit(max(0, room)).collect()]
        nodes |= {n: hop for n, _ in named}
        kept = candidates
        if len(nodes) >= max_nodes:
            last = F.lit(named[-1][1]).cast("array<int>") if named else F.array().cast("array<int>")
            kept = candidates.where(F.col("order") <= last)
            truncated = not candidates.where(F.col("order") > last).isEmpty()
        made = kept.select("row_id", "transaction_id", "sender_account", "receiver_account", "amount_paise", "epoch_s").distinct().withColumn("hop", F.lit(hop))
        edges = made if edges is None else edges.unionByName(made.join(F.broadcast(edges.select("row_id")), "row_id", "left_anti"))
        longer = kept.groupBy(F.concat("path", F.array("receiver_account")).alias("path")).agg(F.min("order").alias("place"))
        if truncated:
            found += [paths.where(F.size("path") > 1).select("path", "place")] + ([longer] if hop == hops else [])
            break
        paths = materialise(longer, "paths")
        if hop == hops:
            found.append(paths)
    listed = found[0]
    for f in found[1:]:
        listed = listed.unionByName(f)
    best = listed.groupBy("path").agg(F.min("place").alias("place")).orderBy(F.desc(F.size("path")), "place").limit(keep)
    ranked = best.select("path", F.row_number().over(Window.orderBy(F.desc(F.size("path")), "place")).alias("rank"))  # at most `keep` rows
    shown = edges.select(edge_id().alias("edge_id"), "row_id", F.col("sender_account").alias("source"), F.col("receiver_account").alias("target"), "transaction_id", "amount_paise", "epoch_s", "hop")
    return Structure(spark.createDataFrame(list(nodes.items()), "account string, hop int"), shown, ranked, truncated)


def reachable(ledger: DataFrame, account: str, hops: int = 4) -> DataFrame:
    """(account, hop): least number of outflow steps from an account, without caps; every hop is a distributed join."""
    spark = ledger.sparkSession
    edges = ledger.select(F.col("sender_account").alias("a"), F.col("receiver_account").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    found = spark.createDataFrame([(account, 0)], "account string, hop int")
    for hop in range(1, hops + 1):
        front = found.where(F.col("hop") == hop - 1).select(F.col("account").alias("a"))
        fresh = edges.join(front, "a", "left_semi").select(F.col("b").alias("account")).distinct().join(found, "account", "left_anti")
        found = found.unionByName(fresh.withColumn("hop", F.lit(hop)))
    return found


#: Reasons why a trace is cut.
ROOT_CUT, ACCOUNT_CUT, EDGES_CUT = "ROOT_OUTGOING_BRANCH_LIMIT", "ACCOUNT_OUTGOING_BRANCH_LIMIT:{}", "Exceeded maximum trace edges ({})"
_POOL = "account string, seq long, row_id long, epoch_s long, paise long"
_EDGES = "hop int, source_row_id long, destination_row_id long, account string, destination_account string, attributed_paise long, delay_s long, cycle boolean, path array<string>, epoch_s long"


def _takes(pool: DataFrame, outs: DataFrame, horizon: int | None) -> DataFrame:
    """(account, seq, destination_row_id, destination_account, attributed_paise, delay_s, epoch_s): what outflows take of the pool's money, first in, first out.

    The pool's entries are inflows on their account's line of money, so takes are where stretches of the line meet. What an
    outflow takes came strictly before it, by second and row, and within the horizon.
    """
    place = lambda seq: F.struct("row_id", seq.alias("seq"))
    ins = pool.select(place(F.col("seq")).alias("row_id"), F.lit("").alias("transaction_id"), "epoch_s", "paise", F.col("account").alias("acc"), F.lit("").alias("cp"), F.lit(0).alias("side"))
    paid = outs.select(place(F.lit(-1).cast("long")).alias("row_id"), F.lit("").alias("transaction_id"), "epoch_s", F.col("amount_paise").alias("paise"), F.col("sender_account").alias("acc"), F.col("receiver_account").alias("cp"), F.lit(1).alias("side"))
    met = fifo.attributed(ins.unionByName(paid), horizon)
    return met.select(
        F.col("acc").alias("account"), F.col("i.row_id.seq").alias("seq"), F.col("o.row_id.row_id").alias("destination_row_id"), F.col("o.cp").alias("destination_account"),
        "attributed_paise", (F.col("o.epoch_s") - F.col("i.epoch_s")).alias("delay_s"), F.col("o.epoch_s").alias("epoch_s"),
    )


def attribution_trace(ledger: DataFrame, root: str, root_row_id: int | None = None, config: Trace = Trace(), lookup: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Edges of money followed from an account's outflows over up to config.hops hops.

    Columns: hop, source_row_id (null at the first), destination_row_id, account, destination_account, attributed_paise,
    delay_s, cycle, path (the branch's accounts, the destination last), epoch_s, truncated, truncation_reason. The first
    `branches` outflows of each account count; a destination already on the branch ends it (cycle). Accounts of a hop come
    in the order in which money reached them; once there are `edges` edges no further account pays out, and an account
    under way stops after the outflow that exceeds them if something was cut before. The reason is that of the first cut.

    A hop is one join of the ledger with the accounts of the pool, and windows over the pool's and the outflows' money. The
    pool and a hop's takes, at most branches + 1 for each of its entries, go through the driver. lookup: a function from
    accounts to their transfers, where the ledger is laid out for that (see PartyStore.of).
    """
    spark = ledger.sparkSession
    rank = F.row_number().over(Window.partitionBy("sender_account").orderBy("epoch_s", "row_id"))
    cols = ["sender_account", "receiver_account", "row_id", "epoch_s", "amount_paise"]
    of = lookup or (lambda *_: ledger)
    seeds = of(root).where(F.col("sender_account") == root)
    if root_row_id is not None:
        seeds = seeds.where(F.col("row_id") == root_row_id)
    first = seeds.orderBy("epoch_s", "row_id").select(*cols).limit(config.branches + 1).collect()
    reason = ROOT_CUT if len(first) > config.branches else None
    edges, pool = [], []
    for r in first[: config.branches]:
        edges.append((1, None, r["row_id"], root, r["receiver_account"], r["amount_paise"], 0, False, [root, r["receiver_account"]], r["epoch_s"]))
        pool.append((r["receiver_account"], len(pool), r["row_id"], r["epoch_s"], r["amount_paise"], (root, r["receiver_account"])))
    for hop in range(2, config.hops + 1):
        if not pool:
            break
        front = spark.createDataFrame([p[:5] for p in pool], _POOL)
        names = F.broadcast(front.select(F.col("account").alias("sender_account")).distinct())
        outs = materialise(of(*dict.fromkeys(p[0] for p in pool)).select(*cols).join(names, "sender_account", "left_semi").withColumn("n", rank).where(F.col("n") <= config.branches + 1), "outflows")
        over = {r[0] for r in outs.where(F.col("n") > config.branches).select("sender_account").collect()}  # at most one row an account of the pool
        takes: dict[str, list] = {}
        for r in _takes(front, outs.where(F.col("n") <= config.branches), config.horizon).collect():
            takes.setdefault(r["account"], []).append(r)
        entries, pool = pool, []
        for account in dict.fromkeys(p[0] for p in entries):
            if len(edges) >= config.edges:
                reason = reason or EDGES_CUT.format(config.edges)
                break
            if account in over:
                reason = reason or ACCOUNT_CUT.format(account)
            paying = None
            for t in sorted(takes.get(account, ()), key=lambda t: (t["epoch_s"], t["destination_row_id"], entries[t["seq"]][3], entries[t["seq"]][2], t["seq"])):
                if paying not in (None, t["destination_row_id"]) and reason and len(edges) >= config.edges:
                    break
                paying = t["destination_row_id"]
                _, _, row, _, _, path = entries[t["seq"]]
                cycle = t["destination_account"] in path
                longer = (*path, t["destination_account"])
                edges.append((hop, row, t["destination_row_id"], account, t["destination_account"], t["attributed_paise"], t["delay_s"], cycle, list(longer), t["epoch_s"]))
                if not cycle:
                    pool.append((t["destination_account"], len(pool), t["destination_row_id"], t["epoch_s"], t["attributed_paise"], longer))
    return spark.createDataFrame(edges, _EDGES).withColumns({"truncated": F.lit(reason is not None), "truncation_reason": F.lit(reason).cast("string")})


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle, hop, paise): the different closed paths of a trace, as accounts joined by arrows, where they close first, and the money that closes them."""
    return edges.where("cycle").groupBy(F.array_join("path", " -> ").alias("cycle")).agg(F.min("hop").alias("hop"), F.sum("attributed_paise").alias("paise"))


def branch_paths(edges: DataFrame) -> DataFrame:
    """(path, hops, edges, paise): the different branches of a trace up to each of its edges, and the money of their last step."""
    return edges.groupBy("path").agg(F.max("hop").alias("hops"), F.count(F.lit(1)).alias("edges"), F.sum("attributed_paise").alias("paise"))


def terminals(edges: DataFrame) -> DataFrame:
    """Where traced money ends: destinations that pass nothing on, with their sum and greatest hop."""
    return edges.join(edges.select(F.col("account").alias("destination_account")).distinct(), "destination_account", "left_anti").groupBy("destination_account").agg(F.sum("attributed_paise").alias("attributed_paise"), F.max("hop").alias("max_hop"))


def hop_summary(edges: DataFrame) -> DataFrame:
    """Edges, accounts reached, money and closed cycles of each hop of a trace."""
    return edges.groupBy("hop").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("destination_account").alias("accounts"), F.sum("attributed_paise").alias("paise"), F.count_if("cycle").alias("cycles"))


def named_edges(edges: DataFrame) -> DataFrame:
    """edges with edge_id, made of the rows that money comes from and goes to and the hop, and edge_type."""
    first = F.col("hop") == 1
    name = F.concat_ws("_", F.lit("ATTR"), F.coalesce(F.col("source_row_id").cast("string"), F.lit("ROOT")), F.col("destination_row_id").cast("string"), F.concat(F.lit("H"), F.col("hop").cast("string")))
    return edges.withColumn("edge_id", name).withColumn("edge_type", F.when(first, "ROOT_SEED").otherwise("FIFO_ATTRIBUTION"))


def node_sums(edges: DataFrame) -> DataFrame:
    """What each account of a trace gets and passes on, and the least hop that reaches it (0: it starts the trace)."""
    into = edges.groupBy(F.col("destination_account").alias("node")).agg(F.sum("attributed_paise").alias("received_paise"), F.min("hop").alias("hop"))
    out = edges.groupBy(F.col("account").alias("node")).agg(F.sum("attributed_paise").alias("passed_paise"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return into.join(out, "node", "full").select(F.col("node").alias("account"), zero("received_paise"), zero("passed_paise"), zero("hop"))


def layers(edges: DataFrame, depth: int = 10) -> DataFrame:
    """(account, layer): the least hop at which a trace reaches each account."""
    return edges.where(F.col("hop") < depth).groupBy(F.col("destination_account").alias("account")).agg(F.min("hop").alias("layer"))


def with_parents(edges: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """(account, layer, parent) of what edges(source, target) reach from root in `depth` steps; parent is the least account of the layer before with an edge to it.

    Layers are found by distributed joins, each written.
    """
    steps = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    found = edges.sparkSession.createDataFrame([(root, 0, None)], "account string, layer int, parent string")
    for layer in range(1, depth + 1):
        front = found.where(F.col("layer") == layer - 1).select(F.col("account").alias("a"))
        fresh = steps.join(front, "a").groupBy(F.col("b").alias("account")).agg(F.min("a").alias("parent")).join(found, "account", "left_anti")
        fresh = materialise(fresh.select("account", F.lit(layer).alias("layer"), "parent"), "layer")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


#: A network with more nodes than DENSE shows siblings from layer 2 on as one node where there are MEMBERS of them or more.
DENSE, MEMBERS = 50, 4


def collapsed(edges: DataFrame, root: str, depth: int = 10, dense: int = DENSE, members: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """nodes(node, layer, parent, size, paise) and edges(source, target, n, paise) of a network in which siblings are merged.

    edges(source, target, amount_paise). Siblings are accounts of layer 2 or more with one parent (see with_parents); merged,
    they are the node cluster_<parent>, of their least layer, with their number and all that they receive. Edges of merged
    accounts are the cluster's, those within it are left out. Small networks stay as they are.
    """
    placed = materialise(with_parents(edges, root, depth), "placed")
    many = placed.count() > dense
    groups = placed.where("layer >= 2").groupBy("parent").agg(F.count(F.lit(1)).alias("siblings")).where(F.lit(many) & (F.col("siblings") >= members)).select("parent", F.concat(F.lit("cluster_"), "parent").alias("cluster"))
    named = materialise(placed.join(groups, "parent", "left").select("account", F.coalesce("cluster", "account").alias("node"), "layer", "parent"), "named")
    inside = edges.join(named.select(F.col("account").alias("source"), F.col("node").alias("from")), "source").join(named.select(F.col("account").alias("target"), F.col("node").alias("to")), "target")
    received = inside.groupBy("target").agg(F.sum("amount_paise").alias("paise"))
    sums = named.join(received.withColumnRenamed("target", "account"), "account", "left")
    nodes = sums.groupBy("node").agg(F.min("layer").alias("layer"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("paise"), F.lit(0)).alias("paise"))
    merged = inside.where("from <> to").groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("paise"))
    return nodes, merged
