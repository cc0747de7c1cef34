"""Networks around an account beside brute force."""

import random
from collections import Counter

import pytest

from tidemark.config import Trace
from tidemark.operators import graph
from tidemark.plans import queries

SCHEMA = "row_id long, transaction_id string, sender_account string, receiver_account string, epoch_s long, amount_paise long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def layered(spark):
    """A pays B1..B3, each B pays each C, each C pays both D, and D1 pays A back."""
    pairs = [("A", f"B{i}") for i in range(3)] + [(f"B{i}", f"C{j}") for i in range(3) for j in range(3)]
    pairs += [(f"C{i}", f"D{j}") for i in range(3) for j in range(2)] + [("D1", "A"), ("A", "B1")]
    return spark.createDataFrame([(i, f"T{i}", s, r, i, 1000 + i) for i, (s, r) in enumerate(pairs)], SCHEMA)


def plain_structure(rows, root, hops, most, keep=100):
    """Paths as a list, candidate by candidate; parallel transfers make one path."""
    nodes, edges, done, active, cut = {root: 0}, {}, [], [(root,)], False
    for hop in range(1, hops + 1):
        ends = {p[-1] for p in active}
        outs = sorted((r for r in rows if r["sender_account"] in ends), key=lambda r: (-r["amount_paise"], r["row_id"]))[: 3 * most]
        following = []
        for path in active:
            own = [r for r in outs if r["sender_account"] == path[-1]]
            if not own and len(path) > 1:
                done.append(path)
            for r in own:
                to = r["receiver_account"]
                if to in path:
                    continue
                if len(nodes) >= most:
                    cut = True
                    break
                nodes.setdefault(to, hop)
                edges.setdefault(r["row_id"], hop)
                if (*path, to) not in following:
                    following.append((*path, to))
            if cut:
                break
        if hop == hops:
            done += following
        if cut:
            break
        active = following
    if cut:
        done += [p for p in active if len(p) > 1 and p not in done]
    return nodes, edges, done, cut


@pytest.mark.parametrize(("max_nodes", "truncated"), [(1000, False), (10, False), (9, True), (5, True), (2, True)])
def test_structural_trace(layered, max_nodes, truncated):
    nodes, edges, paths, cut = plain_structure(layered.collect(), "A", 4, max_nodes)
    got = graph.structural_trace(layered, "A", 4, max_nodes)
    assert got.truncated is truncated is cut
    assert {r["account"]: r["hop"] for r in got.nodes.collect()} == nodes
    assert {r["row_id"]: r["hop"] for r in got.edges.collect()} == edges
    found = [tuple(r["path"]) for r in got.paths.orderBy("rank").collect()]
    assert sorted(found) == sorted(paths) and [len(p) for p in found] == sorted(map(len, paths), reverse=True)


def random_ledger(spark, seed, n, accounts, seconds):
    draw = random.Random(seed)
    names = [f"N{i}" for i in range(accounts)]
    rows = [(i, f"T{i}", draw.choice(names), draw.choice(names), draw.randrange(seconds), draw.randrange(1, 400)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("seed", "most"), [(1, 1000), (2, 7), (3, 4)])
def test_structural_trace_of_random_ledgers(spark, seed, most):
    df = random_ledger(spark, seed, 40, 9, 50)
    nodes, edges, paths, cut = plain_structure(df.collect(), "N0", 3, most)
    got = graph.structural_trace(df, "N0", 3, most, keep=10_000)
    assert got.truncated is cut and {r["account"]: r["hop"] for r in got.nodes.collect()} == nodes
    assert {r["row_id"]: r["hop"] for r in got.edges.collect()} == edges
    assert {tuple(r["path"]) for r in got.paths.collect()} == set(paths)
    full = [tuple(r["path"]) for r in got.paths.orderBy("rank").collect() if len(r["path"]) == 4]
    assert full == [p for p in paths if len(p) == 4]


def plain_trace(rows, root, config):
    """Edges (hop, source, destination, account, to, paise, cycle, path) and the reason of the first cut."""
    order = sorted(rows, key=lambda r: (r["epoch_s"], r["row_id"]))
    outs = lambda a: [r for r in order if r["sender_account"] == a]
    first, reason, edges, pools = outs(root), None, [], {}
    if len(first) > config.branches:
        reason = "ROOT_OUTGOING_BRANCH_LIMIT"
    for r in first[: config.branches]:
        to = r["receiver_account"]
        edges.append((1, None, r["row_id"], root, to, r["amount_paise"], False, (root, to)))
        pools.setdefault(to, []).append([r["row_id"], r["amount_paise"], r["epoch_s"], (root, to)])
    for hop in range(2, config.hops + 1):
        following = {}
        for account, pool in pools.items():
            if len(edges) >= config.edges:
                reason = reason or f"Exceeded maximum trace edges ({config.edges})"
                break
            own = outs(account)
            if len(own) > config.branches:
                reason = reason or f"ACCOUNT_OUTGOING_BRANCH_LIMIT:{account}"
            pool.sort(key=lambda x: (x[2], x[0]))
            for o in own[: config.branches]:
                need, at, to = o["amount_paise"], o["epoch_s"], o["receiver_account"]
                for entry in pool:
                    if (entry[2], entry[0]) >= (at, o["row_id"]):
                        break
                    take = min(entry[1], need)
                    if not take or config.horizon is not None and at - entry[2] > config.horizon:
                        continue
                    entry[1] -= take
                    need -= take
                    path = (*entry[3], to)
                    edges.append((hop, entry[0], o["row_id"], account, to, take, to in entry[3], path))
                    if to not in entry[3]:
                        following.setdefault(to, []).append([o["row_id"], take, at, path])
                if reason and len(edges) >= config.edges:
                    break
        pools = following
    return edges, reason


@pytest.mark.parametrize("config", [Trace(), Trace(branches=4), Trace(edges=25), Trace(branches=5, edges=12), Trace(horizon=30), Trace(hops=6, horizon=80, branches=9)])
def test_attribution_traces_of_random_ledgers(spark, config):
    for seed in (1 + config.branches % 2,):
        df = random_ledger(spark, seed, 160, 12, 120)
        edges, reason = plain_trace(df.collect(), "N0", config)
        traced = graph.attribution_trace(df, "N0", config=config)
        rows = traced.collect()
        got = [(r["hop"], r["source_row_id"], r["destination_row_id"], r["account"], r["destination_account"], r["attributed_paise"], r["cycle"], tuple(r["path"])) for r in rows]
        assert sorted(got, key=str) == sorted(edges, key=str)
        assert {(r["truncation_reason"], r["truncated"]) for r in rows} == {(reason, reason is not None)}
        assert {r["cycle"] for r in graph.cycles(traced).collect()} == {" -> ".join(e[7]) for e in edges if e[6]}
        assert {tuple(r["path"]): r["edges"] for r in graph.branch_paths(traced).collect()} == Counter(e[7] for e in edges)


@pytest.mark.parametrize(("root_outflows", "inner_outflows", "reason", "count"), [(51, 0, "ROOT_OUTGOING_BRANCH_LIMIT", 50), (50, 0, None, 50), (1, 51, "ACCOUNT_OUTGOING_BRANCH_LIMIT:B", 51), (1, 50, None, 51)])
def test_branch_limits_and_their_reasons(spark, root_outflows, inner_outflows, reason, count):
    first = [("R", "B" if i == 0 else f"D{i}", i, 1_000_000) for i in range(root_outflows)]
    rows = first + [("B", f"E{i}", 600 + i, 5_000) for i in range(inner_outflows)]
    df = spark.createDataFrame([(i, f"T{i}", *r) for i, r in enumerate(rows)], SCHEMA)
    edges = graph.attribution_trace(df, "R").collect()
    assert len(edges) == count and {(r["truncated"], r["truncation_reason"]) for r in edges} == {(reason is not None, reason)}


def test_collapsed_siblings(spark):
    """Two hubs below the root: one with five accounts that pay each other, one with three."""
    pairs = [("R", "P"), ("R", "Q")] + [("P", f"A{i}") for i in range(5)] + [("Q", f"B{i}") for i in range(3)] + [("A0", "A1"), ("A2", "B0"), ("B1", "C"), ("P", "A0")]
    df = spark.createDataFrame([(a, b, 10) for a, b in pairs], "source string, target string, amount_paise long")
    nodes, edges = graph.collapsed(df, "R", dense=5)
    got = {r["node"]: (r["layer"], r["parent"], r["size"], r["paise"]) for r in nodes.collect()}
    assert got["cluster_P"] == (2, "P", 5, 70) and got["B0"] == (2, "Q", 1, 20) and "A0" not in got and len(got) == 8
    assert {(r["source"], r["target"]): r["n"] for r in edges.collect()} == {("R", "P"): 1, ("R", "Q"): 1, ("P", "cluster_P"): 6, ("Q", "B0"): 1, ("Q", "B1"): 1, ("Q", "B2"): 1, ("cluster_P", "B0"): 1, ("B1", "C"): 1}
    assert graph.collapsed(df, "R")[0].where("size > 1").isEmpty()


def test_traces_follow_the_default_branches(spark):
    outflows = queries.ledger(spark, SF).where(f"sender_account = '{queries.HUB}'").orderBy("epoch_s", "row_id").collect()
    edges = queries.QUERIES["trace_attribution_hops"](spark, SF).collect()
    assert len(outflows) > 10
    assert sorted(r["destination_row_id"] for r in edges if r["hop"] == 1) == sorted(r["row_id"] for r in outflows[:50])
    passed = {r["account"] for r in edges}
    sums = {}
    for r in edges:
        if r["destination_account"] not in passed:
            sums[r["destination_account"]] = sums.get(r["destination_account"], 0) + r["attributed_paise"]
    found = queries.QUERIES["trace_terminals"](spark, SF).collect()
    assert {r["destination_account"]: r["attributed_paise"] for r in found} == sums


def test_an_uncapped_neighbourhood_stays_off_the_driver(layered, monkeypatch):
    capped = [sorted(map(tuple, df.collect())) for df in graph.neighbourhood(layered, "C0", 2, 1000)]
    monkeypatch.setattr(graph, "_kept", None)
    nodes, edges = graph.neighbourhood(layered, "C0", 2, None)
    assert [sorted(map(tuple, df.collect())) for df in (nodes, edges)] == capped
    assert nodes.where("hop = 1").count() == 5
