"""Investigations, diaries and drafts of random ledgers beside figures counted from their rows."""

import random
from collections import Counter

import pytest

from tidemark.operators import features, graph, syndicate
from tidemark.plans import evidence, queries
from tidemark.sources import store

SCHEMA = "row_id long, transaction_id string, sender_account string, receiver_account string, sender_ifsc string, receiver_ifsc string, amount_paise long, epoch_s long, payment_mode string, narration string, ip_address string, device_type string"
ONE = "ACC00000001"


@pytest.fixture(scope="module")
def case(spark):
    draw = random.Random(12)
    names = [f"ACC{i:08d}" for i in range(14)]
    rows = []
    for i in range(260):
        a, b = draw.choice(names), draw.choice(names)
        if i % 3 == 0:
            a = ONE
        elif i % 3 == 1:
            b = ONE
        ip = draw.choice([None, *[f"10.0.0.{n}" for n in range(30)]])
        rows.append((i, f"TXN{i:09d}", a, b, f"BANK{a[-6:]}", f"BANK{b[-6:]}", draw.randrange(1, 90_000), draw.randrange(9_000), draw.choice(["UPI", "IMPS", None]), "n", ip, draw.choice(["iOS", "Android"])))
    ledger = spark.createDataFrame(rows, SCHEMA)
    scored = queries.scored_accounts(ledger, features.account_features(ledger))
    accounts = store.materialise(syndicate.with_syndicate(scored, syndicate.syndicate_nodes(ledger, scored)), "accounts")
    edges = graph.attribution_trace(ledger, ONE)
    inv = store.materialise(evidence.investigation(ledger, accounts, ONE, edges=edges), "investigation")
    own = sorted((dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows if ONE in (r[2], r[3])), key=lambda r: (r["epoch_s"], r["row_id"]))
    return ledger, inv, edges.collect(), own


def test_an_investigation_counts_what_the_rows_hold(case):
    _, inv, edges, own = case
    got = inv.first()
    assert got["transaction_count"] == len(own) + sum(r["sender_account"] == r["receiver_account"] for r in own)
    assert [(t["row_id"], t["direction"]) for t in got["transfers"]] == [(r["row_id"], "OUTGOING" if r["sender_account"] == ONE else "INCOMING") for r in own[:100]]
    assert {m["mode"]: m["n"] for m in got["payment_modes"]} == Counter(r["payment_mode"] for r in own if r["payment_mode"])
    addresses = sorted({r["ip_address"] for r in own if r["ip_address"]})
    assert got["ip_addresses"] == addresses and got["ip_address_count"] == len(addresses) and got["devices"] == ["Android", "iOS"]
    assert got["root_paise"] == sum(e["attributed_paise"] for e in edges if e["hop"] == 1) and got["edge_count"] == len(edges)
    assert got["cycles"] == sorted({" -> ".join(e["path"]) for e in edges if e["cycle"]}) and got["cycles"]
    assert got["truncation_reason"] == edges[0]["truncation_reason"]
    passed = {e["account"] for e in edges}
    ends = {}
    for e in edges:
        if e["destination_account"] not in passed and e["destination_account"] != ONE:
            ends[e["destination_account"]] = ends.get(e["destination_account"], 0) + e["attributed_paise"]
    assert {t["destination_account"]: t["attributed_paise"] for t in got["terminals"]} == ends
    assert len(got["velocity_events"]) <= 20 and all(180 <= v["delay_s"] <= 900 for v in got["velocity_events"])


def test_facts(case):
    ledger, inv, edges, own = case
    rows = evidence.facts(inv, evidence.dataset(ledger)).orderBy("fact").collect()
    codes = [r["code"] for r in rows]
    value = {r["code"]: r["value"] for r in rows}
    got = inv.first()
    assert [r["fact"] for r in rows] == list(range(1, len(rows) + 1)) and [c for c, n in Counter(codes).items() if n > 1 and not c.startswith("TX_")] == []
    groups = [r["category"] for r in rows]
    assert sorted(set(groups), key=groups.index) == ["SUBJECT", "TRANSACTION", "RISK", "ROLE", "VELOCITY", "ATTRIBUTION", "PROVENANCE"] and groups == sorted(groups, key=evidence._GROUPS.get)
    incoming = [r["amount_paise"] for r in own if r["receiver_account"] == ONE]
    outgoing = [r["amount_paise"] for r in own if r["sender_account"] == ONE]
    assert value["OBSERVED_INFLOW"] == f"{sum(incoming) / 100:.2f}" and value["NET_FLOW_DELTA"] == f"{(sum(incoming) - sum(outgoing)) / 100:.2f}"
    assert (value["INCOMING_TX_COUNT"], value["OUTGOING_TX_COUNT"]) == (str(len(incoming)), str(len(outgoing)))
    assert value["UNIQUE_IPS"] == str(len({r["ip_address"] for r in own if r["ip_address"]})) and value["ASSOCIATED_IPS"].count(", ") == 9
    assert sum(c.startswith("TX_") for c in codes) <= 5 and sum(c.startswith("RISK_FAMILY_") for c in codes) == 11
    assert {c.removeprefix("RISK_REASON_") for c in codes if c.startswith("RISK_REASON_")} == {r["code"] for r in got["risk_reasons"]}
    assert value["ROOT_SEED_OUTFLOW"] == f"{got['root_paise'] / 100:.2f}" and value["TRUNCATED"].startswith(str(got["truncated"]).lower())
    assert sum(c.startswith("TERMINAL_") for c in codes) == min(10, len(got["terminals"])) and ("CYCLES_DETECTED" in codes) == bool(got["cycles"])
    assert value["DATASET"].startswith("260 ") and evidence.dataset(ledger.repartition(7)).first() == evidence.dataset(ledger).first()
    source = {r["code"]: (r["category"], r["source"], r["provenance"]) for r in rows}
    for category, code, where, origin in evidence.FACTS:
        assert code not in source or source[code] == (category, where, origin)


def test_chronology(spark, case):
    ledger, inv, edges, own = case
    rows = evidence.chronology(inv, graph.attribution_trace(ledger, ONE)).orderBy("entry").collect()
    got = inv.first()
    count = Counter(r["event_type"] for r in rows)
    assert count == Counter({"CASE_OPENED": 1, "ROOT_TRANSACTION": len(got["transfers"]), "ATTRIBUTION_HOP": len(edges), "VELOCITY_EVENT": len(got["velocity_events"]), "TERMINAL_ACCOUNT": len(got["terminals"]), "RISK_FINDING": 1, "ROLE_FINDING": 1}) - Counter()
    assert [r["entry"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0]["event_type"] == "CASE_OPENED" and [r["event_type"] for r in rows[-2:]] == ["RISK_FINDING", "ROLE_FINDING"]
    timed = [(r["epoch_s"], r["row_id"]) for r in rows if r["epoch_s"] is not None]
    assert timed == sorted(timed) and len(timed) == count["ROOT_TRANSACTION"] + count["ATTRIBUTION_HOP"] + count["VELOCITY_EVENT"]
    second = {r["row_id"]: r["epoch_s"] for r in ledger.collect()}
    assert all(r["epoch_s"] == second[r["row_id"]] for r in rows if r["event_type"] == "ATTRIBUTION_HOP")


def test_narratives_snapshots_and_drafts(case):
    ledger, inv, edges, own = case
    (told,) = evidence.narrative(inv).collect()
    named = [ONE, *[t["destination_account"] for t in inv.first()["terminals"]]]
    (checked,) = evidence.check_narratives(evidence.narrative(inv), named).collect()
    assert checked["passes"] and ONE in told["text"] and all(f"{h}\n" in told["text"] for h in ("Roles", "Velocity", "Attribution"))
    (file,) = evidence.case_file(inv).collect()
    assert file["case_id"] == "CASE-" + file["sha256"][:8].upper() and '"truncation_reason":' in file["snapshot"]
    assert '"median_incoming_to_outgoing_seconds":' in file["snapshot"]
    (draft,) = evidence.legal_evidence(inv).collect()
    assert draft["officer"] == "[TO BE FILLED]" and draft["account_number"] == ONE and draft["transfers_listed"] == len(inv.first()["transfers"])
    assert draft["draft_id"] == "DRAFT-" + draft["sha256"][:8].upper()


def test_null_fields_are_told_from_absent_ones(spark):
    df = spark.sql("SELECT cast(NULL AS string) AS a, 1 AS b")
    assert df.select(evidence.canonical(df).alias("j")).first()["j"] == '{"a":null,"b":1}'
