"""Raw ledgers, stores, views and profiles on small data with known results."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.plans import evaluate, evidence, explore, profile
from tidemark.sources import ledger as source
from tidemark.sources import store

HEAD = "Transaction_ID,Sender_Account,Receiver_Account,Sender_IFSC,Receiver_IFSC,Amount,Timestamp,Payment_Mode,Narration,IP_Address,Device_Type"
LINES = [
    "TXN000000001,AAA00000001,BBB00000001,AAAA0123456,BBBB0123456,100.25,2026-09-15 00:01:00,UPI,task one,185.1.1.1,iOS",
    "TXN000000002,BBB00000001,CCC00000001,BBBB0123456,CCCC0123456,60.00,2026-09-15 00:05:00,IMPS,,10.0.0.1,Android",
    "TXN000000002,BBB00000001,AAA00000001,BBBB0123456,AAAA0123456,7.5,2026-09-15 00:06:00,NEFT,Refund,172.16.0.9,Android",
]


@pytest.fixture
def csv(tmp_path):
    def write(lines=LINES, name="ledger.csv"):
        path = tmp_path / name
        path.write_text("\n".join([HEAD, *lines]) + "\n")
        return str(path)

    return write


def test_a_csv_becomes_a_ledger(spark, csv):
    rows = source.from_raw(source.read_raw(spark, csv())).orderBy("row_id").collect()
    assert [(r["row_id"], r["amount_paise"], r["epoch_s"], r["narration"]) for r in rows] == [(0, 10025, 60, "task one"), (1, 6000, 300, None), (2, 750, 360, "Refund")]


def test_csv_and_parquet_agree(spark, csv, tmp_path):
    raw = source.read_raw(spark, csv())
    raw.write.parquet(str(tmp_path / "ledger.parquet"))
    other = source.from_raw(source.read_raw(spark, str(tmp_path / "ledger.parquet")))
    assert source.from_raw(raw).exceptAll(other).count() == 0


def test_rows_are_numbered_over_all_ranges(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS a", "CASE WHEN id % 5 = 0 THEN NULL ELSE id % 11 END AS b").repartition(6)
    got = {r["id"]: r["row_id"] for r in source.numbered(df, ["b", "a", "id"]).collect()}
    rows = sorted(((i % 11 if i % 5 else -1), i % 7, i) for i in range(5000))
    assert got == {i: n for n, (_, _, i) in enumerate(rows)}


def test_strict_and_lossless_reading(spark, csv):
    path = csv([*LINES, "TXN3,A,B,X,Y,much,then,UPI,,1.2.3.4,iOS"])
    with pytest.raises(Exception):
        source.read_raw(spark, path).collect()
    kept = source.read_raw(spark, path, lossless=True)
    assert kept.where("Amount = 'much'").count() == 1 and kept.count() == 4
    assert profile.casts(kept).first().asDict() == {"rows": 4, "no_number": 1, "no_time": 1, "other_ifsc": 1, "other_id": 0}


def test_guard_rails_and_discovery(spark, csv, tmp_path, monkeypatch):
    path = csv()
    with pytest.raises(FileNotFoundError):
        source.read_raw(spark, str(tmp_path / "none.csv"))
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(ValueError):
        source.read_raw(spark, str(tmp_path / "notes.txt"))
    (tmp_path / "truth_labels.csv").write_text("account_number,label\nA,mule\n")
    assert source.discover(str(tmp_path)) == {"ledgers": [path], "labels": [str(tmp_path / "truth_labels.csv")]}
    assert source.is_candidate(spark, path) and not source.is_candidate(spark, str(tmp_path / "truth_labels.csv"))
    assert source.file_digests(spark, path).first()["length"] == len(open(path).read())
    monkeypatch.setenv("LEDGER_PATH", "x.csv")
    assert str(source.ledger_path(root="/r")) == "/r/x.csv" and str(source.ledger_path(env="OTHER", root="/r")) == "/r/data/transactions.csv"


def test_the_shared_folder_is_the_sessions_own(spark, tmp_path):
    df = spark.range(3)
    assert store.materialise(df, "three").count() == 3
    store.layout(spark.range(100).selectExpr("id % 10 AS k", "id"), str(tmp_path / "laid"), "k", 4)
    assert spark.read.parquet(str(tmp_path / "laid")).where("k = 3").count() == 10


def test_labels_from_a_file(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("account_number,label\nA,mule\nB,regular\nA,Mule\nC,maybe\n")
    labels = evaluate.read_labels(spark.read.option("header", True).csv(str(path)))
    assert [r["label"] for r in labels.where("account_number = 'A'").collect()] == [True, True]


@pytest.fixture
def small(spark, csv):
    return source.from_raw(source.read_raw(spark, csv()))


def test_profiles(small):
    words = {r["keyword"]: r["n"] for r in profile.keyword_counts(small).collect()}
    assert words["task"] == words["refund"] == 1 and sum(words.values()) == 2 and len(words) == 10
    assert profile.address_classes(small).first().asDict() == {"ip_185": 1, "ip_194": 0, "private": 2, "addresses": 3}
    assert profile.validation(small).first()["category"] == "B"
    assert profile.validation(small.drop("device_type")).first()["category"] == "C"
    assert profile.validation(small.drop("ip_address")).first()["category"] == "D"
    stats = {r["column"]: r for r in profile.columns(small).collect()}
    assert (stats["narration"]["rows"], stats["narration"]["non_null"], stats["transaction_id"]["distinct"]) == (3, 2, 2)
    assert [r["value"] for r in profile.samples(small, 1).where("column = 'payment_mode'").collect()] == ["IMPS"]
    assert [(r["value"], r["n"]) for r in profile.top_values(small, "sender_account", 1).collect()] == [("BBB00000001", 2)]
    same = {r["figure"]: r["same"] for r in profile.compare_totals(small, small.where("row_id > 0")).collect()}
    assert not same["rows"] and same["null_device_type"]


def test_a_whole_profile_is_one_report(small, tmp_path):
    evidence.write_report(profile.report(small), str(tmp_path / "profile"))
    (one,) = (tmp_path / "profile").glob("part-*.json")
    rows = [json.loads(line) for line in one.read_text().splitlines()]
    parts = {r["section"] for r in rows}
    assert parts == set(profile.sections(small)) and len(parts) == 13
    assert [r["row"] for r in rows if r["section"] == "columns"] == list(range(1, 11))
    (inversions,) = [json.loads(r["content"]) for r in rows if r["section"] == "inversions"]
    assert inversions == {"inversions": 0}


def test_evaluation_reports(spark, tmp_path):
    """Four accounts, of which two are collectors; one label is repeated, one unknown, one of no account, one account has none."""
    flags = sorted({w for sql in evaluate.POLICIES.values() for w in re.findall(r"\b[a-z][a-z0-9_]+\b", sql)} - {"and", "or", "not"})
    rows = spark.createDataFrame([("A", True), ("B", True), ("C", False), ("D", False)], "account_number string, on boolean")
    accounts = rows.select("account_number", *[(F.col("on").cast("double") * 100).alias(f) if f.endswith("index") else F.col("on").alias(f) for f in flags])
    labels = evaluate.read_labels(spark.createDataFrame([("A", "mule"), ("A", "mule"), ("B", "regular"), ("C", "what"), ("Z", "mule")], "account string, label string"))
    evaluate_rows = {r["policy"]: r for r in evaluate.report(accounts, labels).collect()}
    r = evaluate_rows["L1_candidate"]
    assert (r["predicted"], r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"]) == (2, 1, 1, 1, 0, 0.5, 0.5)
    assert (r["labelled"], r["repeated"], r["unrecognised"], r["missing"], r["unlabelled"]) == (4, 1, 1, 1, 1)
    assert r["definition"] == evaluate.POLICIES["L1_candidate"] and evaluate_rows.keys() == evaluate.POLICIES.keys()
    evidence.write_report(evaluate.report(accounts), str(tmp_path / "plain.csv"), "csv")
    (one,) = (tmp_path / "plain.csv").glob("part-*.csv")
    lines = one.read_text().splitlines()
    assert lines[0] == "policy,definition,predicted,population,positive_rate,status" and len(lines) == 1 + len(evaluate.POLICIES)
    assert any(line.startswith("L1_candidate,") and line.endswith(",2,4,0.5,AWAITING_GROUND_TRUTH") for line in lines)


def test_latencies():
    assert evaluate.latency_stats([30.0, 10.0, 20.0]) == {"min": 10.0, "median": 20.0, "mean": 20.0, "p95": 30.0, "max": 30.0}
    assert evaluate.latency_stats([float(i) for i in range(1, 101)])["p95"] == 96.0


def test_pages(small):
    page = explore.explorer_pages(small, explore.explorer_filter(account="bbb00000001"), 1, 2).first()
    assert (page["total"], page["total_pages"], page["has_next"], page["has_previous"]) == (3, 2, True, False)
    by_id = lambda t: small.where(explore.explorer_filter(transaction_id=t)).count()
    assert (by_id("txn000000002"), by_id("00001"), by_id("TXN999999999")) == (2, 1, 0)


def candidate(spark, one=True, two=False, three=False):
    return spark.sql(f"SELECT 'BBB00000001' AS account_number, {one} AS layer1_candidate, {two} AS layer2_candidate, {three} AS layer3_candidate, timestamp_ntz'2026-09-15 00:01:00' AS first_seen_timestamp, timestamp_ntz'2026-09-15 00:06:00' AS last_seen_timestamp")


def kinds(spark, small, account="BBB00000001", layers=(False, False, True), **filters):
    from tidemark.operators import fifo, velocity

    events = explore.timeline(small, candidate(spark, *layers), velocity.velocity_pairs(small), fifo.fifo_edges(small), account, **filters)
    return [r["event_type"] for r in events.collect()]


def test_timeline(spark, small):
    assert sorted(kinds(spark, small)) == ["ATTRIBUTION"] * 2 + ["RISK_ROLE", "TERMINAL"] + ["TRANSACTION"] * 3 + ["VELOCITY"] * 2
    assert "TERMINAL" not in kinds(spark, small, layers=(True, False, True)) and "TERMINAL" not in kinds(spark, small, layers=(False, False, False))
    assert kinds(spark, small, direction="in", event_type="transaction") == ["TRANSACTION"]
    assert kinds(spark, small, payment_mode="neft", event_type="transaction") == ["TRANSACTION"]
    assert sorted(kinds(spark, small, start_s=301)) == ["ATTRIBUTION", "TERMINAL", "TRANSACTION", "VELOCITY"]
    assert kinds(spark, small, account=None) == ["TRANSACTION"] * 3
    events = explore.timeline(small, None, None, None, None)
    assert [(r["total_events"], r["has_more"], r["direction"]) for r in explore.timeline_page(events, 1, 2).collect()] == [(3, True, "OBSERVED")] * 2


def test_guardrail(spark):
    good = "Investigative Overview\nAccount AB12345678.\nSubject Account Activity\nInvestigative Limitations"
    texts = [good, good + " He committed  fraud.", good + " LAUNDERED money, criminal intent, proves guilt", good + " ZZ99999999", "Investigative Overview", None, good + " innocent fraudulent"]
    got = evidence.check_narratives(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["AB12345678"]).orderBy("i").collect()
    assert [r["passes"] for r in got] == [True, False, False, False, False, False, True]
    assert [len(r["violations"]) for r in got] == [0, 1, 3, 1, 2, 3, 0] and got[3]["unknown_accounts"] == ["ZZ99999999"]


def test_canonical_json_sorts_fields_at_every_level(spark):
    df = spark.sql("SELECT 1 AS b, array(named_struct('z', 1, 'a', named_struct('y', 2, 'x', 3))) AS a")
    assert df.select(evidence.canonical(df).alias("j")).first()["j"] == '{"a":[{"a":{"x":3,"y":2},"z":1}],"b":1}'


def test_packages_and_reports(spark, tmp_path):
    path = str(tmp_path / "cases")
    for i in range(2):
        evidence.save_packages(spark.createDataFrame([(f"CASE-{i}", "{}")], "case_id string, snapshot string"), path)
    assert evidence.has_package(spark, path, "CASE-1") and not evidence.has_package(spark, path, "CASE-9")
    assert evidence.get_package(spark, path, "CASE-0").count() == 1 and [r["case_id"] for r in evidence.list_packages(spark, path).collect()] == ["CASE-0", "CASE-1"]
    report = spark.createDataFrame([("p", 1)], "policy string, tp int")
    evidence.write_report(report, str(tmp_path / "r.json"))
    evidence.write_report(report, str(tmp_path / "r.csv"), "csv")
    (one,) = (tmp_path / "r.json").glob("part-*.json")
    assert json.loads(one.read_text()) == {"policy": "p", "tp": 1}
    (one,) = (tmp_path / "r.csv").glob("part-*.csv")
    assert one.read_text().splitlines() == ["policy,tp", "p,1"]


def test_traces(spark, small):
    edges = graph.attribution_trace(small, "AAA00000001")
    named = {r["edge_id"]: r["edge_type"] for r in graph.named_edges(edges).collect()}
    assert named == {"ATTR_ROOT_0_H1": "ROOT_SEED", "ATTR_0_1_H2": "FIFO_ATTRIBUTION", "ATTR_0_2_H2": "FIFO_ATTRIBUTION"}
    hops = {r["hop"]: (r["edges"], r["accounts"], r["paise"], r["cycles"]) for r in graph.hop_summary(edges).collect()}
    assert hops == {1: (1, 1, 10025, 0), 2: (2, 2, 6750, 1)}
    sums = {r["account"]: (r["received_paise"], r["passed_paise"], r["hop"]) for r in graph.node_sums(edges).collect()}
    assert sums == {"AAA00000001": (750, 10025, 2), "BBB00000001": (10025, 6750, 1), "CCC00000001": (6000, 0, 2)}
    assert {r["account"]: r["layer"] for r in graph.layers(edges).collect()} == {"BBB00000001": 1, "CCC00000001": 2, "AAA00000001": 2}
