"""The ledger's queries over the derived ledger, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, fifo, graph, risk, roles, syndicate, velocity
from ..sources.ledger import derive_ledger
from ..sources.store import PartyStore, materialise, party_store
from . import evaluate, evidence, explore, profile

_kept: dict[tuple, DataFrame] = {}


def _keep(kind: str, spark: SparkSession, sf_dir: str, make: Callable, keep: Callable = materialise):
    """A tier of the store, written once a session: many queries read the ledger and the account table."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = keep(make(), kind)
    return _kept[key]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep("ledger", spark, sf_dir, lambda: derive_ledger(spark, sf_dir))


def parties(spark: SparkSession, sf_dir: str) -> PartyStore:
    """The ledger laid out for lookups by account and id."""
    return _keep("parties", spark, sf_dir, lambda: party_store(ledger(spark, sf_dir)), keep=lambda made, _: made)


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep("dimension", spark, sf_dir, lambda: features.accounts_dimension(ledger(spark, sf_dir)))


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keep("features", spark, sf_dir, lambda: features.account_features(ledger(spark, sf_dir)))


def scored_accounts(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Features enriched by roles, velocity and risk, in this order."""
    return risk.score_risk(velocity.with_velocity(roles.classify_roles(base), velocity.velocity_accounts(rows)))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    scored = _keep("scored", spark, sf_dir, lambda: scored_accounts(rows, base_features(spark, sf_dir)))
    return _keep("accounts", spark, sf_dir, lambda: syndicate.with_syndicate(scored, syndicate.syndicate_nodes(rows, scored)))


#: An account that passes money on, one that receives much, and a transfer's id, in every size of the data.
THROUGH, HUB, TX = "ACC00000013", "ACC00000012", "TXN000000011"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LEDGER = """
m AS (SELECT greatest(20, cast(floor(count(*)/2) as bigint)) AS n FROM customer),
k AS (SELECT row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice,l_quantity,l_discount,l_tax) - 1 AS rid,
  o_custkey % n AS s0, (l_partkey*31+l_suppkey*7+l_linenumber*13) % n AS r0, n, cast(floor(cast(round(l_extendedprice*100) as bigint)/20) as bigint) AS paise,
  (l_orderkey*7919+l_partkey*31+l_suppkey*101+l_linenumber*1009) % 1294000 AS ep, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey CROSS JOIN m),
b AS (SELECT rid, n, paise, ep, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, 0 AS gen,
  CASE WHEN s0 % 25 = 3 THEN s0 - 1 WHEN s0 % 50 = 13 THEN s0 - 1 ELSE s0 END AS s, CASE WHEN r0 % 25 = 7 THEN r0 - 1 ELSE r0 END AS r FROM k),
u AS (SELECT rid*2 AS row_id, * FROM b UNION ALL
  SELECT rid*2+1, rid, n, cast(floor(paise*97/100) as bigint), ep+180+ep%720, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, 1, r, cast(floor((rid%(n-4))/25) as bigint)*25+3 FROM b WHERE r % 50 = 13),
ledger AS (SELECT row_id, 'TXN' || lpad(cast(l_orderkey*10+l_linenumber as string), 9, '0') AS transaction_id,
  'ACC' || lpad(cast(s as string), 8, '0') AS sender_account, 'ACC' || lpad(cast(r as string), 8, '0') AS receiver_account,
  'BANK0' || lpad(cast(s%97 as string), 6, '0') AS sender_ifsc, 'BANK0' || lpad(cast(r%97 as string), 6, '0') AS receiver_ifsc, paise AS amount_paise, ep AS epoch_s,
  CASE WHEN l_partkey%100 < 65 THEN 'UPI' WHEN l_partkey%100 < 87 THEN 'IMPS' WHEN l_partkey%100 < 97 THEN 'NEFT' ELSE 'RTGS' END AS payment_mode,
  CASE WHEN l_linestatus='O' AND l_returnflag='R' AND l_linenumber=1 THEN '' ELSE l_returnflag || '_' || l_linestatus || '_' || cast(l_linenumber as string) END AS narration,
  '185.' || cast(s%200 as string) || '.' || cast(CASE WHEN s%40=11 THEN 1 ELSE l_suppkey%9 END as string) || '.' || cast(s%250 as string) AS ip_address,
  CASE WHEN gen=1 AND s%100=13 THEN 'Linux_Script' WHEN s%40=11 THEN 'Web_Emulator' WHEN (l_partkey+l_suppkey)%3=0 THEN 'Android' WHEN (l_partkey+l_suppkey)%3=1 THEN 'iOS' ELSE 'Windows_Browser' END AS device_type FROM u),
e AS (SELECT row_id, epoch_s, amount_paise, payment_mode, narration, ip_address, device_type, sender_account AS acc, receiver_account AS cp, sender_ifsc AS ifsc, 1 AS is_out, 0 AS is_in FROM ledger
  UNION ALL SELECT row_id, epoch_s, amount_paise, payment_mode, narration, ip_address, device_type, receiver_account, sender_account, receiver_ifsc, 0, 1 FROM ledger)"""

TS = "TIMESTAMP '2026-09-15 00:00:00' + to_seconds({})"

DIM = f"""
dim AS (SELECT acc AS account_number, cast(sum(amount_paise*is_in) as bigint)/100 AS total_inflow, cast(sum(amount_paise*is_out) as bigint)/100 AS total_outflow,
  cast(sum(amount_paise*(is_in-is_out)) as bigint)/100 AS net_flow_delta, cast(sum(is_in) as bigint) AS incoming_txn_count, cast(sum(is_out) as bigint) AS outgoing_txn_count, count(*) AS transaction_count,
  count(distinct CASE WHEN is_in=1 THEN cp END) AS unique_senders, count(distinct CASE WHEN is_out=1 THEN cp END) AS unique_receivers, count(distinct cp) AS counterparty_count,
  {TS.format('min(epoch_s)')} AS first_seen_timestamp, {TS.format('max(epoch_s)')} AS last_seen_timestamp,
  count(distinct CASE WHEN is_out=1 THEN ifsc END) AS sender_ifsc_count, count(distinct CASE WHEN is_in=1 THEN ifsc END) AS receiver_ifsc_count,
  count(distinct ip_address) AS unique_ip_count, count(distinct device_type) AS unique_device_count, count(distinct payment_mode) AS unique_payment_mode_count, 'DERIVED' AS provenance FROM e GROUP BY acc)"""

_side = lambda s, f: ", ".join(f"round({g}(CASE WHEN {f}=1 THEN amount_paise END))/100 AS {s}_amount_{n}" for n, g in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"), ("stddev", "stddev_pop")))
_cnt = lambda c, v, n: f"count(*) FILTER (WHERE {c}='{v}') AS {n}_txn_count"

FEATURES = f"""
fa AS (SELECT acc, count(*) AS n, cast(sum(is_in) as bigint) AS incoming_txn_count, cast(sum(is_out) as bigint) AS outgoing_txn_count,
  cast(sum(amount_paise*is_in) as bigint)/100 AS incoming_volume, cast(sum(amount_paise*is_out) as bigint)/100 AS outgoing_volume, cast(sum(amount_paise*(is_in-is_out)) as bigint)/100 AS net_flow_delta,
  count(distinct CASE WHEN is_in=1 THEN cp END) AS fan_in, count(distinct CASE WHEN is_out=1 THEN cp END) AS fan_out, count(distinct cp) AS unique_counterparties,
  min(epoch_s) AS first_s, max(epoch_s) AS last_s, count(distinct epoch_s//86400) AS active_day_count, count(distinct epoch_s//3600) AS active_hour_count, count(distinct epoch_s//3600%24) AS unique_active_hours,
  count(*) FILTER (WHERE epoch_s//3600%24 BETWEEN 0 AND 5) AS night_transaction_count, count(distinct device_type) AS unique_device_count, count(distinct ip_address) AS unique_ip_count,
  count(distinct narration) AS unique_narration_count, count(*) FILTER (WHERE narration IS NULL OR trim(narration)='') AS empty_narration_count,
  {', '.join(_cnt('device_type', v, n) for n, v in features.DEVICES.items())}, {', '.join(_cnt('payment_mode', v, n) for n, v in features.MODES.items())},
  {_side('incoming', 'is_in')}, {_side('outgoing', 'is_out')} FROM e GROUP BY acc),
tip AS (SELECT acc, max(k) AS top_ip_transaction_count FROM (SELECT acc, ip_address, count(*) AS k FROM e GROUP BY 1,2) GROUP BY acc),
feat AS (SELECT fa.acc AS account_number, n AS transaction_count, incoming_txn_count, outgoing_txn_count, incoming_volume, outgoing_volume, net_flow_delta, fan_in, fan_out, unique_counterparties,
  CASE WHEN incoming_volume>0 THEN round(outgoing_volume/incoming_volume,4) END AS outflow_to_inflow_ratio, CASE WHEN outgoing_volume>0 THEN round(incoming_volume/outgoing_volume,4) END AS inflow_to_outflow_ratio,
  {TS.format('first_s')} AS first_seen_timestamp, {TS.format('last_s')} AS last_seen_timestamp, last_s-first_s AS activity_span_seconds, active_day_count, active_hour_count, ((200*n+active_day_count)//(2*active_day_count))/100 AS transactions_per_active_day,
  {', '.join(f'{s}_amount_{k}' for s in ('incoming', 'outgoing') for k in ('min', 'max', 'mean', 'median', 'stddev'))},
  unique_device_count, {', '.join(f'{k}_txn_count' for k in (*features.DEVICES, *features.MODES))}, round(web_emulator_txn_count/n,4) AS web_emulator_ratio, round(linux_script_txn_count/n,4) AS linux_script_ratio,
  unique_ip_count, ((200*n+unique_ip_count)//(2*unique_ip_count))/100 AS transactions_per_unique_ip, top_ip_transaction_count, round(top_ip_transaction_count/n,4) AS top_ip_transaction_ratio,
  {', '.join(f'round({k}_txn_count/n,4) AS {k}_ratio' for k in features.MODES)}, unique_narration_count, empty_narration_count, round((n-unique_narration_count)/n,4) AS narration_repeat_ratio,
  active_day_count AS unique_active_dates, unique_active_hours, night_transaction_count, round(night_transaction_count/n,4) AS night_transaction_ratio FROM fa JOIN tip ON fa.acc=tip.acc)"""

ROLES = """
sig AS (SELECT *, fan_in>=95 AS a1, incoming_txn_count>=95 AS a2, incoming_volume>=150000 AS a3, net_flow_delta>0 OR fan_in>fan_out OR coalesce(inflow_to_outflow_ratio,1.0)>=1.0 AS a4,
  fan_out>=95 AS b1, outgoing_txn_count>=95 AS b2, outgoing_volume>=150000 AS b3, net_flow_delta<0 OR fan_out>fan_in OR coalesce(outflow_to_inflow_ratio,1.0)>=1.0 AS b4,
  incoming_volume>=50000 AND incoming_txn_count>=2 AND outgoing_txn_count<=0 AS c1,
  web_emulator_txn_count+linux_script_txn_count>0 AND outgoing_volume>=100000 AND outgoing_txn_count>=2 AND (outgoing_volume>=incoming_volume OR outgoing_txn_count>=incoming_txn_count) AS c2,
  top_ip_transaction_ratio>=0.20 AND incoming_volume>=50000 AND outgoing_txn_count<=0 AS c3 FROM feat),
rol AS (SELECT *, a1 AND a2 AND a3 AS layer1_candidate, b1 AND b2 AND b3 AS layer2_candidate, c1 OR c2 OR c3 AS layer3_candidate,
  CASE WHEN a1 AND a2 AND a3 THEN 3+cast(a4 as int) ELSE 0 END AS layer1_signal_count, CASE WHEN b1 AND b2 AND b3 THEN 3+cast(b4 as int) ELSE 0 END AS layer2_signal_count,
  cast(c1 as int)*2+cast(c2 as int)*3+cast(c3 AND NOT c1 as int)*2 AS layer3_signal_count FROM sig)"""

VELOCITY = """
pairs AS (SELECT i.receiver_account AS acc, i.row_id AS in_row, o.row_id AS out_row, i.transaction_id AS in_tx, o.transaction_id AS out_tx, i.epoch_s AS in_s, o.epoch_s AS out_s, i.amount_paise AS in_paise, o.amount_paise AS out_paise, o.epoch_s-i.epoch_s AS delay_s
  FROM (SELECT *, unnest([epoch_s//900, epoch_s//900+1]) AS slot FROM ledger) i JOIN (SELECT *, epoch_s//900 AS slot FROM ledger) o ON i.receiver_account=o.sender_account AND i.slot=o.slot AND o.epoch_s-i.epoch_s BETWEEN 180 AND 900),
po AS (SELECT acc, out_row, out_paise, least(out_paise, sum(in_paise)) AS paise, median(delay_s) AS delay FROM pairs GROUP BY 1,2,3),
pa AS (SELECT acc, sum(paise) AS attributed, sum(out_paise) AS rapid, count(*) AS n, median(delay) AS delay FROM po GROUP BY 1),
ti AS (SELECT receiver_account AS acc, sum(amount_paise) AS inflow FROM ledger GROUP BY 1),
soon AS (SELECT o.sender_account AS acc, count(distinct o.row_id) AS n FROM ledger o JOIN ledger i ON i.receiver_account=o.sender_account AND o.epoch_s-i.epoch_s BETWEEN 0 AND 179 GROUP BY 1),
late AS (SELECT o.sender_account AS acc, count(distinct o.row_id) AS n FROM ledger o JOIN ledger i ON i.receiver_account=o.sender_account AND o.epoch_s-i.epoch_s BETWEEN 901 AND 86400 GROUP BY 1),
vel AS (SELECT ti.acc AS account_number, round(cast(coalesce(attributed,0) as bigint)/cast(inflow as bigint),6) AS pass_through_ratio, coalesce(pa.n,0) AS pass_through_event_count, pa.delay AS median_incoming_to_outgoing_seconds, coalesce(pa.n,0) AS rapid_outflow_count,
  cast(inflow as bigint)/100 AS pass_through_incoming_volume, cast(coalesce(attributed,0) as bigint)/100 AS pass_through_attributed_volume, coalesce(pa.n,0) AS pass_through_outgoing_transaction_count, cast(coalesce(rapid,0) as bigint)/100 AS pass_through_outgoing_volume,
  coalesce(soon.n,0) AS under_3_minute_event_count, coalesce(late.n,0) AS over_15_minute_event_count, coalesce(cast(attributed as bigint)/cast(inflow as bigint)>=0.90 AND pa.n>=2, false) AS pass_through_candidate
  FROM ti LEFT JOIN pa ON ti.acc=pa.acc LEFT JOIN soon ON ti.acc=soon.acc LEFT JOIN late ON ti.acc=late.acc)"""

RISK = """
ri AS (SELECT rol.*, coalesce(v.pass_through_candidate,false) AS pass_through_candidate, v.pass_through_ratio, coalesce(v.pass_through_ratio,0) AS pt, coalesce(v.pass_through_event_count,0) AS ev, coalesce(v.pass_through_outgoing_transaction_count,0) AS po,
  web_emulator_txn_count+linux_script_txn_count AS au, incoming_txn_count+outgoing_txn_count AS tt FROM rol LEFT JOIN vel v ON rol.account_number=v.account_number),
rb AS (SELECT *,
  CASE WHEN ev>=1 AND po>=2 THEN CASE WHEN pt>=.9 THEN 40 WHEN pt>=.7 THEN 30 WHEN pt>=.4 THEN 20 WHEN pt>=.2 THEN 10 ELSE 5 END WHEN ev>=1 AND po=1 THEN CASE WHEN pt>=.8 THEN 15 WHEN pt>=.4 THEN 8 ELSE 0 END ELSE 0 END::double AS b_vel,
  least(30, CASE WHEN au>=2 OR (tt>0 AND au/tt>=.5) THEN 22 WHEN au>=1 THEN 12 ELSE 0 END + CASE WHEN tt>=5 AND top_ip_transaction_ratio>=.9 THEN 8 WHEN tt>=3 AND top_ip_transaction_ratio>=.75 THEN 4 ELSE 0 END)::double AS b_auto,
  CASE WHEN incoming_volume>0 AND outgoing_volume>0 THEN CASE WHEN least(incoming_volume,outgoing_volume)/greatest(incoming_volume,outgoing_volume)>=.85 THEN 20 WHEN least(incoming_volume,outgoing_volume)/greatest(incoming_volume,outgoing_volume)>=.65 THEN 14 WHEN least(incoming_volume,outgoing_volume)/greatest(incoming_volume,outgoing_volume)>=.45 THEN 8 ELSE 0 END
    WHEN outgoing_txn_count=0 AND incoming_volume>=150000 THEN 14 ELSE 0 END::double AS b_parity,
  least(10, CASE WHEN transactions_per_active_day>=10 THEN 5 WHEN transactions_per_active_day>=5 THEN 3 ELSE 0 END + CASE WHEN tt>=5 AND night_transaction_count/tt>=.3 THEN 5 WHEN night_transaction_count>=2 THEN 2 ELSE 0 END)::double AS b_burst,
  CASE WHEN greatest(fan_in,fan_out)>=100 THEN 35 WHEN greatest(fan_in,fan_out)>=95 THEN 25 WHEN greatest(fan_in,fan_out)>=75 THEN 15 WHEN greatest(fan_in,fan_out)>=50 THEN 8 WHEN greatest(fan_in,fan_out)>=20 THEN 4 ELSE 0 END::double AS s_degree,
  CASE WHEN least(fan_in,fan_out)>=95 THEN 25 WHEN greatest(fan_in,fan_out)>=50 AND least(fan_in,fan_out)<=5 THEN 20 WHEN least(fan_in,fan_out)>=50 THEN 12 WHEN greatest(fan_in,fan_out)>=20 AND least(fan_in,fan_out)<=3 THEN 10 WHEN least(fan_in,fan_out)>=20 THEN 6 ELSE 0 END::double AS s_intermediary,
  CASE WHEN incoming_volume+outgoing_volume>=1000000 THEN 20 WHEN incoming_volume+outgoing_volume>=500000 THEN 14 WHEN incoming_volume+outgoing_volume>=250000 THEN 8 WHEN incoming_volume+outgoing_volume>=100000 THEN 4 ELSE 0 END::double AS s_volume,
  least(20, 10*(cast(layer1_candidate as int)+cast(layer2_candidate as int)+cast(layer3_candidate as int)))::double AS s_role FROM ri),
rs AS (SELECT *, least(100, b_vel+b_auto+b_parity+b_burst) AS behavioral_risk_index, least(100, s_degree+s_intermediary+s_volume+s_role) AS structural_risk_index FROM rb),
rm AS (SELECT *, least(100, .5*behavioral_risk_index::double+.5*structural_risk_index::double+CASE WHEN behavioral_risk_index>=50 AND structural_risk_index>=50 THEN 10 ELSE 0 END) AS mule_risk_index FROM rs),
risk AS (SELECT *, CASE WHEN mule_risk_index>=75 THEN 'VERY_HIGH' WHEN mule_risk_index>=50 THEN 'HIGH' WHEN mule_risk_index>=25 THEN 'MODERATE' ELSE 'LOW' END AS risk_band,
  CASE WHEN behavioral_risk_index>=50 AND structural_risk_index>=50 THEN 'MULTI-MODAL EVIDENCE' WHEN structural_risk_index>=50 THEN 'ELEVATED STRUCTURAL INDICATORS' WHEN behavioral_risk_index>=50 THEN 'ELEVATED BEHAVIORAL INDICATORS' WHEN (behavioral_risk_index+structural_risk_index)/2>=35 THEN 'REVIEW REQUIRED' ELSE 'LOW CURRENT INDICATOR' END AS evidence_signal FROM rm)"""

SYNDICATE = """
s1 AS (SELECT DISTINCT sender_account AS collector, receiver_account AS distributor FROM ledger WHERE receiver_account IN (SELECT account_number FROM risk WHERE pass_through_candidate)),
s2 AS (SELECT DISTINCT sender_account AS distributor, receiver_account AS terminal FROM ledger WHERE sender_account IN (SELECT account_number FROM risk WHERE pass_through_candidate) AND receiver_account IN (SELECT account_number FROM risk WHERE layer3_candidate)),
chains AS (SELECT collector, s1.distributor, terminal FROM s1 JOIN s2 ON s1.distributor=s2.distributor),
synd AS (SELECT acc AS account_number, CASE WHEN count(distinct stage)>1 THEN 'MULTI_STAGE' ELSE max(stage) END AS syndicate_stage FROM (
  SELECT DISTINCT collector AS acc, 'STAGE_1_COLLECTOR' AS stage FROM chains UNION ALL SELECT DISTINCT distributor, 'STAGE_2_DISTRIBUTOR' FROM chains UNION ALL SELECT DISTINCT terminal, 'STAGE_3_TERMINAL' FROM chains) GROUP BY 1),
acct AS (SELECT risk.*, syndicate_stage, syndicate_stage IS NOT NULL AS predicted_mule_candidate FROM risk LEFT JOIN synd ON risk.account_number=synd.account_number)"""

FIFO = """
ev AS (SELECT receiver_account AS acc, row_id, epoch_s, amount_paise AS paise, 0 AS side, transaction_id, sender_account AS cp FROM ledger UNION ALL SELECT sender_account, row_id, epoch_s, amount_paise, 1, transaction_id, receiver_account FROM ledger),
o1 AS (SELECT *, sum(CASE WHEN side=0 THEN paise ELSE 0 END) OVER w AS cin, sum(CASE WHEN side=1 THEN paise ELSE 0 END) OVER w AS cout FROM ev WINDOW w AS (PARTITION BY acc ORDER BY epoch_s,row_id,side DESC ROWS UNBOUNDED PRECEDING)),
o2 AS (SELECT *, cout+least(0, min(cin-cout) OVER (PARTITION BY acc ORDER BY epoch_s,row_id ROWS UNBOUNDED PRECEDING)) AS a_hi FROM o1 WHERE side=1),
outs AS (SELECT *, coalesce(lag(a_hi) OVER (PARTITION BY acc ORDER BY epoch_s,row_id),0) AS a_lo FROM o2),
ins AS (SELECT *, cin-paise AS i_lo, cin AS i_hi FROM o1 WHERE side=0),
edges AS (SELECT o.acc AS account, i.row_id AS source_row_id, o.row_id AS destination_row_id, cast(least(a_hi,i_hi)-greatest(a_lo,i_lo) as bigint) AS attributed_paise, o.epoch_s-i.epoch_s AS delay_s FROM outs o JOIN ins i ON o.acc=i.acc AND i_lo<a_hi AND a_lo<i_hi)"""


def query(name: str, sql: str | None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            recursive = "RECURSIVE " if "-- recursive" in sql else ""
            ORACLE[name] = f"WITH {recursive}{','.join((LEDGER, *ctes))}{sql}"
        return f

    return add


SCORED = (FEATURES, ROLES, VELOCITY, RISK)


def _trace(spark: SparkSession, sf_dir: str, account: str) -> DataFrame:
    """A trace by scans of the ledger, one a hop: a second copy pays where there are many lookups."""
    return graph.attribution_trace(ledger(spark, sf_dir), account)


def _own(spark: SparkSession, sf_dir: str, account: str) -> DataFrame:
    """The transfers of an account, found by one scan."""
    return _keep(f"own-{account}", spark, sf_dir, lambda: ledger(spark, sf_dir).where(explore.party(account)))


def _q(name: str, f: Callable, sql: str | None, *ctes: str) -> None:
    query(name, sql, *ctes)(f)


_q("ledger_rows", lambda s, d: ledger(s, d), " SELECT * FROM ledger")
_q("ledger_summary", lambda s, d: explore.ledger_summary(ledger(s, d)), " SELECT count(*) AS transactions, count(distinct transaction_id) AS distinct_ids, cast(sum(amount_paise) as bigint) AS total_paise, min(epoch_s) AS first_s, max(epoch_s) AS last_s, (SELECT count(distinct acc) FROM e) AS accounts FROM ledger")
for _c in ("payment_mode", "device_type"):
    _q(f"{_c.split('_')[-1]}_distribution", lambda s, d, c=_c: explore.distribution(ledger(s, d), c), f" SELECT {_c} AS value, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (),4) AS pct FROM ledger GROUP BY 1")
_q("unique_accounts", lambda s, d: ledger(s, d).select("sender_account").union(ledger(s, d).select("receiver_account")).distinct().toDF("account"), " SELECT sender_account AS account FROM ledger UNION SELECT receiver_account FROM ledger")
_q("accounts_dimension", dimension, " SELECT * FROM dim", DIM)
_q("account_search_topk", lambda s, d: explore.account_search(dimension(s, d), "acc0000001", 20), " SELECT * FROM dim WHERE account_number ILIKE '%acc0000001%' ORDER BY transaction_count DESC, account_number LIMIT 20", DIM)
_FLOW = ["account_number", "transaction_count", "incoming_txn_count", "outgoing_txn_count", "incoming_volume", "outgoing_volume", "net_flow_delta", "fan_in", "fan_out", "unique_counterparties", "outflow_to_inflow_ratio", "inflow_to_outflow_ratio"]
_AMOUNT = ["account_number", *[f"{x}_amount_{k}" for x in ("incoming", "outgoing") for k in ("min", "max", "mean", "median", "stddev")]]
_DEVICE = ["account_number", "unique_device_count", *[f"{k}_txn_count" for k in (*features.DEVICES, *features.MODES)], "web_emulator_ratio", "linux_script_ratio", *[f"{k}_ratio" for k in features.MODES]]
_IP = ["account_number", "unique_ip_count", "transactions_per_unique_ip", "top_ip_transaction_count", "top_ip_transaction_ratio"]
_TIME = ["account_number", "first_seen_timestamp", "last_seen_timestamp", "activity_span_seconds", "active_day_count", "active_hour_count", "transactions_per_active_day", "unique_active_dates", "unique_active_hours", "night_transaction_count", "night_transaction_ratio"]
_NARR = ["account_number", "unique_narration_count", "empty_narration_count", "narration_repeat_ratio"]
for _n, _cols in (("flow", _FLOW), ("amount_stats", _AMOUNT), ("device_mode", _DEVICE), ("ip_top", _IP), ("temporal", _TIME), ("narration", _NARR)):
    _q(f"features_{_n}", lambda s, d, c=_cols: base_features(s, d).select(*c), f" SELECT {', '.join(_cols)} FROM feat", FEATURES)

_LAYERS = [f"layer{i}_{k}" for i in (1, 2, 3) for k in ("candidate", "signal_count")]
_q("roles_flags", lambda s, d: roles.classify_roles(base_features(s, d)).select("account_number", *_LAYERS, roles.role_label().alias("role"), roles.investigation_label().alias("investigation_role")), f""" SELECT account_number, {', '.join(_LAYERS)},
  CASE WHEN cast(layer1_candidate as int)+cast(layer2_candidate as int)+cast(layer3_candidate as int)>1 THEN 'MIXED' WHEN layer1_candidate THEN 'L1_COLLECTOR' WHEN layer2_candidate THEN 'L2_DISTRIBUTOR' WHEN layer3_candidate THEN 'L3_TERMINAL' ELSE 'NONE' END AS role,
  CASE WHEN layer3_candidate THEN 'L3_TERMINAL' WHEN layer2_candidate THEN 'L2_DISTRIBUTOR' WHEN layer1_candidate THEN 'L1_COLLECTOR' ELSE 'NONE' END AS investigation_role FROM rol""", FEATURES, ROLES)  # fmt: skip


def _reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.classify_roles(base_features(spark, sf_dir))
    parts = [rows.select("account_number", F.lit(i).alias("layer"), F.explode(f"layer{i}_reasons").alias("r")) for i in (1, 2, 3)]
    return evaluate.union_all(parts).select("account_number", "layer", "r.code", "r.observed_value")


_R = lambda layer, cond, code, value: f"SELECT account_number, {layer} AS layer, '{code}' AS code, cast({value} as varchar) AS observed_value FROM rol WHERE layer{layer}_candidate AND {cond}"
_dec = lambda c: f"cast({c} as decimal(20,2))"
_q("roles_reason_codes", _reason_codes, " " + " UNION ALL ".join([
    _R(1, "a1", "HIGH_FAN_IN", "fan_in"), _R(1, "a2", "HIGH_INBOUND_TRANSACTION_COUNT", "incoming_txn_count"), _R(1, "a3", "HIGH_INBOUND_VOLUME", _dec("incoming_volume")), _R(1, "a4", "INBOUND_FLOW_DOMINANCE", _dec("coalesce(inflow_to_outflow_ratio,1.0)")),
    _R(2, "b1", "HIGH_FAN_OUT", "fan_out"), _R(2, "b2", "HIGH_OUTBOUND_TRANSACTION_COUNT", "outgoing_txn_count"), _R(2, "b3", "HIGH_OUTBOUND_VOLUME", _dec("outgoing_volume")), _R(2, "b4", "OUTBOUND_FLOW_DOMINANCE", _dec("coalesce(outflow_to_inflow_ratio,1.0)")),
    _R(3, "c1", "TERMINAL_FLOW_SINK", _dec("incoming_volume")), _R(3, "c1", "ZERO_OUTBOUND_DISBURSEMENT", "'0'"), _R(3, "c2", "AUTOMATION_DEVICE_ACTIVITY", "web_emulator_txn_count+linux_script_txn_count"), _R(3, "c2", "HIGH_OUTBOUND_DISBURSEMENT", _dec("outgoing_volume")),
    _R(3, "c2", "OUTBOUND_FLOW_DOMINANCE", _dec("coalesce(outflow_to_inflow_ratio,1.0)")), _R(3, "c3", "HIGH_IP_CONCENTRATION", "cast(top_ip_transaction_ratio*100 as decimal(10,1))"), _R(3, "c3 AND NOT c1", "TERMINAL_FLOW_SINK", _dec("incoming_volume")),
]), FEATURES, ROLES)
_q("roles_overlap_summary", lambda s, d: roles.overlaps(roles.classify_roles(base_features(s, d))), " SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("layer1", "layer1_candidate"), ("layer2", "layer2_candidate"), ("layer3", "layer3_candidate"), ("layer1_layer2", "layer1_candidate AND layer2_candidate"), ("layer1_layer3", "layer1_candidate AND layer3_candidate"), ("layer2_layer3", "layer2_candidate AND layer3_candidate"), ("all_three", "layer1_candidate AND layer2_candidate AND layer3_candidate"), ("any_role", "layer1_candidate OR layer2_candidate OR layer3_candidate"))) + " FROM rol", FEATURES, ROLES)

_q("velocity_pairs", lambda s, d: velocity.velocity_pairs(ledger(s, d)).select("acc", "in_row", "out_row", "in_paise", "out_paise", "delay_s"), " SELECT acc, in_row, out_row, in_paise, out_paise, delay_s FROM pairs", VELOCITY)
_q("velocity_accounts", lambda s, d: velocity.velocity_accounts(ledger(s, d)), " SELECT * FROM vel", VELOCITY)
_q("velocity_summary", lambda s, d: velocity.velocity_summary(velocity.velocity_accounts(ledger(s, d))), " SELECT count(*) AS accounts, count(*) FILTER (WHERE pass_through_candidate) AS candidates, cast(sum(pass_through_event_count) as bigint) AS events, cast(sum(under_3_minute_event_count) as bigint) AS under_3min, cast(sum(over_15_minute_event_count) as bigint) AS over_15min, max(pass_through_ratio) AS max_ratio FROM vel", VELOCITY)
_q("velocity_events_account", lambda s, d: velocity.velocity_events(ledger(s, d), THROUGH), f" SELECT *, least(in_paise,out_paise) AS attributed_paise FROM pairs WHERE acc='{THROUGH}' ORDER BY out_s, out_row, in_s, in_row LIMIT 100", VELOCITY)

_PARTS = ["b_vel", "b_auto", "b_parity", "b_burst", "s_degree", "s_intermediary", "s_volume", "s_role"]
_q("risk_components", lambda s, d: accounts(s, d).select("account_number", *_PARTS), f" SELECT account_number, {', '.join(_PARTS)} FROM risk", *SCORED)
_SCORES = ["account_number", "behavioral_risk_index", "structural_risk_index", "mule_risk_index", "risk_band", "evidence_signal"]
_q("risk_scores", lambda s, d: accounts(s, d).select(*_SCORES), " SELECT account_number, behavioral_risk_index::double AS behavioral_risk_index, structural_risk_index::double AS structural_risk_index, mule_risk_index::double AS mule_risk_index, risk_band, evidence_signal FROM risk", *SCORED)
_q("risk_band_counts", lambda s, d: accounts(s, d).groupBy("risk_band").agg(F.count(F.lit(1)).alias("n")), " SELECT risk_band, count(*) AS n FROM risk GROUP BY 1", *SCORED)
_P = lambda cond, code, points: f"SELECT account_number, '{code}' AS code, {points}::double AS points FROM risk WHERE {cond}"
_REASONS = " UNION ALL ".join([
    _P("b_vel>=30", "CRITICAL_PASS_THROUGH_VELOCITY", "b_vel"), _P("b_vel>=10 AND b_vel<30", "ELEVATED_PASS_THROUGH_VELOCITY", "b_vel"), _P("b_auto>=18", "HEAVY_AUTOMATED_DEVICE_USAGE", "b_auto"), _P("b_auto>=10 AND b_auto<18", "AUTOMATED_DEVICE_DETECTED", "b_auto"),
    _P("b_parity>=14 AND incoming_volume>0 AND outgoing_volume>0", "BALANCED_TRANSIT_FLOW", "b_parity"), _P("b_parity>=14 AND NOT (incoming_volume>0 AND outgoing_volume>0) AND outgoing_txn_count=0", "TERMINAL_ACCUMULATION_SINK", "b_parity"), _P("b_burst>=5", "HIGH_BURST_FREQUENCY", "b_burst"),
    _P("s_degree>=25", "EXTREME_COUNTERPARTY_DEGREE", "s_degree"), _P("s_degree>=8 AND s_degree<25", "ELEVATED_COUNTERPARTY_DEGREE", "s_degree"), _P("s_intermediary>=20", "INTERMEDIARY_CONDUIT_TOPOLOGY", "s_intermediary"), _P("s_intermediary>=10 AND s_intermediary<20", "ASYMMETRIC_FLOW_DISPERSAL", "s_intermediary"),
    _P("s_volume>=14", "HIGH_MONETARY_THROUGHPUT", "s_volume"), _P("s_volume>=4 AND s_volume<14", "ELEVATED_MONETARY_VOLUME", "s_volume"), *[_P(f"layer{i}_candidate", c, "10") for i, c in ((1, "LAYER1_COLLECTOR_ROLE_CANDIDATE"), (2, "LAYER2_DISTRIBUTOR_ROLE_CANDIDATE"), (3, "LAYER3_TERMINAL_ROLE_CANDIDATE"))],
])
_q("risk_reasons_exploded", lambda s, d: accounts(s, d).select("account_number", F.explode("risk_reasons").alias("r")).select("account_number", "r.code", "r.points"), " " + _REASONS, *SCORED)

_q("syndicate_nodes", lambda s, d: accounts(s, d).where("predicted_mule_candidate").select("account_number", "syndicate_stage"), " SELECT * FROM synd", *SCORED, SYNDICATE)
_q("syndicate_evidence", lambda s, d: accounts(s, d).select("account_number", "predicted_mule_candidate", "syndicate_evidence"), f""" SELECT f.account_number, s.account_number IS NOT NULL AS predicted_mule_candidate, CASE WHEN s.account_number IS NULL THEN '{{}}' ELSE '{{"stage":"'||syndicate_stage||'","in_connected_chain":true,"policy":"{syndicate.POLICY}","lineage":"{syndicate.LINEAGE}"}}' END AS syndicate_evidence FROM feat f LEFT JOIN synd s USING (account_number)""", *SCORED, SYNDICATE)
_q("risk_families", lambda s, d: accounts(s, d).select("account_number", F.explode("risk_family_scores").alias("family", "points")), " " + " UNION ALL ".join(f"SELECT account_number, '{k}' AS family, {c}::double AS points FROM risk" for k, c in risk.FAMILIES.items()), *SCORED)
_q("account_summary", lambda s, d: evidence.account_summary(ledger(s, d), HUB).select(F.size("payment_modes").alias("modes"), F.expr("aggregate(payment_modes, 0L, (x, m) -> x + m.n)").alias("n"), "ifsc_count", "ip_address_count", "device_count", F.size("ip_addresses").alias("listed"), F.array_join("devices", ",").alias("devices")), f" SELECT cast(count(distinct payment_mode) as int) AS modes, count(*) AS n, count(distinct CASE WHEN sender_account='{HUB}' THEN sender_ifsc ELSE receiver_ifsc END) AS ifsc_count, count(distinct ip_address) AS ip_address_count, count(distinct device_type) AS device_count, cast(least({evidence.LISTED}, count(distinct ip_address)) as int) AS listed, string_agg(DISTINCT device_type, ',' ORDER BY device_type) AS devices FROM ledger WHERE sender_account='{HUB}' OR receiver_account='{HUB}'")
_q("syndicate_chain_metrics", lambda s, d: syndicate.chain_metrics(ledger(s, d), accounts(s, d)), " SELECT count(distinct collector) AS collectors, count(distinct distributor) AS distributors, count(distinct terminal) AS terminals, count(*) AS chains FROM chains", *SCORED, SYNDICATE)

_q("fifo_edges", lambda s, d: fifo.fifo_edges(ledger(s, d)).select("account", "source_row_id", "destination_row_id", "attributed_paise", "delay_s"), " SELECT * FROM edges", FIFO)
_q("fifo_unallocated", lambda s, d: fifo.fifo_unallocated(ledger(s, d)).select("account", "destination_row_id", "attributed_paise", "unallocated_paise", "reason"), " SELECT acc AS account, row_id AS destination_row_id, cast(a_hi-a_lo as bigint) AS attributed_paise, cast(paise-(a_hi-a_lo) as bigint) AS unallocated_paise, CASE WHEN cin=0 THEN 'NO_PRIOR_INFLOW' ELSE 'INFLOW_DEPLETED' END AS reason FROM outs WHERE paise>a_hi-a_lo", FIFO)
_q("fifo_account_totals", lambda s, d: fifo.fifo_totals(ledger(s, d)), """ SELECT a.acc AS account, cast(coalesce(sum(paise) FILTER (WHERE side=0),0) as bigint) AS incoming_paise, cast(coalesce(sum(paise) FILTER (WHERE side=1),0) as bigint) AS outgoing_paise,
  cast(coalesce((SELECT sum(a_hi-a_lo) FROM outs WHERE outs.acc=a.acc),0) as bigint) AS attributed_paise, cast(coalesce(sum(paise) FILTER (WHERE side=1),0)-coalesce((SELECT sum(a_hi-a_lo) FROM outs WHERE outs.acc=a.acc),0) as bigint) AS unallocated_paise,
  count(*) FILTER (WHERE side=0) AS incoming_count, count(*) FILTER (WHERE side=1) AS outgoing_count FROM ev a GROUP BY a.acc""", FIFO)  # fmt: skip


def _tx_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    # the least id among the transfers of the pass-through account
    one = rows.where(F.col("sender_account") == THROUGH).agg(F.min("transaction_id")).first()[0]
    return fifo.transaction_fifo(rows, one, None).na.fill(-1, ["source_row_id", "attributed_paise", "delay_s"])


_q("fifo_tx_attribution", _tx_fifo, f", one AS (SELECT min(row_id) AS row_id FROM ledger WHERE transaction_id=(SELECT min(transaction_id) FROM ledger WHERE sender_account='{THROUGH}')), own AS (SELECT edges.* FROM edges JOIN one ON destination_row_id=row_id) SELECT l.row_id AS destination_row_id, coalesce(source_row_id,-1) AS source_row_id, coalesce(attributed_paise,-1) AS attributed_paise, coalesce(delay_s,-1) AS delay_s, cast(greatest(0, amount_paise-coalesce(sum(attributed_paise) OVER (),0)) as bigint) AS remaining_paise FROM ledger l JOIN one ON l.row_id=one.row_id LEFT JOIN own ON own.destination_row_id=l.row_id AND own.account=l.sender_account", FIFO)
HORIZON = 6 * 3600
#: The same step by step: each account's outflows one after the other, all accounts' at a time.
_STEPS = f"""ins AS (SELECT receiver_account AS acc, row_id, epoch_s, epoch_s*10000000+row_id AS at, amount_paise AS p, sum(amount_paise) OVER w AS hi, count(*) OVER w AS n FROM ledger WINDOW w AS (PARTITION BY receiver_account ORDER BY epoch_s, row_id)),
outs AS (SELECT sender_account AS acc, row_id, epoch_s, epoch_s*10000000+row_id AS at, amount_paise AS p, row_number() OVER (PARTITION BY sender_account ORDER BY epoch_s, row_id) AS j FROM ledger),
had AS (SELECT o.*, coalesce(i.hi,0) AS have, coalesce(i.n,0) AS n_in FROM outs o ASOF LEFT JOIN ins i ON o.acc=i.acc AND o.at>i.at),
bound AS (SELECT o.*, coalesce(i.hi,0) AS gone, coalesce(i.n,0) AS n_gone FROM had o ASOF LEFT JOIN ins i ON o.acc=i.acc AND (o.epoch_s-{HORIZON})*10000000>i.at),
step AS (SELECT DISTINCT acc, 0::BIGINT AS j, 0::HUGEINT AS lo, 0::HUGEINT AS done FROM outs UNION ALL
  SELECT b.acc, b.j, greatest(done, gone), greatest(done, least(greatest(done, gone)+p, have)) FROM step JOIN bound b ON b.acc=step.acc AND b.j=step.j+1),
used AS (SELECT b.*, lo, done FROM bound b JOIN step USING (acc, j))"""
_q("fifo_horizon_records", lambda s, d: fifo.horizon_records(ledger(s, d), HORIZON), """ -- recursive
SELECT u.acc AS account, i.row_id AS source_row_id, u.row_id AS destination_row_id, cast(least(i.hi, done)-greatest(i.hi-i.p, lo) as bigint) AS attributed_paise, u.epoch_s-i.epoch_s AS delay_s, NULL::BIGINT AS unallocated_paise, NULL::VARCHAR AS reason
FROM used u JOIN ins i ON i.acc=u.acc AND i.hi>lo AND i.hi-i.p<done WHERE least(i.hi, done)>greatest(i.hi-i.p, lo)
UNION ALL SELECT acc, NULL, row_id, NULL, NULL, cast(p-(done-lo) as bigint), CASE WHEN n_in=0 THEN 'NO_PRIOR_INFLOW' WHEN n_gone=n_in THEN 'HORIZON_EXCEEDED' ELSE 'INFLOW_DEPLETED' END FROM used WHERE p>done-lo""", _STEPS)

_BOTH = "und AS (SELECT sender_account AS a, receiver_account AS b FROM ledger UNION SELECT receiver_account, sender_account FROM ledger)"
_WALK = lambda edges, hops: f", walk AS (SELECT '{HUB}' AS account, 0 AS hop UNION SELECT b, hop+1 FROM walk JOIN {edges} ON a=account WHERE hop<{hops}) -- recursive\n SELECT account, min(hop) AS hop FROM walk GROUP BY 1"
_q("ego_graph_2hop", lambda s, d: graph.neighbourhood(ledger(s, d), HUB, 2, None)[0], _WALK("und", 2), _BOTH)
_q("ego_graph_edges", lambda s, d: graph.neighbourhood(ledger(s, d), HUB, 1, None)[1], f" SELECT sender_account||'_'||receiver_account||'_'||transaction_id||'_'||epoch_s||'_'||row_id AS edge_id, row_id, sender_account AS source, receiver_account AS target, amount_paise, epoch_s FROM ledger WHERE sender_account='{HUB}' OR receiver_account='{HUB}'")
_q("trace_structural_hops", lambda s, d: graph.reachable(ledger(s, d), HUB, 4), _WALK("dir", 4), "dir AS (SELECT DISTINCT sender_account AS a, receiver_account AS b FROM ledger)")


def _structural_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.structural_trace(ledger(spark, sf_dir), HUB)
    return found.paths.withColumn("truncated", F.lit(found.truncated))


_q("trace_structural_paths", _structural_paths, None)
_q("trace_structural_edges", lambda s, d: graph.structural_trace(ledger(s, d), HUB).edges, None)
_q("trace_structural_nodes", lambda s, d: graph.structural_trace(ledger(s, d), HUB).nodes, None)


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select(F.col("sender_account").alias("source"), F.col("receiver_account").alias("target"), "amount_paise")


_MERGED = f""", walk AS (SELECT '{HUB}' AS account, 0 AS hop UNION SELECT b, hop+1 FROM walk JOIN dir ON a=account WHERE hop<10), -- recursive
lay AS (SELECT account, min(hop) AS layer FROM walk GROUP BY 1),
par AS (SELECT y.account, min(a) AS parent FROM dir JOIN lay x ON a=x.account JOIN lay y ON b=y.account AND y.layer=x.layer+1 GROUP BY 1),
placed AS (SELECT lay.account, layer, parent FROM lay LEFT JOIN par USING (account)),
big AS (SELECT parent FROM placed WHERE layer>=2 AND (SELECT count(*) FROM placed)>50 GROUP BY 1 HAVING count(*)>=4),
named AS (SELECT account, CASE WHEN big.parent IS NOT NULL THEN 'cluster_'||big.parent ELSE account END AS node, layer, placed.parent FROM placed LEFT JOIN big ON big.parent=placed.parent),
inside AS (SELECT x.node AS source, y.node AS target, receiver_account, amount_paise FROM ledger JOIN named x ON sender_account=x.account JOIN named y ON receiver_account=y.account)"""
_DIR = "dir AS (SELECT DISTINCT sender_account AS a, receiver_account AS b FROM ledger)"
_q("network_clusters", lambda s, d: graph.collapsed(_network(s, d), HUB)[0], _MERGED + " SELECT node, min(layer) AS layer, min(parent) AS parent, count(*) AS size, cast(coalesce(sum(r.paise),0) as bigint) AS paise FROM named LEFT JOIN (SELECT receiver_account, sum(amount_paise) AS paise FROM inside GROUP BY 1) r ON r.receiver_account=account GROUP BY 1", _DIR)
_q("network_cluster_edges", lambda s, d: graph.collapsed(_network(s, d), HUB)[1], _MERGED + " SELECT source, target, count(*) AS n, cast(sum(amount_paise) as bigint) AS paise FROM inside WHERE source<>target GROUP BY 1,2", _DIR)
_q("trace_attribution_hops", lambda s, d: _trace(s, d, HUB), None)
_q("trace_cycles", lambda s, d: graph.cycles(_trace(s, d, HUB)), None)
_q("trace_branch_paths", lambda s, d: graph.branch_paths(_trace(s, d, HUB)), None)
_q("trace_terminals", lambda s, d: graph.terminals(_trace(s, d, HUB)), None)

_q("mule_list_filtered", lambda s, d: explore.mule_list(accounts(s, d), role="ANY", min_risk=30.0, sort_by="inflow", limit=50, offset=10).select("account_number", "role", "risk_band", "mule_risk_index", "incoming_volume"), """ SELECT account_number, CASE WHEN cast(layer1_candidate as int)+cast(layer2_candidate as int)+cast(layer3_candidate as int)>1 THEN 'MIXED' WHEN layer1_candidate THEN 'L1_COLLECTOR' WHEN layer2_candidate THEN 'L2_DISTRIBUTOR' ELSE 'L3_TERMINAL' END AS role, risk_band, mule_risk_index::double AS mule_risk_index, incoming_volume
  FROM risk WHERE (layer1_candidate OR layer2_candidate OR layer3_candidate) AND mule_risk_index>=30 ORDER BY incoming_volume DESC NULLS LAST, account_number LIMIT 50 OFFSET 10""", *SCORED)  # fmt: skip
_q("mule_summary", lambda s, d: explore.mule_summary(accounts(s, d)), " SELECT count(*) AS accounts, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("layer1", "layer1_candidate"), ("layer2", "layer2_candidate"), ("layer3", "layer3_candidate"), ("velocity", "pass_through_candidate"), ("predicted", "predicted_mule_candidate"), ("high_risk_count", "mule_risk_index>=70"))) + " FROM acct", *SCORED, SYNDICATE)
def _detail(spark: SparkSession, sf_dir: str, account: str) -> DataFrame:
    """An account's detail from its own transfers: of one account, neither the dimension of all others nor a second copy of the ledger is needed."""
    own = _own(spark, sf_dir, account)
    return explore.account_detail(own, features.accounts_dimension(own), account)


_q("account_detail_modes", lambda s, d: ledger(s, d).where(explore.party(HUB)).groupBy("payment_mode").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("paise")), f" SELECT payment_mode, count(*) AS n, cast(sum(amount_paise) as bigint) AS paise FROM ledger WHERE sender_account='{HUB}' OR receiver_account='{HUB}' GROUP BY 1")
_q("account_ifscs", lambda s, d: explore.account_values(parties(s, d).of(HUB), HUB, "ifsc").select(F.lit(HUB).alias("account_number"), F.col("value").alias("ifsc")), f" SELECT DISTINCT '{HUB}' AS account_number, ifsc FROM e WHERE acc='{HUB}'")
_q("account_detail", lambda s, d: _detail(s, d, HUB).select("account_number", "transaction_count", *[F.array_join(c, ",").alias(c) for c in ("payment_modes", "ifscs", "ip_addresses")]), f" SELECT '{HUB}' AS account_number, count(*) AS transaction_count, string_agg(DISTINCT payment_mode, ',' ORDER BY payment_mode) AS payment_modes, string_agg(DISTINCT ifsc, ',' ORDER BY ifsc) AS ifscs, string_agg(DISTINCT ip_address, ',' ORDER BY ip_address) AS ip_addresses FROM e WHERE acc='{HUB}'")
_q("account_ips", lambda s, d: explore.account_values(parties(s, d).of(HUB), HUB, "ip_address").select(F.lit(HUB).alias("account_number"), F.col("value").alias("ip_address")), f" SELECT DISTINCT acc AS account_number, ip_address FROM e WHERE acc='{HUB}'")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfers with the least id that the pass-through account has sent."""
    found = parties(spark, sf_dir)
    one = found.of(THROUGH).where(F.col("sender_account") == THROUGH).agg(F.min("transaction_id")).first()[0]
    return found.by_id(one).select("row_id", "sender_account", "receiver_account", "amount_paise")


_q("transfer_lookup", _lookup, f" SELECT row_id, sender_account, receiver_account, amount_paise FROM ledger WHERE transaction_id=(SELECT min(transaction_id) FROM ledger WHERE sender_account='{THROUGH}')")
_q("account_ledger_page", lambda s, d: explore.account_ledger(parties(s, d).of(HUB), HUB, "in", 50, 10).select("row_id", "transaction_id", "sender_account", "amount_paise"), f" SELECT row_id, transaction_id, sender_account, amount_paise FROM ledger WHERE receiver_account='{HUB}' ORDER BY amount_paise DESC NULLS LAST, row_id LIMIT 50 OFFSET 10")
_q("explorer_page", lambda s, d: explore.explorer_page(ledger(s, d), explore.explorer_filter(payment_mode="upi", min_paise=50_000, max_paise=300_000, narration="n_o", device_type="Android"), "amount", "desc", 2, 50).select("row_id", "transaction_id", "amount_paise", "epoch_s", "is_duplicate_id"), " SELECT row_id, transaction_id, amount_paise, epoch_s, (SELECT count(*) FROM ledger x WHERE x.transaction_id=l.transaction_id)>1 AS is_duplicate_id FROM (SELECT * FROM ledger WHERE payment_mode='UPI' AND amount_paise BETWEEN 50000 AND 300000 AND narration ILIKE '%n_o%' AND device_type='Android' ORDER BY amount_paise DESC, epoch_s DESC, row_id LIMIT 50 OFFSET 50) l")
_q("explorer_duplicates", lambda s, d: explore.duplicate_ids(ledger(s, d)), " SELECT transaction_id, count(*) AS n, min(row_id) AS first_row_id FROM ledger GROUP BY 1 HAVING count(*)>1")
_q("tx_detail_enriched", lambda s, d: explore.enriched(ledger(s, d), accounts(s, d), explore.stable_id("row_10")).select("row_id", "transaction_id", "sender_account", "receiver_account", "sender_risk", "receiver_risk", "same_id"), " SELECT l.row_id, l.transaction_id, l.sender_account, l.receiver_account, a.mule_risk_index::double AS sender_risk, b.mule_risk_index::double AS receiver_risk, (SELECT count(*) FROM ledger x WHERE x.transaction_id=l.transaction_id) AS same_id FROM ledger l JOIN risk a ON a.account_number=l.sender_account JOIN risk b ON b.account_number=l.receiver_account WHERE l.row_id=10", *SCORED)


def _timeline(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    own = _own(spark, sf_dir, THROUGH)
    return explore.timeline(own, accounts(spark, sf_dir), velocity.velocity_pairs(own), fifo.fifo_edges(own), THROUGH, **filters)


def _dense_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline with -1 and 0 for what an event lacks."""
    return _timeline(spark, sf_dir).drop("truncated").na.fill({"row_id": -1, "amount_paise": 0})


_OWN = f"own AS (SELECT * FROM ledger WHERE sender_account='{THROUGH}' OR receiver_account='{THROUGH}')"
_EVENTS = f"""events AS (
  SELECT 'TX_'||row_id AS event_id, epoch_s, row_id, CASE WHEN receiver_account='{THROUGH}' THEN 'INCOMING' ELSE 'OUTGOING' END AS direction, amount_paise, CASE WHEN receiver_account='{THROUGH}' THEN sender_account ELSE receiver_account END AS counterparty, 'TRANSACTION' AS event_type FROM (SELECT * FROM own ORDER BY epoch_s,row_id LIMIT 5000)
  UNION ALL SELECT 'VEL_'||in_row||'_'||out_row, out_s, out_row, 'OUTGOING', least(in_paise,out_paise), NULL, 'VELOCITY' FROM pairs WHERE acc='{THROUGH}'
  UNION ALL SELECT 'ATTR_'||source_row_id||'_'||destination_row_id, l.epoch_s, destination_row_id, 'OUTGOING', attributed_paise, l.receiver_account, 'ATTRIBUTION' FROM edges JOIN own l ON l.row_id=destination_row_id WHERE account='{THROUGH}'
  UNION ALL SELECT 'RISK_{THROUGH}', min(epoch_s), NULL, NULL, NULL, NULL, 'RISK_ROLE' FROM e WHERE acc='{THROUGH}'
  UNION ALL SELECT 'TERM_{THROUGH}', max(epoch_s), NULL, NULL, NULL, NULL, 'TERMINAL' FROM e WHERE acc='{THROUGH}' AND (SELECT layer3_candidate AND NOT layer1_candidate AND NOT layer2_candidate FROM rol WHERE account_number='{THROUGH}') HAVING count(*)>0)"""
_TIMELINE = (FEATURES, ROLES, _OWN, VELOCITY.replace("FROM ledger", "FROM own").replace("JOIN ledger", "JOIN own"), FIFO.replace("FROM ledger", "FROM own"), _EVENTS)
_q("timeline_events", _dense_timeline, " SELECT event_id, epoch_s, coalesce(row_id,-1) AS row_id, direction, coalesce(amount_paise,0) AS amount_paise, counterparty, event_type FROM events", *_TIMELINE)


def _filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a window's outgoing UPI transfers, with the other events of the window."""
    events = _timeline(spark, sf_dir, direction="out", payment_mode="upi", start_s=200_000, end_s=900_000)
    return explore.timeline_page(events.drop("truncated"), 2, 40).na.fill({"row_id": -1, "amount_paise": 0})


_q("timeline_page", _filtered_page, f", kept AS (SELECT * FROM events WHERE epoch_s BETWEEN 200000 AND 900000 AND (event_type<>'TRANSACTION' OR row_id IN (SELECT row_id FROM own WHERE sender_account='{THROUGH}' AND payment_mode='UPI'))) SELECT event_id, epoch_s, coalesce(row_id,-1) AS row_id, direction, coalesce(amount_paise,0) AS amount_paise, counterparty, event_type, (SELECT count(*) FROM kept) AS total_events, (SELECT count(*) FROM kept)>80 AS has_more FROM (SELECT * FROM kept ORDER BY epoch_s, coalesce(row_id,-1), event_id LIMIT 40 OFFSET 40)", *_TIMELINE)
_q("timeline_counts", lambda s, d: explore.event_counts(_timeline(s, d)), " SELECT event_type, count(*) AS n FROM events GROUP BY 1", *_TIMELINE)
_q("timeline_global", lambda s, d: explore.timeline(ledger(s, d), accounts(s, d), None, None, None, device_type="iOS", event_type="transaction").select("event_id", "epoch_s", "row_id", "direction", "amount_paise", "counterparty"), " SELECT 'TX_'||row_id AS event_id, epoch_s, row_id, 'OBSERVED' AS direction, amount_paise, receiver_account AS counterparty FROM ledger WHERE device_type='iOS' ORDER BY epoch_s, row_id LIMIT 1000")
_q("timeline_cut", lambda s, d: _timeline(s, d, cap=20, event_type="transaction").select("row_id", "truncated"), f" SELECT row_id, (SELECT count(*) FROM own)>20 AS truncated FROM (SELECT * FROM own ORDER BY epoch_s, row_id LIMIT 20)", _OWN)
_q("timeline_summary", lambda s, d: explore.timeline_summary(parties(s, d).of(THROUGH), THROUGH), f" SELECT count(*) AS n, cast(coalesce(sum(amount_paise) FILTER (WHERE receiver_account='{THROUGH}'),0) as bigint) AS in_paise, cast(coalesce(sum(amount_paise) FILTER (WHERE sender_account='{THROUGH}'),0) as bigint) AS out_paise, min(epoch_s) AS first_s, max(epoch_s) AS last_s FROM ledger WHERE sender_account='{THROUGH}' OR receiver_account='{THROUGH}'")


def _investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.investigation(_own(spark, sf_dir, THROUGH), accounts(spark, sf_dir), THROUGH, edges=_trace(spark, sf_dir, THROUGH))


_q("investigation_summary", lambda s, d: _investigation(s, d).select("account_number", "role", "risk_band", "edge_count", "root_paise", "downstream_paise", "hops", "truncated", "investigation_id"), None)
_q("evidence_hash", lambda s, d: evidence.case_file(_investigation(s, d)).select("case_id", "sha256"), None)
_q("legal_evidence", lambda s, d: evidence.legal_evidence(_investigation(s, d)), None)
_q("diary_facts", lambda s, d: evidence.facts(_investigation(s, d), evidence.dataset(ledger(s, d))), None)


def _chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _trace(spark, sf_dir, THROUGH)  # at most as many rows as the trace's cap
    return evidence.chronology(evidence.investigation(_own(spark, sf_dir, THROUGH), accounts(spark, sf_dir), THROUGH, edges=edges), edges)


_q("diary_chronology", _chronology, None)
_q("diary_findings", lambda s, d: evidence.findings(accounts(s, d), HUB).select("code", "points"), f" SELECT code, points FROM ({_REASONS}) WHERE account_number='{HUB}' ORDER BY points DESC, code LIMIT 5", *SCORED)
def _narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a narrative that names the account and the ends of its money, and the paragraph on its activity."""
    inv = _keep("investigation", spark, sf_dir, lambda: _investigation(spark, sf_dir))
    ends = [t["destination_account"] for t in inv.first()["terminals"][: evidence.TERMINAL_FACTS]]
    checked = evidence.check_narratives(evidence.narrative(inv), [THROUGH, *ends])
    return checked.select("account_number", F.size("violations").alias("violations"), "passes", F.split("text", "\n\n")[1].alias("activity"))


_ACTIVITY = f"'{evidence.SECTIONS[1]}'||chr(10)||'INR '||format('{{:,.2f}}', incoming_volume)||' came in by '||incoming_txn_count||' transfers and INR '||format('{{:,.2f}}', outgoing_volume)||' went out by '||outgoing_txn_count||', with '||unique_counterparties||' counterparties.'"
_q("diary_narrative", _narrative, f" SELECT account_number, 0 AS violations, true AS passes, {_ACTIVITY} AS activity FROM feat WHERE account_number='{THROUGH}'", FEATURES)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for every transfer: some draw a legal conclusion, some lack a section."""
    says = F.when(F.col("row_id") % 7 == 0, "who IS  guilty").when(F.col("row_id") % 11 == 0, "of laundered money")
    ends = F.when(F.col("row_id") % 5 != 0, F.lit("Investigative Limitations"))
    return ledger(spark, sf_dir).select("row_id", F.concat_ws(" ", F.lit("Investigative Overview: account"), "sender_account", F.lit("paid"), "receiver_account", says, F.lit("Subject Account Activity"), ends).alias("text"))


_q("narrative_guardrail", lambda s, d: evidence.check_narratives(_told(s, d), [HUB, THROUGH]).select("row_id", F.size("unknown_accounts").cast("long").alias("unknown"), "forbidden", F.size("violations").cast("long").alias("violations"), "passes"), f" SELECT row_id, x AS unknown, f AS forbidden, v AS violations, v=0 AS passes FROM (SELECT *, cast(x>0 as bigint)+cast(f as bigint)+cast(row_id%5=0 as bigint) AS v FROM (SELECT row_id, row_id%7=0 OR row_id%11=0 AS f, cast(CASE WHEN sender_account IN ('{HUB}','{THROUGH}') THEN 0 ELSE 1 END + CASE WHEN receiver_account IN ('{HUB}','{THROUGH}') OR receiver_account=sender_account THEN 0 ELSE 1 END as bigint) AS x FROM ledger))")
_q("trace_hop_summary", lambda s, d: graph.hop_summary(_trace(s, d, THROUGH)), None)
_q("trace_node_sums", lambda s, d: graph.node_sums(_trace(s, d, THROUGH)), None)


def _labels(accounts: DataFrame) -> DataFrame:
    """Labels of a table's accounts by a rule on account numbers, with a repeated, an unrecognised and an unknown one, to test the arithmetic."""
    number = F.substring("account_number", 4, 8).cast("int")
    made = accounts.select("account_number", F.when((number % 50 == 13) | (number % 25 == 3), "mule").otherwise("regular").alias("label"))
    extra = accounts.sparkSession.createDataFrame([("ACC00000003", "Mule"), ("ACC00000005", "maybe"), ("ACC99999999", "yes")], "account_number string, label string")
    return evaluate.read_labels(made.unionByName(extra))


_TESTS = {**evaluate.POLICIES}
_q("policy_counts", lambda s, d: evaluate.policy_counts(accounts(s, d)), " " + " UNION ALL ".join(f"SELECT '{n}' AS policy, count(*) FILTER (WHERE {c}) AS accounts FROM acct" for n, c in _TESTS.items()), *SCORED, SYNDICATE)
_q("policy_confusion", lambda s, d: evaluate.confusion(_labels(accounts(s, d)), accounts(s, d)), """, truth AS (SELECT account_number, cast(substr(account_number,4,8) as bigint)%50=13 OR cast(substr(account_number,4,8) as bigint)%25=3 AS y FROM acct UNION ALL SELECT 'ACC99999999', true),
hits AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS policy, y, coalesce({c}, false) AS hit FROM truth t LEFT JOIN acct a ON a.account_number=t.account_number" for n, c in _TESTS.items()) + """),
cm AS (SELECT policy, count(*) FILTER (WHERE hit AND y) AS tp, count(*) FILTER (WHERE NOT hit AND NOT y) AS tn, count(*) FILTER (WHERE hit AND NOT y) AS fp, count(*) FILTER (WHERE NOT hit AND y) AS fn FROM hits GROUP BY 1)
SELECT policy, tp, tn, fp, fn, tp+tn+fp+fn AS total, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0.0 END,4) AS "precision", round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0.0 END,4) AS recall, round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0.0 END,4) AS f1, round(CASE WHEN tn+fp>0 THEN tn/(tn+fp) ELSE 0.0 END,4) AS specificity, round(CASE WHEN tn+fp>0 THEN fp/(fp+tn) ELSE 0.0 END,4) AS fpr FROM cm""", *SCORED, SYNDICATE)  # fmt: skip
_LABELS = """lab AS (SELECT acc AS account_number, CASE WHEN cast(substr(acc,4,8) as bigint)%50=13 OR cast(substr(acc,4,8) as bigint)%25=3 THEN 'mule' ELSE 'regular' END AS label FROM (SELECT DISTINCT acc FROM e) UNION ALL VALUES ('ACC00000003','Mule'), ('ACC00000005','maybe'), ('ACC99999999','yes')),
once AS (SELECT account_number, count(*) AS n FROM lab GROUP BY 1)"""
_WORDS = ", ".join(f"'{w}'" for w in (*evaluate.POSITIVE, *evaluate.NEGATIVE))
_q("label_audit", lambda s, d: evaluate.label_audit(_labels(dimension(s, d)), dimension(s, d)), f" SELECT count(*) AS labelled, count(*) FILTER (WHERE n>1) AS repeated, (SELECT count(*) FROM lab WHERE upper(trim(label)) NOT IN ({_WORDS})) AS unrecognised, (SELECT count(*) FROM once WHERE account_number NOT IN (SELECT acc FROM e)) AS missing, (SELECT count(DISTINCT acc) FROM e WHERE acc NOT IN (SELECT account_number FROM once)) AS unlabelled FROM once", _LABELS)
_q("evaluation_report", lambda s, d: evaluate.report(accounts(s, d)).select("policy", "predicted", "population", "positive_rate", "status"), " " + " UNION ALL ".join(f"SELECT '{n}' AS policy, count(*) FILTER (WHERE {c}) AS predicted, count(*) AS population, round(count(*) FILTER (WHERE {c})/count(*),4) AS positive_rate, 'AWAITING_GROUND_TRUTH' AS status FROM acct" for n, c in _TESTS.items()), *SCORED, SYNDICATE)

_q("profile_columns", lambda s, d: profile.columns(ledger(s, d)), " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(distinct {c}) AS \"distinct\", min(cast({c} as varchar)) AS least, max(cast({c} as varchar)) AS greatest FROM ledger" for c in profile.COLUMNS))
_pcts = lambda c, ps: ", ".join(f"quantile_cont({c}, {p}) AS p{round(100 * p)}" for p in ps)
_q("profile_amount_percentiles", lambda s, d: profile.amount_percentiles(ledger(s, d), "payment_mode"), f" SELECT payment_mode, min(amount_paise) AS least, {_pcts('amount_paise', (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))}, max(amount_paise) AS greatest FROM ledger GROUP BY 1")
_deg = lambda acc, other, name: f"SELECT '{name}' AS side, count(*) AS accounts, {_pcts('d', (0.5, 0.9, 0.95, 0.99))}, max(d) AS greatest FROM (SELECT {acc}, count(distinct {other}) AS d FROM ledger GROUP BY 1)"
_q("profile_degree_percentiles", lambda s, d: profile.degree_percentiles(ledger(s, d)), " " + _deg("sender_account", "receiver_account", "out") + " UNION ALL " + _deg("receiver_account", "sender_account", "in"))
_q("profile_gap_histogram", lambda s, d: profile.gap_histogram(ledger(s, d)), ", nx AS (SELECT i.acc, i.epoch_s, min(o.epoch_s) AS nxt FROM (SELECT DISTINCT receiver_account AS acc, epoch_s FROM ledger) i JOIN ledger o ON o.sender_account=i.acc AND o.epoch_s>=i.epoch_s GROUP BY 1,2), mm AS (SELECT nxt//60-epoch_s//60 AS m FROM nx) SELECT cast(CASE " + " ".join(f"WHEN m<{g} THEN {i}" for i, g in enumerate(profile.GAPS)) + f" ELSE {len(profile.GAPS)} END as int) AS bucket, count(*) AS n FROM mm GROUP BY 1")
_q("profile_inversions", lambda s, d: profile.inversions(ledger(s, d)), " SELECT count(*) AS inversions FROM (SELECT epoch_s, lag(epoch_s) OVER (ORDER BY row_id) AS p FROM ledger) WHERE epoch_s<p")
_q("profile_party_roles", lambda s, d: profile.party_roles(ledger(s, d)), ' SELECT count(*) FILTER (WHERE o=1 AND i=0) AS only_send, count(*) FILTER (WHERE o=0 AND i=1) AS only_receive, count(*) FILTER (WHERE o=1 AND i=1) AS "both" FROM (SELECT acc, max(is_out) AS o, max(is_in) AS i FROM e GROUP BY 1)')
_q("profile_keyword_counts", lambda s, d: profile.keyword_counts(ledger(s, d)), " " + " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) FILTER (WHERE contains(lower(narration), '{k}')) AS n FROM ledger" for k in profile.KEYWORDS))
_q("profile_address_classes", lambda s, d: profile.address_classes(ledger(s, d)), " SELECT " + ", ".join("count(*) FILTER (WHERE " + " OR ".join(f"ip_address LIKE '{p}%'" for p in some) + f") AS {k}" for k, some in profile.ADDRESS_PREFIXES.items()) + ", count(distinct ip_address) AS addresses FROM ledger")
_q("profile_samples", lambda s, d: profile.samples(ledger(s, d)), " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", cast({c} as varchar) AS value FROM ledger WHERE {c} IS NOT NULL ORDER BY value LIMIT 3)" for c in profile.COLUMNS) + ")")
_TOP = lambda k, c, n: f"SELECT * FROM (SELECT '{k}' AS list, {c} AS value, count(*) AS n FROM ledger GROUP BY 2 ORDER BY n DESC, value NULLS LAST LIMIT {n})"
_q("profile_top_lists", lambda s, d: profile.top_lists(ledger(s, d)), " " + " UNION ALL ".join([_TOP("incoming", "receiver_account", 5), _TOP("outgoing", "sender_account", 5), _TOP("narration", "narration", 10)]))
_q("profile_hours", lambda s, d: profile.hours(ledger(s, d)), " SELECT epoch_s//3600%24 AS hour, count(*) AS n, cast(sum(amount_paise) as bigint) AS paise, epoch_s//3600%24<6 AS night FROM ledger GROUP BY 1,4")
_RAW = lambda rows: rows.select(F.when(F.col("row_id") % 9 == 0, "n/a").otherwise((F.col("amount_paise") / 100).cast("decimal(20,2)").cast("string")).alias("Amount"), F.when(F.col("row_id") % 13 == 0, "soon").otherwise("2026-09-15 00:00:00").alias("Timestamp"), F.when(F.col("row_id") % 17 == 0, "x").otherwise("BANK0123456").alias("Sender_IFSC"), "transaction_id").withColumnRenamed("transaction_id", "Transaction_ID")
_q("profile_casts", lambda s, d: profile.casts(_RAW(ledger(s, d))), " SELECT count(*) AS rows, count(*) FILTER (WHERE row_id%9=0) AS no_number, count(*) FILTER (WHERE row_id%13=0) AS no_time, count(*) FILTER (WHERE row_id%17=0) AS other_ifsc, 0::bigint AS other_id FROM ledger")
_q("explorer_pages", lambda s, d: explore.explorer_pages(ledger(s, d), explore.explorer_filter(payment_mode="neft", start_s=100_000, end_s=800_000), 2, 300), " SELECT total, 2 AS page, 250 AS page_size, greatest(1,(total+249)//250) AS total_pages, (total+249)//250>2 AS has_next, true AS has_previous FROM (SELECT count(*) AS total FROM ledger WHERE payment_mode='NEFT' AND epoch_s BETWEEN 100000 AND 800000)")
_q("reconcile_totals", lambda s, d: profile.compare_totals(ledger(s, d), ledger(s, d).where("row_id % 777 <> 5")), """, t AS (SELECT row_id%777<>5 AS k, * FROM ledger), f AS (SELECT unnest(['rows','paise','least','greatest','ids','null_sender_account','null_receiver_account','null_amount_paise','null_epoch_s','null_device_type']) AS figure, unnest([count(*), cast(sum(amount_paise) as bigint), min(amount_paise), max(amount_paise), count(distinct transaction_id), 0, 0, 0, 0, 0]) AS a,
  unnest([count(*) FILTER (WHERE k), cast(sum(amount_paise) FILTER (WHERE k) as bigint), min(amount_paise) FILTER (WHERE k), max(amount_paise) FILTER (WHERE k), count(distinct transaction_id) FILTER (WHERE k), 0, 0, 0, 0, 0]) AS b FROM t) SELECT figure, a, b, a=b AS same FROM f""")
_q("profile_day_counts", lambda s, d: ledger(s, d).groupBy(F.floor(F.col("epoch_s") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("paise")), " SELECT epoch_s//86400 AS day, count(*) AS n, cast(sum(amount_paise) as bigint) AS paise FROM ledger GROUP BY 1")
_q("validate_category", lambda s, d: profile.validation(ledger(s, d)), f" SELECT *, CASE WHEN rows>={profile.FULL_SCALE} AND no_time=0 AND no_device=0 THEN 'A' WHEN rows<{profile.FULL_SCALE} THEN 'B' WHEN no_time=rows OR no_device=rows THEN 'C' ELSE 'D' END AS category FROM (SELECT count(*) AS rows, count(*)-count(distinct transaction_id) AS surplus_ids, count(*) FILTER (WHERE NOT (regexp_matches(sender_ifsc,'{profile.IFSC}') AND regexp_matches(receiver_ifsc,'{profile.IFSC}'))) AS bad_ifsc, 0::bigint AS bad_ip, count(*) FILTER (WHERE amount_paise<=0) AS bad_amount, count(*) FILTER (WHERE sender_account=receiver_account) AS self_transfers, count(*) FILTER (WHERE epoch_s IS NULL) AS no_time, count(*) FILTER (WHERE device_type IS NULL) AS no_device FROM ledger)")
_q("reconcile_self", lambda s, d: profile.reconcile(ledger(s, d), ledger(s, d).withColumn("amount_paise", F.col("amount_paise") + F.when(F.col("row_id") % 1000 == 0, 9).otherwise(0)).where("row_id % 777 <> 5")), " SELECT count(*) FILTER (WHERE row_id%777<>5) AS matched, count(*) FILTER (WHERE row_id%777<>5 AND row_id%1000=0) AS mismatched, count(*) FILTER (WHERE row_id%777=5) AS only_a, 0::bigint AS only_b FROM ledger")
