"""Views for exploring a ledger and its accounts: summaries, search, lists, pages and the timeline."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.roles import role_label
from ..sources.ledger import START, with_ts


def ledger_summary(ledger: DataFrame) -> DataFrame:
    parties = ledger.select(F.explode(F.array("sender_account", "receiver_account")).alias("a")).where("a IS NOT NULL")
    totals = ledger.agg(F.count(F.lit(1)).alias("transactions"), F.countDistinct("transaction_id").alias("distinct_ids"), F.sum("amount_paise").alias("total_paise"), F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s"))
    return totals.crossJoin(parties.agg(F.countDistinct("a").alias("accounts")))


def distribution(ledger: DataFrame, column: str) -> DataFrame:
    """Counts by value with their share in percent."""
    counts = ledger.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def party(account: str) -> Column:
    return (F.col("sender_account") == account) | (F.col("receiver_account") == account)


def account_search(dimension: DataFrame, q: str = "", limit: int = 20) -> DataFrame:
    """Accounts whose number contains q, in any case, busiest first; limit is clamped to 1..100."""
    return dimension.where(F.col("account_number").ilike(f"%{q.strip()}%")).orderBy(F.desc("transaction_count"), "account_number").limit(max(1, min(100, limit)))


#: Values that account_detail lists of each kind at most.
DETAILS = 1_000


def account_values(ledger: DataFrame, account: str, kind: str) -> DataFrame:
    """(value, n): the different values of an account's transfers, of kind "payment_mode", "ip_address", "device_type" or "ifsc" (its own branch codes), and how often they occur; a row each."""
    ifsc = F.when(F.col("sender_account") == account, F.col("sender_ifsc")).otherwise(F.col("receiver_ifsc"))
    value = ifsc if kind == "ifsc" else F.col(kind)
    return ledger.where(party(account)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value IS NOT NULL")


def account_detail(ledger: DataFrame, dimension: DataFrame, account: str, listed: int = DETAILS) -> DataFrame:
    """One row: the dimension's columns and the modes, branch codes and addresses of the account, the first `listed` of each in order; none if it is unknown.

    All different values, as rows, are account_values(); the dimension has their numbers.
    """
    out = dimension.where(F.col("account_number") == account)
    for kind, name in (("payment_mode", "payment_modes"), ("ifsc", "ifscs"), ("ip_address", "ip_addresses")):
        first = account_values(ledger, account, kind).orderBy("value").limit(listed)
        out = out.crossJoin(F.broadcast(first.agg(F.array_sort(F.collect_list("value")).alias(name))))
    return out


def account_ledger(ledger: DataFrame, account: str, direction: str = "all", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of an account's transfers by amount, greatest first."""
    side = {"in": F.col("receiver_account") == account, "out": F.col("sender_account") == account, "all": party(account)}[direction]
    return ledger.where(side).orderBy(F.desc_nulls_last("amount_paise"), "row_id").offset(offset).limit(limit)


SORTS = {"risk": "mule_risk_index", "inflow": "incoming_volume", "outflow": "outgoing_volume", "transactions": "transaction_count", "fan_in": "fan_in", "fan_out": "fan_out", "velocity": "pass_through_ratio"}


def mule_list(accounts: DataFrame, role: str = "ALL", band: str = "ALL", velocity_only: bool = False, predicted_only: bool = False, stage: str = "ALL", min_risk: float | None = None, sort_by: str = "risk", order: str = "desc", limit: int = 50, offset: int = 0) -> DataFrame:
    """Filtered, sorted and paged candidates; unknown sort keys are errors, ties go by account, nulls last."""
    roles = {"L1": F.col("layer1_candidate"), "L2": F.col("layer2_candidate"), "L3": F.col("layer3_candidate"), "ANY": F.col("layer1_candidate") | F.col("layer2_candidate") | F.col("layer3_candidate")}
    tests = [roles[role]] if role != "ALL" else []
    if band != "ALL":
        tests.append(F.col("risk_band") == band)
    if velocity_only:
        tests.append(F.col("pass_through_candidate"))
    if predicted_only:
        tests.append(F.col("predicted_mule_candidate"))
    if stage != "ALL":
        tests.append(F.col("syndicate_stage") == stage)
    if min_risk is not None:
        tests.append(F.col("mule_risk_index") >= min_risk)
    key = F.col(SORTS[sort_by])
    rows = accounts.where(reduce(and_, tests, F.lit(True))).withColumn("role", role_label())
    return rows.orderBy(key.desc_nulls_last() if order == "desc" else key.asc_nulls_last(), "account_number").offset(offset).limit(min(200, limit))


def mule_summary(accounts: DataFrame, high: float = 70.0) -> DataFrame:
    return accounts.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if("layer1_candidate").alias("layer1"),
        F.count_if("layer2_candidate").alias("layer2"),
        F.count_if("layer3_candidate").alias("layer3"),
        F.count_if("pass_through_candidate").alias("velocity"),
        F.count_if("predicted_mule_candidate").alias("predicted"),
        F.count_if(F.col("mule_risk_index") >= high).alias("high_risk_count"),
    )


def explorer_filter(account=None, sender=None, receiver=None, transaction_id=None, ip=None, narration=None, min_paise=None, max_paise=None, start_s=None, end_s=None, payment_mode=None, device_type=None, sender_ifsc=None, receiver_ifsc=None) -> Column:
    """Fourteen optional tests, all of which must hold. A full id (12 characters, TXN…) is matched exactly, a part of one anywhere."""
    col, tests = F.col, []
    part = lambda c, x: col(c).ilike(f"%{x.strip()}%")
    exact = {"sender_account": sender, "receiver_account": receiver, "sender_ifsc": sender_ifsc, "receiver_ifsc": receiver_ifsc}
    tests += [col(c) == x.strip().upper() for c, x in exact.items() if x]
    if account:
        tests.append(party(account.strip().upper()))
    if transaction_id:
        t = transaction_id.strip().upper()
        tests.append(col("transaction_id") == t if len(t) == 12 and t.startswith("TXN") else part("transaction_id", t))
    tests += [part(c, x) for c, x in (("ip_address", ip), ("narration", narration)) if x]
    tests += [col(c) >= x for c, x in (("amount_paise", min_paise), ("epoch_s", start_s)) if x is not None]
    tests += [col(c) <= x for c, x in (("amount_paise", max_paise), ("epoch_s", end_s)) if x is not None]
    if payment_mode and payment_mode.lower() != "all":
        tests.append(col("payment_mode") == payment_mode.upper())
    if device_type and device_type.lower() != "all":
        tests.append(col("device_type") == device_type)
    return reduce(and_, tests, F.lit(True))


def explorer_page(ledger: DataFrame, test: Column, sort_by: str = "timestamp", order: str = "desc", page: int = 1, size: int = 50) -> DataFrame:
    """A page of matching transfers, with a flag for ids that the page repeats; size is clamped to 1..250."""
    size = max(1, min(250, size))
    key = F.col({"timestamp": "epoch_s", "amount": "amount_paise", "transaction_id": "transaction_id"}[sort_by])
    ties = [F.desc("epoch_s"), F.asc("row_id")]
    rows = ledger.where(test).orderBy(key.desc() if order == "desc" else key.asc(), *ties).offset((max(1, page) - 1) * size).limit(size)
    ids = ledger.join(F.broadcast(rows.select("transaction_id").distinct()), "transaction_id", "left_semi").groupBy("transaction_id").agg((F.count(F.lit(1)) > 1).alias("is_duplicate_id"))
    return rows.join(F.broadcast(ids), "transaction_id", "left")


def explorer_pages(ledger: DataFrame, test: Column, page: int = 1, size: int = 50) -> DataFrame:
    """One row: matching transfers, the page and its size, pages in all, and whether there is one after and before."""
    page, size = max(1, page), max(1, min(250, size))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    counted = ledger.where(test).agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", pages)
    return counted.select("total", F.lit(page).alias("page"), F.lit(size).alias("page_size"), "total_pages", (F.col("total_pages") > page).alias("has_next"), F.lit(page > 1).alias("has_previous"))


def duplicate_ids(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row_id")).where("n > 1")


def enriched(ledger: DataFrame, accounts: DataFrame, rows: Column) -> DataFrame:
    """Chosen transfers with role and risk of both parties and how often their id occurs. Chosen rows are looked up before they are joined."""
    wanted = ledger.where(rows)
    named = accounts.select("account_number", "mule_risk_index", role_label().alias("role"))
    side = lambda s: named.select(F.col("account_number").alias(f"{s}_account"), F.col("mule_risk_index").alias(f"{s}_risk"), F.col("role").alias(f"{s}_role"))
    same = ledger.join(wanted.select("transaction_id").distinct(), "transaction_id", "left_semi").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("same_id"))
    return wanted.join(side("sender"), "sender_account", "left").join(side("receiver"), "receiver_account", "left").join(same, "transaction_id", "left")


def stable_id(text: str) -> Column:
    """row_N or digits name a row, anything else an id."""
    number = text.strip().lower().removeprefix("row_")
    return F.col("row_id") == int(number) if number.isdigit() else F.col("transaction_id") == text.strip().upper()


#: Transfers in a timeline at most: of one account, and where no account is given.
OWN_CAP, GLOBAL_CAP = 5000, 1000


def _timeline_test(account: str | None, direction: str, payment_mode: str, device_type: str, start_s: int | None, end_s: int | None) -> Column:
    tests = [F.col("epoch_s") >= start_s] if start_s is not None else []
    if end_s is not None:
        tests.append(F.col("epoch_s") <= end_s)
    if account:
        tests.append({"in": F.col("receiver_account") == account, "out": F.col("sender_account") == account}.get(direction.lower(), party(account)))
    if payment_mode.lower() != "all":
        tests.append(F.col("payment_mode") == payment_mode.upper())
    if device_type.lower() != "all":
        tests.append(F.col("device_type") == device_type)
    return reduce(and_, tests, F.lit(True))


def timeline(ledger: DataFrame, accounts: DataFrame, pairs: DataFrame, edges: DataFrame, account: str | None, start: str = START, cap: int | None = None, direction: str = "all", payment_mode: str = "all", device_type: str = "all", event_type: str = "all", start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """Events of one account: its first `cap` transfers, velocity pairs, attributions, the risk when first seen, and when last seen a terminal role and no other.

    The window (seconds, ends included) holds for all events; direction, mode and device choose transfers only. Without
    an account there are transfers alone, all of them observed. Columns: event_id, event_type, epoch_s, row_id, direction,
    amount_paise, counterparty, and truncated, which says of transfers whether the cap left some out; ordered by time, row and id.
    """
    kind = lambda df, name, **c: df.select(*[c.get(k, F.lit(None).cast(t)).alias(k) for k, t in (("event_id", "string"), ("epoch_s", "long"), ("row_id", "long"), ("direction", "string"), ("amount_paise", "long"), ("counterparty", "string"), ("truncated", "boolean"))], F.lit(name).alias("event_type"))
    text = lambda head, *cols: F.concat_ws("_", F.lit(head), *[F.col(c).cast("string") for c in cols])
    most = cap or (OWN_CAP if account else GLOBAL_CAP)
    # one transfer more than the cap tells whether there are more
    probed = ledger.where(_timeline_test(account, direction, payment_mode, device_type, start_s, end_s)).orderBy("epoch_s", "row_id").limit(most + 1)
    chosen = probed.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > most).orderBy("epoch_s", "row_id").limit(most)
    into = F.coalesce(F.col("receiver_account") == account, F.lit(False)) if account else F.lit(False)
    way = F.when(into, "INCOMING").otherwise("OUTGOING") if account else F.lit("OBSERVED")
    parts = [kind(chosen, "TRANSACTION", event_id=text("TX", "row_id"), epoch_s=F.col("epoch_s"), row_id=F.col("row_id"), direction=way, amount_paise=F.col("amount_paise"), counterparty=F.when(into, F.col("sender_account")).otherwise(F.col("receiver_account")), truncated=F.col("truncated"))]
    if account:
        seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) - F.unix_seconds(F.lit(start).cast("timestamp"))
        one = accounts.where(F.col("account_number") == account)
        alone = F.col("layer3_candidate") & ~F.col("layer1_candidate") & ~F.col("layer2_candidate")
        others = [
            kind(pairs.where(F.col("acc") == account), "VELOCITY", event_id=text("VEL", "in_row", "out_row"), epoch_s=F.col("out_s"), row_id=F.col("out_row"), direction=F.lit("OUTGOING"), amount_paise=F.least("in_paise", "out_paise")),
            kind(edges.where(F.col("account") == account), "ATTRIBUTION", event_id=text("ATTR", "source_row_id", "destination_row_id"), epoch_s=F.col("destination_epoch_s"), row_id=F.col("destination_row_id"), direction=F.lit("OUTGOING"), amount_paise=F.col("attributed_paise"), counterparty=F.col("destination_account")),
            kind(one, "RISK_ROLE", event_id=text("RISK", "account_number"), epoch_s=seconds("first_seen_timestamp")),
            kind(one.where(alone), "TERMINAL", event_id=text("TERM", "account_number"), epoch_s=seconds("last_seen_timestamp")),
        ]
        parts += [o.where(_timeline_test(None, "all", "all", "all", start_s, end_s)) for o in others]
    events = reduce(DataFrame.unionByName, parts)
    if event_type.lower() != "all":
        events = events.where(F.col("event_type") == event_type.upper())
    return events.orderBy("epoch_s", F.coalesce("row_id", F.lit(-1)), "event_id")


def timeline_page(events: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """A page of a timeline's events, each with the number of all events and whether more follow; size is clamped to 1..250."""
    page, size = max(1, page), max(1, min(250, size))
    rows = events.orderBy("epoch_s", F.coalesce("row_id", F.lit(-1)), "event_id").offset((page - 1) * size).limit(size)
    total = events.agg(F.count(F.lit(1)).alias("total_events"))
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_events") > page * size)


def event_counts(events: DataFrame) -> DataFrame:
    """How many events of each kind a timeline has."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def timeline_summary(ledger: DataFrame, account: str) -> DataFrame:
    into = F.col("receiver_account") == account
    own = ledger.where(party(account))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_paise"))), F.lit(0)).cast("long")
    return own.agg(F.count(F.lit(1)).alias("n"), total(into).alias("in_paise"), total(F.col("sender_account") == account).alias("out_paise"), F.min("epoch_s").alias("first_s"), F.max("epoch_s").alias("last_s"))
