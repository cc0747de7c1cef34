"""Profiles and validation of a ledger."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..sources.ledger import entity_view
from .evidence import canonical

COLUMNS = ("row_id", "transaction_id", "sender_account", "receiver_account", "amount_paise", "epoch_s", "payment_mode", "narration", "ip_address", "device_type")
#: Words that are looked for in narrations, and prefixes of addresses.
KEYWORDS = ("crypto", "usdt", "binance", "p2p", "paxful", "telegram", "wallet", "commission", "task", "refund")
ADDRESS_PREFIXES = {"ip_185": ("185.",), "ip_194": ("194.",), "private": ("10.", "192.168.", "172.16.")}


def columns(ledger: DataFrame) -> DataFrame:
    """One row a column: rows, non-null, distinct, least and greatest as text.

    One pass counts and finds the ends of all columns. Different values are counted in a second pass over all columns but
    row_id, which is a key: rows (column, value) are reduced before they are shuffled, so no column is scanned alone.
    """
    text = {c: F.col(c).cast("string") for c in COLUMNS}
    ends = ledger.agg(F.count(F.lit(1)).alias("rows"), *[f(x).alias(f"{n}_{c}") for c, x in text.items() for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    per = ends.select("rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("non_null"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("greatest")) for c in COLUMNS])))
    listed = F.array(*[F.struct(F.lit(c).alias("column"), x.alias("v")) for c, x in text.items() if c != "row_id"])
    different = ledger.select(F.inline(listed)).where("v IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    of_key = F.when(F.col("column") == "row_id", F.col("non_null")).otherwise(F.coalesce("distinct", F.lit(0)))
    return per.join(F.broadcast(different), "column", "left").select("column", "rows", "non_null", of_key.alias("distinct"), "least", "greatest")


def samples(ledger: DataFrame, n: int = 3) -> DataFrame:
    """(column, value): the n least different values of each column, as text."""
    least = [ledger.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value").limit(n) for c in COLUMNS]
    return reduce(DataFrame.unionByName, least)


def top_values(ledger: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values of a column and their counts; ties go by value."""
    return ledger.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def top_lists(ledger: DataFrame) -> DataFrame:
    """(list, value, n): the five accounts that most transfers go to and come from, and the ten most frequent narrations."""
    lists = {"incoming": ("receiver_account", 5), "outgoing": ("sender_account", 5), "narration": ("narration", 10)}
    return reduce(DataFrame.unionByName, [top_values(ledger, c, n).select(F.lit(k).alias("list"), "value", "n") for k, (c, n) in lists.items()])


def hours(ledger: DataFrame) -> DataFrame:
    """Transfers and amounts by hour of the day, and whether the hour is one of the night (0 to 5)."""
    hour = F.floor(F.col("epoch_s") / 3600) % 24
    return ledger.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").alias("paise")).withColumn("night", F.col("hour") < 6)


def casts(raw: DataFrame) -> DataFrame:
    """One row: texts of a raw ledger's Amount and Timestamp that are no number or time, and account numbers and branch codes of another form."""
    given = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull()
    fails = lambda c, kind: F.count_if(given(c) & F.col(c).cast("string").try_cast(kind).isNull())
    differs = lambda c, form: F.count_if(given(c) & ~F.col(c).cast("string").rlike(form))
    return raw.agg(F.count(F.lit(1)).alias("rows"), fails("Amount", "double").alias("no_number"), fails("Timestamp", "timestamp").alias("no_time"), differs("Sender_IFSC", IFSC).alias("other_ifsc"), differs("Transaction_ID", "^TXN[0-9]+$").alias("other_id"))


def amount_percentiles(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """Exact, interpolated percentiles of amounts, of all rows or by a column, found by ranks of counted values."""
    points = {f"p{round(100 * p)}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}
    aggs = (F.min("amount_paise").alias("least"), F.max("amount_paise").alias("greatest"))
    if by is None:
        return ledger.agg(*aggs).join(exact_quantiles(ledger, [], "amount_paise", points), F.lit(True), "left").select("least", *points, "greatest")
    found = exact_quantiles(ledger, [by], "amount_paise", points).withColumnRenamed(by, "_by")
    return ledger.groupBy(by).agg(*aggs).join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "least", *points, "greatest")


def degree_percentiles(ledger: DataFrame) -> DataFrame:
    """Percentiles of how many partners accounts have, for senders' receivers and receivers' senders."""
    pairs = ledger.select("sender_account", "receiver_account").distinct()
    degree = lambda acc, name: pairs.groupBy(acc).agg(F.count(F.lit(1)).alias("d")).select(F.lit(name).alias("side"), "d")
    both = degree("sender_account", "out").unionByName(degree("receiver_account", "in"))
    found = exact_quantiles(both, ["side"], "d", {f"p{round(100 * p)}": p for p in (0.5, 0.9, 0.95, 0.99)})
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("accounts"), F.max("d").alias("greatest")).join(found, "side").select("side", "accounts", "p50", "p90", "p95", "p99", "greatest")


#: Upper ends in minutes of the buckets of time between an inflow and the next outflow.
GAPS = (1, 3, 5, 15, 30, 60, 180, 360, 720, 1440)


def gap_histogram(ledger: DataFrame) -> DataFrame:
    """How soon an account pays out after money comes in: eleven buckets of whole minutes.

    The next outflow at or after each distinct time of an inflow is found by one ordered window over an account's seconds,
    not by joining the sides. Minutes are counted by the clock's minute boundaries.
    """
    both = F.array(F.struct(F.col("receiver_account").alias("acc"), F.lit(0).alias("side")), F.struct(F.col("sender_account").alias("acc"), F.lit(1).alias("side")))
    events = ledger.select("epoch_s", F.inline(both)).groupBy("acc", "epoch_s").agg(F.min("side").alias("first"), F.max("side").alias("last"))
    ahead = Window.partitionBy("acc").orderBy("epoch_s").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nexts = events.withColumn("next", F.min(F.when(F.col("last") == 1, F.col("epoch_s"))).over(ahead)).where("first = 0 AND next IS NOT NULL").select("acc", "epoch_s", "next")
    minutes = F.floor(F.col("next") / 60) - F.floor(F.col("epoch_s") / 60)
    bucket = F.lit(len(GAPS))
    for i in reversed(range(len(GAPS))):
        bucket = F.when(minutes < GAPS[i], F.lit(i)).otherwise(bucket)
    return nexts.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def inversions(ledger: DataFrame, size: int = 1_000_000) -> DataFrame:
    """One row: neighbours in row order whose times go backwards, counted in ranges of `size` row numbers with one look across each border."""
    dealt = ledger.select("row_id", "epoch_s", F.floor(F.col("row_id") / size).alias("part"))
    inside = dealt.withColumn("before", F.lag("epoch_s").over(Window.partitionBy("part").orderBy("row_id")))
    per = inside.groupBy("part").agg(F.count_if(F.col("epoch_s") < F.col("before")).alias("n"), F.min_by("epoch_s", "row_id").alias("first"), F.max_by("epoch_s", "row_id").alias("last"))
    across = per.withColumn("before", F.lag("last").over(Window.orderBy("part")))  # as many rows as ranges
    return across.agg((F.coalesce(F.sum("n"), F.lit(0)) + F.count_if(F.col("first") < F.col("before"))).alias("inversions"))


def party_roles(ledger: DataFrame) -> DataFrame:
    """Accounts that only send, only receive, or do both."""
    e = entity_view(ledger).groupBy("acc").agg(F.max("is_out").alias("o"), F.max("is_in").alias("i"))
    return e.agg(F.count_if(F.expr("o = 1 AND i = 0")).alias("only_send"), F.count_if(F.expr("o = 0 AND i = 1")).alias("only_receive"), F.count_if(F.expr("o = 1 AND i = 1")).alias("both"))


def keyword_counts(ledger: DataFrame) -> DataFrame:
    low = F.lower("narration")
    sums = ledger.agg(*[F.count_if(low.contains(k)).alias(f"k{i}") for i, k in enumerate(KEYWORDS)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{i}").alias("n")) for i, k in enumerate(KEYWORDS)])))


def address_classes(ledger: DataFrame) -> DataFrame:
    """One row: addresses with each of the prefixes, and how many there are."""
    begins = lambda some: reduce(or_, [F.col("ip_address").startswith(p) for p in some])
    return ledger.agg(*[F.count_if(begins(some)).alias(k) for k, some in ADDRESS_PREFIXES.items()], F.countDistinct("ip_address").alias("addresses"))


#: Rows from which a ledger counts as full scale (a fixed value), and the form of a branch code.
FULL_SCALE, IFSC = 2_000_000, "^[A-Z]{4}0[A-Z0-9]{6}$"
NEEDED = ("transaction_id", "sender_account", "receiver_account", "sender_ifsc", "receiver_ifsc", "amount_paise", "epoch_s", "payment_mode", "narration", "ip_address", "device_type")


def validation(ledger: DataFrame) -> DataFrame:
    """One row of checks and a category by fidelity and scale.

    A: full scale, all columns there, and every row has a time and a device; B: all columns, but too few rows; C: no row
    has a time, or none a device; D: anything else.
    """
    bad = {
        "bad_ifsc": ~(F.col("sender_ifsc").rlike(IFSC) & F.col("receiver_ifsc").rlike(IFSC)),
        "bad_ip": ~F.col("ip_address").rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"),
        "bad_amount": F.col("amount_paise") <= 0,
        "self_transfers": F.col("sender_account") == F.col("receiver_account"),
        "no_time": F.col("epoch_s").isNull(),
        "no_device": F.col("device_type").isNull(),
    }
    there = set(NEEDED) <= set(ledger.columns)
    known = [c for c in NEEDED if c not in ledger.columns]
    whole = ledger.withColumns({c: F.lit(None).cast("string") for c in known}) if known else ledger
    sums = whole.agg(F.count(F.lit(1)).alias("rows"), (F.count("transaction_id") - F.countDistinct("transaction_id")).alias("surplus_ids"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()])
    all_there = F.lit(there)
    full = (F.col("rows") >= FULL_SCALE) & all_there & (F.col("no_time") == 0) & (F.col("no_device") == 0)
    none = (F.col("no_time") == F.col("rows")) | (F.col("no_device") == F.col("rows"))
    return sums.withColumn("category", F.when(full, "A").when((F.col("rows") < FULL_SCALE) & all_there, "B").when(none, "C").otherwise("D"))


def reconcile(a: DataFrame, b: DataFrame, tolerance_paise: int = 5) -> DataFrame:
    """One row: rows that both ledgers have by row_id, those whose amounts differ by more than the tolerance, rows of one only."""
    both = a.select("row_id", F.col("amount_paise").alias("x")).join(b.select("row_id", F.col("amount_paise").alias("y")), "row_id", "full")
    return both.agg(F.count_if(F.expr("x IS NOT NULL AND y IS NOT NULL")).alias("matched"), F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance_paise).alias("mismatched"), F.count_if(F.expr("y IS NULL")).alias("only_a"), F.count_if(F.expr("x IS NULL")).alias("only_b"))


def totals(ledger: DataFrame) -> DataFrame:
    """One row of figures by which two copies of a ledger are compared."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("sender_account", "receiver_account", "amount_paise", "epoch_s", "device_type")]
    return ledger.agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_paise").alias("paise"), F.min("amount_paise").alias("least"), F.max("amount_paise").alias("greatest"), F.countDistinct("transaction_id").alias("ids"), *missing)


def compare_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(figure, a, b, same): the totals of two ledgers side by side."""
    def long(df: DataFrame, name: str) -> DataFrame:
        one = totals(df)
        return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("long").alias(name)) for c in one.columns])))

    return long(a, "a").join(long(b, "b"), "figure").withColumn("same", F.col("a").eqNullSafe(F.col("b")))


def sections(ledger: DataFrame) -> dict[str, DataFrame]:
    """Every section of a ledger's profile, by name; each is a few rows, but for those by account or value."""
    return {
        "columns": columns(ledger), "samples": samples(ledger), "top_lists": top_lists(ledger), "hours": hours(ledger), "amounts": amount_percentiles(ledger), "amounts_by_mode": amount_percentiles(ledger, "payment_mode"),
        "degrees": degree_percentiles(ledger), "gaps": gap_histogram(ledger), "inversions": inversions(ledger), "party_roles": party_roles(ledger), "keywords": keyword_counts(ledger), "addresses": address_classes(ledger), "validation": validation(ledger),
    }


def report(ledger: DataFrame) -> DataFrame:
    """(section, row, content): the whole profile as one table, a section's rows as JSON in the order of their text."""
    each = [df.select(F.lit(name).alias("section"), canonical(df).alias("content")) for name, df in sections(ledger).items()]
    rows = reduce(DataFrame.unionByName, each)
    return rows.select("section", F.row_number().over(Window.partitionBy("section").orderBy("content")).alias("row"), "content")
