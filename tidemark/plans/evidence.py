"""Evidence: an investigation of one account, its snapshot and digest, a diary, and checks of written narratives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..operators.graph import attribution_trace, terminals
from ..operators.roles import investigation_label
from ..operators.velocity import velocity_events
from .explore import party


def by_name(column: Column, kind: T.DataType) -> Column:
    """The value with the fields of all its structs, nested ones too, in the order of their names."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[by_name(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(column.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: by_name(x, kind.elementType))
    return column


def canonical(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON text of a row's columns, all of them unless some are named, with fields by name at every level; null fields are kept."""
    kind = T.StructType([df.schema[c] for c in columns or df.columns])
    fields = F.struct(*[by_name(F.col(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    return F.to_json(fields, {"ignoreNullFields": "false"})


def short_id(prefix: str, hashed: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(hashed, 1, 8)))


#: Transfers, velocity events and different addresses or branch codes that an investigation lists.
TRANSFERS, EVENTS, LISTED = 100, 20, 100


def _listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: the first LISTED different values in order, as an array, and how many there are. They are counted before they are gathered."""
    different = rows.select(value.alias("v")).where("v IS NOT NULL").distinct()
    first = different.orderBy("v").limit(LISTED).agg(F.array_sort(F.collect_list("v")).alias(f"{name}s"))
    return first.crossJoin(different.agg(F.count(F.lit(1)).alias(f"{name}_count")))


def account_summary(ledger: DataFrame, account: str) -> DataFrame:
    """One row: payment_modes (mode, n), ifscs, ip_addresses and devices of an account's transfers, each list with how many different values there are."""
    own = ledger.where(party(account))
    ifsc = F.when(F.col("sender_account") == account, F.col("sender_ifsc")).otherwise(F.col("receiver_ifsc"))
    modes = own.where("payment_mode IS NOT NULL").groupBy("payment_mode").agg(F.count(F.lit(1)).alias("n"))
    listed = modes.orderBy("payment_mode").limit(LISTED).agg(F.array_sort(F.collect_list(F.struct(F.col("payment_mode").alias("mode"), "n"))).alias("payment_modes"))
    for value, name in ((ifsc, "ifsc"), (F.col("ip_address"), "ip_address"), (F.col("device_type"), "device")):
        listed = listed.crossJoin(_listed(own, value, name))
    return listed.withColumnsRenamed({"ip_addresss": "ip_addresses"})


def investigation(ledger: DataFrame, accounts: DataFrame, account: str, settings: Settings = Settings(), edges: DataFrame | None = None) -> DataFrame:
    """One row: profile, what the account used, roles, risk, velocity with its first events, first transfers with their direction, the trace's figures, cycles and reason, terminals, warnings and an id made from them.

    edges: the account's trace, if it is known.
    """
    if edges is None:
        edges = attribution_trace(ledger, account, config=settings.trace)
    ends = terminals(edges).where(F.col("destination_account") != account)
    paise = lambda c: F.coalesce(F.sum(F.when(c, F.col("attributed_paise"))), F.lit(0))
    traced = edges.agg(
        F.count(F.lit(1)).alias("edge_count"), F.count_if(F.col("hop") == 1).alias("root_edges"), paise(F.col("hop") == 1).alias("root_paise"), paise(F.col("hop") > 1).alias("downstream_paise"),
        F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"), F.max("truncation_reason").alias("truncation_reason"), F.coalesce(F.max("hop"), F.lit(0)).alias("hops"),
        F.array_sort(F.collect_set(F.when(F.col("cycle"), F.array_join("path", " -> ")))).alias("cycles"),
    )
    risky = accounts.select(F.col("account_number").alias("destination_account"), "mule_risk_index", "risk_band", investigation_label().alias("role"))
    listed = ends.join(risky, "destination_account", "left").agg(F.array_sort(F.collect_list(F.struct((-F.col("attributed_paise")).alias("order"), "destination_account", "attributed_paise", "max_hop", "mule_risk_index", "risk_band", "role"))).alias("terminals"))
    way = F.when(F.col("sender_account") == account, "OUTGOING").otherwise("INCOMING").alias("direction")
    first = ledger.where(party(account)).orderBy("epoch_s", "row_id").limit(TRANSFERS).agg(F.sort_array(F.collect_list(F.struct("epoch_s", "row_id", "transaction_id", "sender_account", "receiver_account", "amount_paise", "payment_mode", "ip_address", "device_type", way))).alias("transfers"))
    quick = velocity_events(ledger, account, settings.velocity, EVENTS).agg(F.array_sort(F.collect_list(F.struct("out_s", "out_row", "in_s", "in_row", "delay_s", "attributed_paise"))).alias("velocity_events"))
    who = accounts.where(F.col("account_number") == account).select(
        "account_number", "incoming_volume", "outgoing_volume", "net_flow_delta", "incoming_txn_count", "outgoing_txn_count", "transaction_count", "unique_counterparties", "fan_in", "fan_out",
        F.col("first_seen_timestamp").cast("string").alias("first_activity"), F.col("last_seen_timestamp").cast("string").alias("last_activity"),
        "mule_risk_index", "risk_band", "risk_family_scores", "risk_reasons", investigation_label().alias("role"), "layer1_candidate", "layer2_candidate", "layer3_candidate",
        F.transform(F.concat("layer1_reasons", "layer2_reasons", "layer3_reasons"), lambda r: r["code"]).alias("role_reasons"),
        "pass_through_candidate", F.coalesce("pass_through_ratio", F.lit(0.0)).alias("pass_through_ratio"), F.coalesce("pass_through_event_count", F.lit(0)).alias("pass_through_event_count"),
        F.coalesce("pass_through_attributed_volume", F.lit(0.0)).alias("pass_through_attributed_volume"), F.coalesce("pass_through_outgoing_transaction_count", F.lit(0)).alias("pass_through_outgoing_transaction_count"), "median_incoming_to_outgoing_seconds",
    )
    whole = who
    for one in (account_summary(ledger, account), traced, listed, first, quick):
        whole = whole.crossJoin(F.broadcast(one))
    warnings = F.filter(F.array(F.when(F.col("truncated"), "The trace was cut at a limit."), F.when(F.col("edge_count") == 0, "No money was traced."), F.when(F.size("cycles") > 0, "Money came back to accounts on its path."), F.lit("Sums over hops are propagation, not separate money.")), lambda x: x.isNotNull())
    whole = whole.withColumn("warnings", warnings)
    return whole.withColumn("investigation_id", short_id("INV-", F.sha2(canonical(whole, ["account_number", "edge_count", "root_paise", "downstream_paise", "terminals"]), 256)))


def case_file(inv: DataFrame) -> DataFrame:
    """The snapshot as canonical JSON (fields by name at every level) with its digest and id."""
    return inv.select(canonical(inv).alias("snapshot")).withColumn("sha256", F.sha2("snapshot", 256)).withColumn("case_id", short_id("CASE-", F.col("sha256")))


#: The categories, codes, sources and provenance of the facts that have one row each.
FACTS = (
    ("SUBJECT", "ACCOUNT_NUMBER", "account_number", "RAW"),
    ("SUBJECT", "OBSERVED_INFLOW", "account_summary.observed_incoming_volume", "RAW"),
    ("SUBJECT", "OBSERVED_OUTFLOW", "account_summary.observed_outgoing_volume", "RAW"),
    ("SUBJECT", "NET_FLOW_DELTA", "account_summary.observed_net_flow_delta", "RAW"),
    ("SUBJECT", "INCOMING_TX_COUNT", "account_summary.incoming_transaction_count", "RAW"),
    ("SUBJECT", "OUTGOING_TX_COUNT", "account_summary.outgoing_transaction_count", "RAW"),
    ("SUBJECT", "UNIQUE_COUNTERPARTIES", "account_summary.unique_counterparties", "RAW"),
    ("SUBJECT", "UNIQUE_IPS", "account_summary.unique_ip_count", "RAW"),
    ("SUBJECT", "UNIQUE_DEVICES", "account_summary.unique_device_count", "RAW"),
    ("SUBJECT", "FIRST_ACTIVITY", "account_summary.first_observed_timestamp", "RAW"),
    ("SUBJECT", "LAST_ACTIVITY", "account_summary.last_observed_timestamp", "RAW"),
    ("SUBJECT", "PAYMENT_MODES", "account_summary.payment_modes", "RAW"),
    ("SUBJECT", "ASSOCIATED_IFSCS", "account_summary.associated_ifscs", "RAW"),
    ("SUBJECT", "ASSOCIATED_IPS", "account_summary.associated_ips", "RAW"),
    ("RISK", "RISK_INDEX", "risk.risk_index", "DERIVED"),
    ("ROLE", "L1_COLLECTOR", "roles.l1_collector_candidate", "DERIVED"),
    ("ROLE", "L2_DISTRIBUTOR", "roles.l2_distributor_candidate", "DERIVED"),
    ("ROLE", "L3_TERMINAL", "roles.l3_terminal_candidate", "DERIVED"),
    ("ROLE", "PRIMARY_ROLE", "roles.primary_role_label", "DERIVED"),
    ("ROLE", "CLASSIFICATION_REASONS", "roles.classification_reasons", "DERIVED"),
    ("VELOCITY", "PASS_THROUGH_CANDIDATE", "velocity.pass_through_candidate", "DERIVED"),
    ("VELOCITY", "ATTRIBUTED_VOLUME", "velocity.attributed_volume", "DERIVED"),
    ("VELOCITY", "MEDIAN_DELAY", "velocity.median_delay_seconds", "DERIVED"),
    ("VELOCITY", "WINDOW_DEFINITION", "velocity.window_description", "DERIVED"),
    ("ATTRIBUTION", "ROOT_SEED_OUTFLOW", "trace.edges[edge_type=ROOT_SEED]", "ATTRIBUTED"),
    ("ATTRIBUTION", "DOWNSTREAM_FIFO", "trace.edges[edge_type=FIFO_ATTRIBUTION]", "ATTRIBUTED"),
    ("ATTRIBUTION", "MAX_HOPS", "trace.total_hops_found", "ATTRIBUTED"),
    ("ATTRIBUTION", "TRUNCATED", "trace.truncated", "ATTRIBUTED"),
    ("ATTRIBUTION", "CYCLES_DETECTED", "trace.cycles_detected", "ATTRIBUTED"),
    ("PROVENANCE", "DATASET", "data_provenance.dataset_sha256", "RAW"),
    ("PROVENANCE", "INVESTIGATION_ID", "investigation_id", "RAW"),
)
#: Fixed value: how the window of pass-through events is described.
WINDOW = "3_TO_15_MINUTES"
#: How many of the first transfers, the terminals, and an account's addresses and codes the facts name.
TRANSFER_FACTS, TERMINAL_FACTS, NAMED = 5, 10, 10


def _plain(x: Column, scale: int = 2) -> Column:
    """A double as plain decimal text."""
    return x.cast(f"decimal(20,{scale})").cast("string")


def _fact_values() -> dict[str, tuple[Column, str]]:
    """By code: the value as text, null where there is no such fact, and what is said before it."""
    text, joined = lambda c: F.col(c).cast("string"), lambda c: F.nullif(F.array_join(F.slice(c, 1, NAMED), ", "), F.lit(""))
    modes = F.nullif(F.array_join(F.transform("payment_modes", lambda m: F.concat(m["mode"], F.lit(": "), m["n"].cast("string"))), ", "), F.lit(""))
    rupees = lambda c: _plain(F.col(c) / 100)
    return {
        "ACCOUNT_NUMBER": (text("account_number"), "The account is"), "OBSERVED_INFLOW": (_plain(F.col("incoming_volume")), "Rupees that came in"), "OBSERVED_OUTFLOW": (_plain(F.col("outgoing_volume")), "Rupees that went out"),
        "NET_FLOW_DELTA": (_plain(F.col("net_flow_delta")), "Inflow less outflow, which is no balance"), "INCOMING_TX_COUNT": (text("incoming_txn_count"), "Transfers that came in"), "OUTGOING_TX_COUNT": (text("outgoing_txn_count"), "Transfers that went out"),
        "UNIQUE_COUNTERPARTIES": (text("unique_counterparties"), "Different counterparties"), "UNIQUE_IPS": (text("ip_address_count"), "Different addresses"), "UNIQUE_DEVICES": (text("device_count"), "Different kinds of devices"),
        "FIRST_ACTIVITY": (text("first_activity"), "First seen"), "LAST_ACTIVITY": (text("last_activity"), "Last seen"), "PAYMENT_MODES": (modes, "Transfers by payment mode"),
        "ASSOCIATED_IFSCS": (joined("ifscs"), "Its branch codes, the first of them"), "ASSOCIATED_IPS": (joined("ip_addresses"), "Its addresses, the first of them"),
        "RISK_INDEX": (F.concat_ws(" ", _plain(F.col("mule_risk_index"), 1), "risk_band"), "Risk index, an indicator and no finding of law"),
        "L1_COLLECTOR": (text("layer1_candidate"), "Candidate for a collector"), "L2_DISTRIBUTOR": (text("layer2_candidate"), "Candidate for a distributor"), "L3_TERMINAL": (text("layer3_candidate"), "Candidate for a terminal"),
        "PRIMARY_ROLE": (text("role"), "Role"), "CLASSIFICATION_REASONS": (F.nullif(F.array_join("role_reasons", ", "), F.lit("")), "Signals for its roles"),
        "PASS_THROUGH_CANDIDATE": (text("pass_through_candidate"), "Candidate for quick pass-through"), "ATTRIBUTED_VOLUME": (_plain(F.col("pass_through_attributed_volume")), "Rupees passed on within the window"),
        "MEDIAN_DELAY": (_plain(F.col("median_incoming_to_outgoing_seconds"), 1), "Median seconds from inflow to outflow"), "WINDOW_DEFINITION": (F.lit(WINDOW), "The window of pass-through"),
        "ROOT_SEED_OUTFLOW": (rupees("root_paise"), "Rupees that left the account itself"), "DOWNSTREAM_FIFO": (rupees("downstream_paise"), "Rupees passed on over later hops, the same money again"),
        "MAX_HOPS": (text("hops"), "Hops traced"), "TRUNCATED": (F.concat_ws(" ", text("truncated"), "truncation_reason"), "The trace was cut at a limit"), "CYCLES_DETECTED": (F.nullif(F.array_join("cycles", ", "), F.lit("")), "Closed paths"),
        "DATASET": (F.concat_ws(" ", text("dataset_rows"), "dataset_sha256"), "Rows and digest of the ledger"), "INVESTIGATION_ID": (text("investigation_id"), "Investigation"),
    }


def dataset(ledger: DataFrame) -> DataFrame:
    """One row: dataset_rows, and dataset_sha256, a digest of the ledger's rows whatever their order: each row is hashed, and the hashes are added up."""
    row = F.xxhash64(*[F.col(c) for c in sorted(ledger.columns)])
    return ledger.agg(F.count(F.lit(1)).alias("dataset_rows"), F.sha2(F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("dataset_sha256"))


#: The order of the facts' groups.
_GROUPS = {"SUBJECT": 0, "TRANSACTION": 1, "RISK": 2, "ROLE": 3, "VELOCITY": 4, "ATTRIBUTION": 5, "PROVENANCE": 6}


def facts(inv: DataFrame, about: DataFrame) -> DataFrame:
    """(fact, category, code, statement, value, source, provenance): what an investigation says, one fact a row, numbered from 1.

    Of maps and arrays each entry is a fact: the risk's families and reasons, the first transfers, the terminals. Facts without
    a value are left out. about: dataset(ledger).
    """
    def row(category: str, place: Column, code: Column, words: Column | str, value: Column, source: Column, origin: str) -> Column:
        said = F.concat_ws(": ", F.lit(words) if isinstance(words, str) else words, value)
        return F.struct(F.lit(_GROUPS[category]).alias("g"), place.cast("int").alias("i"), F.lit(category).alias("category"), code.alias("code"), said.alias("statement"), value.alias("value"), source.alias("source"), F.lit(origin).alias("provenance"))

    values = _fact_values()
    own = F.array(*[row(c, F.lit(i if code != "RISK_INDEX" else -1), F.lit(code), values[code][1], values[code][0], F.lit(source), origin) for i, (c, code, source, origin) in enumerate(FACTS)])
    text = lambda x: x.cast("string")
    moved = F.transform(F.slice("transfers", 1, TRANSFER_FACTS), lambda t, i: row("TRANSACTION", i, F.concat(F.lit("TX_"), F.substring(t["transaction_id"], 1, 8)), F.concat(t["direction"], F.lit(" "), t["transaction_id"], F.lit(" from "), t["sender_account"], F.lit(" to "), t["receiver_account"]), _plain(t["amount_paise"] / 100), F.concat(F.lit("transaction:"), t["transaction_id"], F.lit(":row:"), text(t["row_id"])), "RAW"))
    families = F.transform(F.array_sort(F.map_entries("risk_family_scores")), lambda e, i: row("RISK", i, F.concat(F.lit("RISK_FAMILY_"), e["key"]), F.lit("Points of a family of signals"), _plain(e["value"], 1), F.concat(F.lit("risk.risk_family_scores."), e["key"]), "DERIVED"))
    reasons = F.transform("risk_reasons", lambda r, i: row("RISK", i + 100, F.concat(F.lit("RISK_REASON_"), r["code"]), r["description"], _plain(r["points"], 1), F.concat(F.lit("risk.risk_reasons."), r["code"]), "DERIVED"))
    ended = F.transform(F.slice("terminals", 1, TERMINAL_FACTS), lambda t, i: row("ATTRIBUTION", i + 100, F.concat(F.lit("TERMINAL_"), t["destination_account"]), F.concat(F.lit("Money ends at hop "), text(t["max_hop"])), _plain(t["attributed_paise"] / 100), F.concat(F.lit("terminals."), t["destination_account"]), "ATTRIBUTED"))
    rows = inv.crossJoin(F.broadcast(about)).select(F.inline(F.filter(F.concat(own, moved, families, reasons, ended), lambda f: f["value"].isNotNull())))
    # one account's facts, some hundred at most
    return rows.withColumn("fact", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("g", "i", "code"))).select("fact", "category", "code", "statement", "value", "source", "provenance")


def chronology(inv: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, event_type, epoch_s, row_id, hop, detail): what happened in a case, in one order of events with and without a time.

    The case's opening comes first; then, by second and row, its transfers, the attributed hops (edges of the trace) and the
    velocity events; then the terminals by hop, the finding of risk and the finding of roles. Numbers are given by one window
    over one case, whose lists have limits.
    """
    none = F.lit(None)

    def kind(rows: DataFrame, name: str, order: int, s: Column, r: Column, d: Column, hop: Column = none) -> DataFrame:
        return rows.select(F.lit(order).alias("order"), F.lit(name).alias("event_type"), s.cast("long").alias("epoch_s"), r.cast("long").alias("row_id"), hop.cast("int").alias("hop"), d.cast("string").alias("detail"))

    within, text = lambda c: inv.select(F.inline(c)), lambda c: F.col(c).cast("string")
    roles = F.filter(F.array(*[F.when(F.col(f"layer{i}_candidate"), F.lit(n)) for i, n in ((1, "L1-COLLECTOR"), (2, "L2-DISTRIBUTOR"), (3, "L3-TERMINAL"))]), lambda x: x.isNotNull())
    # a hop has the place of the money that it passes on
    source = F.coalesce("source_row_id", "destination_row_id")
    parts = [
        kind(inv, "CASE_OPENED", 0, none, none, F.col("investigation_id")),
        kind(within("transfers"), "ROOT_TRANSACTION", 1, F.col("epoch_s"), F.col("row_id"), F.concat_ws(" ", "direction", "transaction_id", text("amount_paise"))),
        kind(edges, "ATTRIBUTION_HOP", 1, F.col("epoch_s") - F.col("delay_s"), source, F.concat_ws(" ", "account", "destination_account", text("destination_row_id"), text("attributed_paise")), F.col("hop")),
        kind(within("velocity_events"), "VELOCITY_EVENT", 1, F.col("out_s"), F.col("out_row"), F.concat_ws(" ", text("in_row"), text("delay_s"), text("attributed_paise"))),
        kind(within("terminals"), "TERMINAL_ACCOUNT", 2, none, none, F.concat_ws(" ", "destination_account", text("attributed_paise"), "role"), F.col("max_hop")),
        kind(inv, "RISK_FINDING", 3, none, none, F.concat_ws(" ", _plain(F.col("mule_risk_index"), 1), "risk_band")),
        kind(inv, "ROLE_FINDING", 4, none, none, F.concat_ws(" ", F.col("role"), F.array_join(roles, ","), F.concat_ws(":", text("fan_in"), text("fan_out")))),
    ]
    rows = reduce(DataFrame.union, parts)
    first = lambda c: F.coalesce(c, F.lit(-1))
    numbered = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("order", first("epoch_s"), first("row_id"), first("hop"), "event_type", "detail"))
    return rows.select(numbered.alias("entry"), "event_type", "epoch_s", "row_id", "hop", "detail")


#: Sections that a narrative must have.
SECTIONS = ("Investigative Overview", "Subject Account Activity", "Investigative Limitations")


def narrative(inv: DataFrame) -> DataFrame:
    """(account_number, text): a narrative of an investigation from its figures alone, with the sections that a check asks for, and paragraphs on flow, roles, velocity, the trace and its ends."""
    money = lambda c: F.format_number(c, 2)
    text = lambda c: F.col(c).cast("string")
    when = lambda c, *words: F.when(c, F.concat(*[F.lit(w) if isinstance(w, str) else F.coalesce(w, F.lit("unknown")) for w in words])).otherwise("")
    ended = F.array_join(F.transform(F.slice("terminals", 1, TERMINAL_FACTS), lambda t: F.concat(t["destination_account"], F.lit(" (hop "), t["max_hop"].cast("string"), F.lit(", INR "), money(t["attributed_paise"] / 100), F.lit(")"))), ", ")
    parts = (
        (SECTIONS[0], ("Account ", F.col("account_number"), " has the role ", F.col("role"), ", the risk index ", _plain(F.col("mule_risk_index"), 1), " and the risk band ", F.col("risk_band"), ".")),
        (SECTIONS[1], ("INR ", money(F.col("incoming_volume")), " came in by ", text("incoming_txn_count"), " transfers and INR ", money(F.col("outgoing_volume")), " went out by ", text("outgoing_txn_count"), ", with ", text("unique_counterparties"), " counterparties.")),
        ("Roles", ("Fan-in is ", text("fan_in"), ", fan-out ", text("fan_out"), ".", when(F.size("role_reasons") > 0, " Signals: ", F.array_join("role_reasons", ", "), "."))),
        ("Velocity", ("Within the window ", F.lit(WINDOW), " INR ", money(F.col("pass_through_attributed_volume")), " passed through in ", text("pass_through_event_count"), " events.", when(F.col("median_incoming_to_outgoing_seconds").isNotNull(), " The median delay is ", _plain(F.col("median_incoming_to_outgoing_seconds"), 1), " seconds."))),
        ("Attribution", ("INR ", money(F.col("root_paise") / 100), " left the account on traced paths; INR ", money(F.col("downstream_paise") / 100), " was passed on over ", text("hops"), " hops.", when(F.size("terminals") > 0, " It ends at ", ended, "."))),
        (SECTIONS[2], ("Sums over hops are the same money again. ", when(F.col("truncated"), "The trace was cut at a limit (", F.col("truncation_reason"), "). "), when(F.size("cycles") > 0, "Money came back on ", F.size("cycles").cast("string"), " paths. "), "Indicators are no legal finding.")),
    )
    said = [F.concat(F.lit(f"{head}\n"), *[F.lit(w) if isinstance(w, str) else F.coalesce(w, F.lit("unknown")) for w in words]) for head, words in parts]
    return inv.select("account_number", F.concat_ws("\n\n", *said).alias("text"))


def findings(accounts: DataFrame, account: str, top: int = 5) -> DataFrame:
    """The account's reasons with most points first."""
    own = accounts.where(F.col("account_number") == account).select(F.explode("risk_reasons").alias("r")).select("r.code", "r.family", "r.points", "r.description")
    return own.orderBy(F.desc("points"), "code").limit(top)


def legal_evidence(inv: DataFrame) -> DataFrame:
    """A draft's evidence: placeholders stand for what nobody has entered."""
    blank = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("[TO BE FILLED]")).alias(c)
    kept = inv.select(
        blank("account_number"), blank("role"), blank("risk_band"), "incoming_volume", "outgoing_volume", "transaction_count", "root_paise", "downstream_paise", "hops", "truncated",
        F.transform(F.slice("terminals", 1, TERMINAL_FACTS), lambda t: t["destination_account"]).alias("terminal_accounts"), F.size("transfers").alias("transfers_listed"), "warnings", "investigation_id",
        F.lit("[TO BE FILLED]").alias("officer"), F.lit("[TO BE FILLED]").alias("reference"), F.lit("[TO BE FILLED]").alias("bank_branch"),
    )
    return kept.withColumn("sha256", F.sha2(canonical(kept), 256)).withColumn("draft_id", short_id("DRAFT-", F.col("sha256")))


#: What an account number looks like in text.
ACCOUNT = r"\b([A-Z]{2,6}[0-9]{8,12})\b"
#: Legal conclusions that a narrative must not draw, in any case of letters.
FORBIDDEN = (
    r"\bcommitted\s+fraud\b",
    r"\bproves?\s+(?:criminal|guilt|fraud)\b",
    r"\bis\s+guilty\b",
    r"\bmust\s+be\s+arrested\b",
    r"\bmust\s+be\s+frozen\b",
    r"\blaundered\s+money\b",
    r"\bcriminal\s+intent\b",
    r"\billegal\s+activity\s+confirmed\b",
)


def check_narratives(texts: DataFrame, known: list[str], text: str = "text", sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """texts with unknown_accounts (mentioned, but not among the known ones), forbidden (does it draw a legal conclusion?), violations and passes.

    violations lists unknown accounts, each forbidden pattern that is met, and each section that is missing; null texts are empty.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(given, F.lit(ACCOUNT), 1)))
    allowed = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    unknown = F.array_except(found, allowed)
    legal = [F.when(given.rlike(f"(?i){p}"), F.lit(f"LEGAL_CONCLUSION: {p}")) for p in FORBIDDEN]
    absent = [F.when(~given.contains(x), F.lit(f"MISSING_SECTION: {x}")) for x in sections]
    named = F.when(F.size(unknown) > 0, F.concat(F.lit("UNKNOWN_ACCOUNTS: "), F.array_join(unknown, ", ")))
    violations = F.filter(F.array(named, *legal, *absent), lambda x: x.isNotNull())
    checked = texts.withColumns({"unknown_accounts": unknown, "forbidden": given.rlike("(?i)" + "|".join(FORBIDDEN)), "violations": violations})
    return checked.withColumn("passes", F.size("violations") == 0)


def save_packages(df: DataFrame, path: str) -> None:
    """Packages (a row each, with case_id) as JSON; adds to what is there."""
    df.write.mode("append").json(path)


def load_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def get_package(spark: SparkSession, path: str, case_id: str) -> DataFrame:
    """The package of that id; no row if there is none."""
    return load_packages(spark, path).where(F.col("case_id") == case_id)


def has_package(spark: SparkSession, path: str, case_id: str) -> bool:
    return get_package(spark, path, case_id).limit(1).count() == 1


def list_packages(spark: SparkSession, path: str) -> DataFrame:
    """The ids of all packages."""
    return load_packages(spark, path).select("case_id").distinct().orderBy("case_id")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report's rows as one JSON or CSV (with a header) file in a folder, in place of what is there. Reports have as many rows as policies or figures."""
    out = df.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
    else:
        out.json(path)
