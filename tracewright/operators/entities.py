"""Entity resolution, identifier lookups and dossiers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import identifiers as ids
from tracewright.functions import scores
from tracewright.functions.similarity import may_reach, sorted_tokens, subsequence_ratio
from tracewright.operators.components import connected_components
from tracewright.session import staged

#: The kinds of keys, in the order in which they name an entity.
KINDS = ("phone", "account", "imei", "ip", "device")


def key(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{kind}:"), value))


def record_keys(bank: DataFrame, calls: DataFrame, sessions: DataFrame, link_public_ip: bool = True) -> DataFrame:
    """One array of keys for each party of each record."""
    parts = [
        bank.select(F.array(key("phone", ids.norm_phone(f"{s}_Phone_Number")), key("phone", ids.upi_phone_any(f"{s}_UPI_ID")), key("account", ids.known(f"{s}_Account_Number"))).alias("keys"))
        for s in ("Sender", "Receiver")
    ]
    parts.append(calls.select(F.array(key("phone", ids.norm_phone("Caller_MSISDN")), key("imei", ids.norm_imei("IMEI"))).alias("keys")))
    parts.append(calls.select(F.array(key("phone", ids.norm_phone("Receiver_MSISDN"))).alias("keys")))
    public = ids.norm_ip("Public_IP_Address")
    own = [key("phone", ids.norm_phone("User_MSISDN")), key("imei", ids.norm_imei("IMEI")), key("device", ids.known("Device_ID"))]
    parts.append(sessions.select(F.array(*own, *([key("ip", F.when(~ids.is_private_ip(public), public))] if link_public_ip else [])).alias("keys")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select(F.array_compact("keys").alias("keys")).where(F.size("keys") > 0)


def star_edges(records: DataFrame) -> DataFrame:
    """First key to every key of a record; the edge to itself keeps lone keys."""
    return records.select(F.col("keys")[0].alias("src"), F.explode("keys").alias("dst")).distinct()


def entity_map(edges: DataFrame) -> DataFrame:
    """(kind, value, entity_id): the components, named by their first key in the order of kinds, then of values."""
    nodes = connected_components(edges).select("node", "component")
    kind, value = F.split_part("node", F.lit(":"), F.lit(1)), F.expr("substr(node, instr(node, ':') + 1)")
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    parts = nodes.select("component", kind.alias("kind"), value.alias("value"), F.struct(order.alias("o"), F.col("node")).alias("name"))
    names = parts.groupBy("component").agg(F.min("name").alias("m")).select("component", F.col("m.node").alias("entity_id"))
    return parts.join(names, "component").select("kind", "value", "entity_id")


def weak_identifiers(bank: DataFrame, calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """(phone, kind, value) of names, cities, networks, handles and private addresses, in one pass over each source."""
    def pairs(df: DataFrame, phone: Column, **of: Column) -> DataFrame:
        listed = F.array(*(F.struct(F.lit(k.rstrip("_")).alias("kind"), v.alias("value")) for k, v in of.items()))
        return df.select(phone.alias("phone"), F.explode(listed).alias("x")).select("phone", "x.kind", "x.value")

    private = ids.norm_ip("Private_IP_Address")
    every = [
        *(pairs(bank, ids.norm_phone(f"{s}_Phone_Number"), city=ids.norm_text(f"{s}_City"), name=ids.norm_text(f"{s}_Customer_Name"), upi=ids.norm_text(f"{s}_UPI_ID")) for s in ("Sender", "Receiver")),
        pairs(calls, ids.norm_phone("Caller_MSISDN"), city=ids.norm_text("Tower_City"), network=ids.norm_text("Network_Provider"), name=ids.norm_text("Caller_Name")),
        pairs(calls, ids.norm_phone("Receiver_MSISDN"), name=ids.norm_text("Receiver_Name")),
        pairs(sessions, ids.norm_phone("User_MSISDN"), city=ids.norm_text("IP_Location_City"), name=ids.norm_text("User_Name"), ip=F.when(ids.is_private_ip(private), private)),
    ]
    found = every[0]
    for e in every[1:]:
        found = found.unionByName(e)
    return found.where("phone is not null and value is not null").distinct()


def entities(mapped: DataFrame, weak: DataFrame) -> DataFrame:
    """Per entity, sorted sets of its identifiers."""
    phones = mapped.where("kind = 'phone'").select(F.col("value").alias("phone"), "entity_id")
    every = mapped.select("entity_id", "kind", "value").unionByName(weak.join(phones, "phone").select("entity_id", "kind", "value"))
    names = {"phone": "phones", "imei": "imeis", "ip": "ips", "upi": "upis", "name": "names", "account": "accounts", "device": "devices", "city": "cities", "network": "network_providers"}
    return every.groupBy("entity_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(n) for k, n in names.items()))


def _least_common(n: Column, m: Column, threshold: float) -> Column:
    """Characters that names of these lengths have in common, in order, at least, if their ratio reaches the threshold."""
    return F.ceil(F.lit(threshold) * (n + m) / 200 - 1e-9)


def _gram_keys(rows: DataFrame, threshold: float) -> DataFrame:
    """(sorted, short, long, gram): keys of which any two names whose ratio reaches the threshold share one.

    Grams are pairs of neighbouring characters, numbered among equals. Of names
    of n and m characters that share L in order, the first has n - 1 grams; each
    of its n - L other characters spoils two, and each of the m - L others of
    the second parts one. So s = 3 L - n - m - 1 are shared at least, and for
    each length m that fits the rarest n - s grams hold a shared one. Where
    nothing need be shared, lengths alone are the key.
    """
    texts = rows.select("sorted").distinct().withColumn("n", F.length("sorted")).where("n > 0")
    each = texts.select("sorted", "n", F.explode(F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.substring(F.col("sorted"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))).alias("pair"))
    numbered = each.groupBy("sorted", "n", "pair").agg(F.count("*").alias("times")).select("sorted", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.concat(F.col("pair"), k.cast("string")))).alias("gram"))
    often = numbered.groupBy("gram").agg(F.count("*").alias("often"))
    grams = numbered.join(often, "gram").groupBy("sorted").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    low, high = threshold / (200 - threshold), (200 - threshold) / threshold
    lengths = F.sequence(F.ceil(F.col("n") * low - 1e-9).cast("int"), F.floor(F.col("n") * high + 1e-9).cast("int"))
    probes = texts.join(grams, "sorted", "left").withColumn("m", F.explode(lengths))
    shared = 3 * _least_common(F.col("n"), F.col("m"), threshold) - F.col("n") - F.col("m") - 1
    first = F.slice(F.transform("grams", lambda g: g["gram"]), F.lit(1), F.greatest(F.col("n") - F.col("shared"), F.lit(0)).cast("int"))
    keys = probes.withColumn("shared", shared).withColumn("key", F.explode(F.when(F.col("shared") > 0, first).otherwise(F.array(F.lit("")))))
    return keys.select("sorted", F.least("n", "m").alias("short"), F.greatest("n", "m").alias("long"), F.col("key").alias("gram"))


def fuzzy_pairs(names: DataFrame, threshold: float = 85.0, matches: int = 3) -> DataFrame:
    """(entity, name) rows -> pairs of different names of different entities that share a block and are alike.

    ``names``: entity_id, name, block (a city or network that both must share).
    No pair is lost: candidates share a key that all pairs of the threshold's
    ratio share, then pass a Levenshtein bound, then the exact ratio. Null and
    empty names give no pair. Per name its ``matches`` best other names stay.
    """
    rows = names.where("name is not null and block is not null").select("entity_id", "name", "block", sorted_tokens(F.col("name")).alias("sorted")).distinct()
    keys = staged(_gram_keys(rows, threshold), "keys")
    x, y = keys.alias("x"), keys.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("short", "long", "gram")]
    fits = (F.length("x.sorted") == F.col("x.short")) & (F.length("y.sorted") == F.col("x.long"))
    # names are compared once, however many entities and blocks hold them
    alike = x.join(y, same[0] & same[1] & same[2] & fits & may_reach(F.col("x.sorted"), F.col("y.sorted"), threshold)).select(F.col("x.sorted").alias("sa"), F.col("y.sorted").alias("sb")).distinct()
    scored = staged(alike.withColumn("score", subsequence_ratio("sa", "sb")).where(F.col("score") >= threshold), "alike")
    scored = scored.union(scored.select(F.col("sb"), F.col("sa"), "score")).distinct()
    left = rows.select(F.col("entity_id").alias("a"), F.col("name").alias("name_a"), F.col("block").alias("block_a"), F.col("sorted").alias("sa"))
    right = rows.select(F.col("entity_id").alias("b"), F.col("name").alias("name_b"), F.col("block").alias("block_b"), F.col("sorted").alias("sb"))
    met = left.join(scored, "sa").join(right, "sb").where("block_a = block_b and a <> b and name_a <> name_b").select("a", "name_a", "b", "name_b", "score").distinct()
    best = F.dense_rank().over(Window.partitionBy("name_a").orderBy(F.desc("score"), "name_b"))
    return met.withColumn("rank", best).where(F.col("rank") <= matches).select("a", "name_a", "b", "name_b", "score")


def resolve(bank: DataFrame, calls: DataFrame, sessions: DataFrame, fuzzy_threshold: float | None = 85.0, link_public_ip: bool = True, merge_identical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entity_map, entities): exact keys first, then alike names with a weak identifier in common."""
    mapped = staged(entity_map(star_edges(record_keys(bank, calls, sessions, link_public_ip))), "entity_map")
    weak = staged(weak_identifiers(bank, calls, sessions), "weak")
    found = staged(entities(mapped, weak), "entities")
    if fuzzy_threshold is None:
        return mapped, found
    blocks = F.concat(F.transform("cities", lambda c: F.concat(F.lit("c:"), c)), F.transform("network_providers", lambda n: F.concat(F.lit("n:"), n)))
    named = found.select("entity_id", F.explode("names").alias("name"), blocks.alias("blocks")).select("entity_id", "name", F.explode("blocks").alias("block"))
    merges = fuzzy_pairs(named, fuzzy_threshold).select("a", "b")
    if merge_identical:
        first = named.groupBy("name", "block").agg(F.min("entity_id").alias("a"))
        merges = merges.union(named.join(first, ["name", "block"]).select("a", F.col("entity_id").alias("b")))
    joined = connected_components(merges, "a", "b").select(F.col("node").alias("entity_id"), F.col("component").alias("merged"))
    mapped = staged(mapped.join(joined, "entity_id", "left").select("kind", "value", F.coalesce("merged", "entity_id").alias("entity_id")), "entity_map")
    return mapped, staged(entities(mapped, weak), "entities")


def lookup(df: DataFrame, mapped: DataFrame, steps: list[tuple[str, str]], out: str = "entity_id") -> DataFrame:
    """The first hit of (kind, column) lookups in order; the planner broadcasts the map where it is small."""
    for i, (kind, column) in enumerate(steps):
        own = mapped.where(F.col("kind") == kind).select(F.col("value").alias(f"_v{i}"), F.col("entity_id").alias(f"_e{i}"))
        df = df.join(own, F.col(column) == F.col(f"_v{i}"), "left")
    hits = [f"_e{i}" for i in range(len(steps))]
    return df.withColumn(out, F.coalesce(*hits)).drop(*hits, *(f"_v{i}" for i in range(len(steps))))


def signals(bank: DataFrame, calls: DataFrame, sessions: DataFrame, mapped: DataFrame) -> DataFrame:
    """Rows of all sources per entity: a transfer and a call once for each different party, a session once."""
    mapped = mapped.unionByName(mapped.where("kind = 'phone'").select(F.lit("caller").alias("kind"), "value", "entity_id"))
    def two(df: DataFrame, kind: str, ts: str, id_: str) -> DataFrame:
        parties = F.array_compact(F.array_distinct(F.array("e1", "e2")))
        return df.select(F.explode(parties).alias("entity_id"), F.lit(kind).alias("kind"), F.col(ts).alias("ts"), F.col(id_).alias("id"), ids.is_injected(id_).alias("injected"))

    b = bank.select("Transaction_ID", "Timestamp", *(c.alias(f"{s}{k}") for s in ("Sender", "Receiver") for k, c in (("_p", ids.norm_phone(f"{s}_Phone_Number")), ("_a", ids.known(f"{s}_Account_Number")), ("_u", ids.upi_phone_any(f"{s}_UPI_ID")))))
    for s, out in (("Sender", "e1"), ("Receiver", "e2")):
        b = lookup(b, mapped, [("phone", f"{s}_p"), ("account", f"{s}_a"), ("caller", f"{s}_u")], out)
    c = calls.select("CDR_ID", "Call_Start_Time", ids.norm_phone("Caller_MSISDN").alias("p1"), ids.norm_phone("Receiver_MSISDN").alias("p2"), ids.norm_imei("IMEI").alias("i"))
    c = lookup(lookup(c, mapped, [("phone", "p1"), ("imei", "i")], "e1"), mapped, [("phone", "p2"), ("imei", "i")], "e2")
    s = lookup(sessions.select("IPDR_ID", "Session_Start_Time", ids.norm_phone("User_MSISDN").alias("p"), ids.norm_imei("IMEI").alias("i"), ids.norm_ip("Public_IP_Address").alias("ip")), mapped, [("phone", "p"), ("imei", "i"), ("ip", "ip")], "e1").withColumn("e2", F.col("e1"))
    return two(b, "bank", "Timestamp", "Transaction_ID").unionByName(two(c, "call", "Call_Start_Time", "CDR_ID")).unionByName(two(s, "session", "Session_Start_Time", "IPDR_ID"))


def entity_risk(fusion: DataFrame, mules: DataFrame, farms: DataFrame, travel: DataFrame, hideouts: DataFrame) -> DataFrame:
    """entity_id, score and tier: sums of fusion, mule and farm risk, 100 a journey, 75 a hideout. Inputs: (entity_id, points)."""
    # each part is summed by itself first: what they share a shuffle for is narrow, and a row an entity and part
    of = lambda df: df.groupBy("entity_id").agg(F.sum(F.col("points").cast("double")).alias("points"))
    parts = [of(df).select("entity_id", "points", F.lit(n).alias("part")) for n, df in (("fusion", fusion), ("mule", mules), ("farm", farms), ("travel", travel), ("hideout", hideouts))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # one shuffle instead of five joins
    by = [F.coalesce(F.sum(F.when(F.col("part") == n, F.col("points"))), F.lit(0.0)).alias(n) for n in ("fusion", "mule", "farm", "travel", "hideout")]
    summed = every.groupBy("entity_id").agg(*by, F.round(F.sum("points"), 2).alias("score"))
    return summed.withColumn("tier", scores.report_tier(F.col("score")))


#: Report limits, of windows in the timeline and of numbers shown for a handset.
TIMELINE, SHOWN = 10, 5
NOT_FOUND = "*Not found in dataset*"


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def money(c: str) -> Column:
    return F.format_number(F.col(c), 2)


def account_lines(mules: DataFrame) -> DataFrame:
    """entity_id and a line for each of its accounts, the riskiest first. ``mules``: those columns and entity_id."""
    text = _line("| ", F.col("account"), " | ", F.coalesce("bank_name", F.lit("")), " | ", money("money_in"), " | ", money("money_out"), " | ", F.col("in_degree").cast("string"), " | ", F.col("out_degree").cast("string"), " | ", money("risk_score"), " |")
    return _lines(mules, text, "accounts_table", F.struct((-F.col("risk_score")).alias("by"), "account"))


def handset_lines(farms: DataFrame) -> DataFrame:
    """entity_id and a line for each of its handsets. ``farms``: imei, sim_count, msisdns, risk_tier, risk_score and entity_id."""
    some = _line(F.array_join(F.slice("msisdns", 1, SHOWN), ", "), F.when(F.size("msisdns") > SHOWN, "...").otherwise(""))
    text = _line("| ", F.col("imei"), " | ", F.col("sim_count").cast("string"), " | ", some, " | ", F.upper("risk_tier"), " | ", money("risk_score"), " |")
    return _lines(farms, text, "handsets_table", F.struct((-F.col("risk_score")).alias("by"), "imei"))


def timeline_lines(windows: DataFrame) -> DataFrame:
    """entity_id and a line for each of its first TIMELINE windows, by risk, then time."""
    order = F.struct((-F.col("risk_score")).alias("by"), "window_start")
    text = _line(ids.iso_time("window_start"), " to ", ids.iso_time("window_end"), ": risk ", F.col("risk_score").cast("string"), ", ", *chain.from_iterable((F.col(f"{k}_count").cast("string"), f" {k}" + (", " if k != "session" else "")) for k in ("bank", "call", "session")), F.when(F.col("is_injected"), " (injected)").otherwise(""))
    return _lines(windows, text, "timeline", order, TIMELINE)


def _lines(df: DataFrame, text: Column, name: str, order: Column, most: int | None = None) -> DataFrame:
    rows = df.select(F.col("entity_id").cast("string").alias("entity_id"), order.alias("o"), text.alias("text"))
    if most:
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("o"))).where(F.col("place") <= most)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("o", "text"))), lambda x: x["text"])
    return rows.groupBy("entity_id").agg(F.array_join(listed, "\n").alias(name))


#: What an investigator is told to do, by part of the risk that is there.
ADVICE = {
    "mule": "Freeze or watch the accounts above, and trace who receives from them.",
    "fusion": "Ask for call and session records of the 30 days before the windows above.",
    "hideout": "Watch the shared places.",
    "farm": "Seize the shared handsets.",
    "travel": "Check who holds the subscriptions that were in two places.",
}


def dossier(found: DataFrame, risk: DataFrame, mules: DataFrame | None = None, farms: DataFrame | None = None, windows: DataFrame | None = None, day: str = "20250101") -> DataFrame:
    """entity_id, report_id and the report of every entity, as Markdown, in one plan.

    A: who it is. B: score, tier and the parts of the score. C: its accounts,
    handsets and addresses. D: its first windows. E: what to do. ``mules``,
    ``farms`` and ``windows``: the detectors' rows with entity_id; parts
    without rows are left out.
    """
    rows = found.join(risk, "entity_id", "left")
    tables = {"accounts_table": mules is not None and account_lines(mules), "handsets_table": farms is not None and handset_lines(farms), "timeline": windows is not None and timeline_lines(windows)}
    for name, df in tables.items():
        rows = rows.join(df, "entity_id", "left") if df else rows.withColumn(name, F.lit(None).cast("string"))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NOT_FOUND)
    known = [(t, c) for t, c in (("Phones", "phones"), ("Accounts", "accounts"), ("Handles", "upis"), ("Handsets", "imeis"), ("Names", "names"), ("Cities", "cities")) if c in found.columns]
    report = F.concat(F.lit(f"STR-{day}-"), F.substring("entity_id", 1, 16))
    parts = [("windows of several sources", "fusion"), ("pass-through accounts", "mule"), ("shared handsets", "farm"), ("impossible journeys", "travel"), ("shared places", "hideout")]
    if_any = lambda title, c: F.when(c.isNotNull(), F.concat(F.lit(f"{title}\n"), c))
    ips = F.when(F.size("ips") > 0, F.concat(F.lit("- "), F.array_join(F.sort_array("ips"), "\n- "))) if "ips" in found.columns else F.lit(None).cast("string")
    advice = F.concat_ws("\n", *(F.when(F.col(p) > 0, f"- {text}") for p, text in ADVICE.items()))
    lines = [
        F.concat(F.lit("# Suspicious transaction report "), report), F.lit("## A. Subject"), *(F.concat(F.lit(f"| {t} | "), listed(c), F.lit(" |")) for t, c in known),
        F.lit("## B. Grounds"), F.concat(F.lit("Score "), F.format_number(F.coalesce("score", F.lit(0.0)), 2), F.lit(", tier "), F.coalesce("tier", F.lit("LOW"))),
        *(F.concat(F.lit(f"- {t}: "), F.format_number(F.coalesce(c, F.lit(0.0)), 2)) for t, c in parts),
        F.lit("## C. Traces"), if_any("| Account | Bank | In | Out | Senders | Receivers | Risk |\n|---|---|---|---|---|---|---|", F.col("accounts_table")), if_any("| Handset | Numbers | Some of them | Tier | Risk |\n|---|---|---|---|---|", F.col("handsets_table")), if_any("Addresses", ips),
        if_any("## D. Timeline", F.col("timeline")),
        F.lit("## E. Next steps"), F.when(advice == "", "- Nothing was found by rule; look at the subject by hand.").otherwise(advice),
    ]
    body = F.concat_ws("\n", *lines)  # leaves out the parts that are null
    return rows.select("entity_id", report.alias("report_id"), F.concat(body, F.lit("\n\nIntegrity: "), F.substring(F.sha2(F.concat(report, body), 256), 1, 16)).alias("report"))


def report_of(dossiers: DataFrame, entity_id: str | None = None) -> DataFrame:
    """One row: the entity's report, that of the first entity if none is named, or a message in its place."""
    wanted = F.lit(entity_id) if entity_id is not None else None
    rows = dossiers.where(F.col("entity_id") == wanted) if entity_id is not None else dossiers
    one = rows.agg(F.min_by(F.struct("entity_id", "report"), "entity_id").alias("r"))
    message = F.concat(F.lit("Entity "), wanted, F.lit(" not found")) if entity_id is not None else F.lit("No entities")
    return one.select(F.coalesce(F.col("r.entity_id"), wanted if entity_id is not None else F.lit(None).cast("string")).alias("entity_id"), F.coalesce("r.report", message).alias("report"))
