"""Queries over files, columns and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import identifiers as ids
from tracewright.operators import audit, entities, shaping, statements
from tracewright.plans.fragments import GEO, K, LEDGER, SIGNALS
from tracewright.plans.registry import query
from tracewright.sources import adapters as ad
from tracewright.sources import tables

# ---- files: the driver's rows written as text, and read back by the loaders

BANK_CSV = """(select 'T' || l_orderkey || '-' || l_linenumber as "Transaction_ID", cast(o_orderdate as timestamp) as "Timestamp", case when o_orderstatus = 'F' then 'SUCCESS' else 'FAILED' end as "Transaction_Status",
  case when l_partkey % 11 <> 0 then l_extendedprice end as "Transaction_Amount", (9000000000 + o_custkey)::varchar as "Sender_Phone_Number", (9000000000 + o_custkey)::varchar as "Sender_UPI_Phone", case when l_linenumber = 1 then 'Net_Banking' else 'ATM' end as "Channel", null::varchar as "Currency" from lineitem join orders on l_orderkey = o_orderkey)"""


def bank_csv(spark: SparkSession, d: str) -> str:
    lines, orders = ad.table(spark, d, "lineitem"), ad.table(spark, d, "orders")
    phone = (F.lit(9000000000) + F.col("o_custkey")).cast("string")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("Transaction_ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("Transaction_Status"),
        F.when(F.col("l_partkey") % 11 == 0, F.when(F.col("l_partkey") % 2 == 0, "NULL").otherwise("NaN")).otherwise(F.col("l_extendedprice").cast("string")).alias("Transaction_Amount"),
        F.concat(phone, F.lit(".0")).alias("Sender_Phone_Number"),
        F.concat(phone, F.lit("@ok")).alias("Sender_UPI_ID"),
        F.when(F.col("l_linenumber") == 1, "Internet_Banking").otherwise("ATM").alias("Channel"),
    )
    return ad.as_csv(rows, "bank")


@query(f"select * from {BANK_CSV}")
def csv_bank(spark, d):
    found = tables.load_bank(spark, bank_csv(spark, d))
    return found.select("Transaction_ID", "Timestamp", "Transaction_Status", "Transaction_Amount", "Sender_Phone_Number", "Sender_UPI_Phone", "Channel", "Currency")


@query(f"""select "Transaction_ID", "Timestamp", "Transaction_Amount", (left("Sender_Phone_Number", 10) || '.0')::double as "Sender_Phone_Number" from {BANK_CSV}""")
def csv_inferred(spark, d):
    return tables.read_inferred(spark, bank_csv(spark, d)).select("Transaction_ID", "Timestamp", "Transaction_Amount", "Sender_Phone_Number")


@query(f"""select 'C' || event_id as "CDR_ID", date_trunc('second', ts) as "Call_Start_Time", (9000000000 + user_id)::varchar as "Caller_MSISDN", case when {K} % 2 = 0 then (351000000000000 + user_id)::varchar end as "IMEI", {K}::bigint as "Call_Duration_Seconds", (8 + (29 * {K} % 2900) / 100.0)::double as "Latitude", null::varchar as "Subscriber_ID" from events where event_type in ('signup', 'error')""")
def csv_calls(spark, d):
    e = ad.table(spark, d, "events").where("event_type in ('signup', 'error')").withColumn("k", ad.prop())
    rows = e.select(F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("CDR_ID"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Call_Start_Time"), (F.lit(9000000000) + F.col("user_id")).cast("string").alias("Caller_MSISDN"), F.when(F.col("k") % 2 == 0, F.concat((F.lit(351000000000000) + F.col("user_id")).cast("string"), F.lit(".0"))).otherwise("NULL").alias("IMEI"), F.concat(F.col("k").cast("string"), F.lit(".0")).alias("Call_Duration_Seconds"), (8 + (29 * F.col("k") % 2900) / 100.0).alias("Latitude"))
    found = tables.load_calls(spark, ad.as_csv(rows, "calls"))
    return found.select("CDR_ID", "Call_Start_Time", "Caller_MSISDN", "IMEI", "Call_Duration_Seconds", "Latitude", "Subscriber_ID")


@query("""select 'S' || event_id as "IPDR_ID", (9000000000 + user_id)::varchar as "User_MSISDN", '49.1.' || (user_id % 256) || '.7' as "Public_IP_Address", date_trunc('second', ts) as "Session_Start_Time" from events where event_type not in ('signup', 'error', 'purchase')""")
def csv_sessions(spark, d):
    e = ad.table(spark, d, "events").where("event_type not in ('signup', 'error', 'purchase')")
    rows = e.select(F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("IPDR_ID"), F.concat((F.lit(9000000000) + F.col("user_id")).cast("string"), F.lit(".0")).alias("User_MSISDN"), F.concat(F.lit("49.1."), (F.col("user_id") % 256).cast("string"), F.lit(".7")).alias("Public_IP_Address"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Session_Start_Time"))
    return tables.load_sessions(spark, ad.as_csv(rows, "sessions")).select("IPDR_ID", "User_MSISDN", "Public_IP_Address", "Session_Start_Time")


@query("""select 'Customer ' || o_custkey as "Account_Name", o_custkey::varchar as "Account_Number", strftime(o_orderdate, '%d-%m-%Y 00:00:00') as "Date", 'UPI/' || o_orderkey as "Narration", case when o_orderstatus = 'F' then o_orderkey::varchar end as "Withdrawal", case when o_orderstatus <> 'F' then o_orderkey::varchar end as "Deposit" from orders""")
def raw_statements(spark, d):
    o = ad.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    line = F.concat_ws(",", F.date_format("o_orderdate", "dd-MM-yyyy HH:mm:ss"), F.concat(F.lit("UPI/"), key), F.when(F.col("o_orderstatus") == "F", key).otherwise(""), F.when(F.col("o_orderstatus") != "F", key).otherwise(""), F.lit("0"))
    head = F.concat(F.lit("Account Statement for: Customer "), F.col("o_custkey").cast("string"), F.lit("\nAccount Number: "), F.col("o_custkey").cast("string"), F.lit("\nRegistered Phone: 9\n----\nDate,Narration,Withdrawal,Deposit,Running_Balance\n"))
    texts = o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines")).select(F.concat(head, "lines").alias("value"))
    return tables.statements_of(texts.withColumn("file", F.lit("made"))).select("Account_Name", "Account_Number", "Date", "Narration", "Withdrawal", "Deposit")


@query("""select 'UPI' as "Transaction_Type", -o_orderkey::double as "Transaction_Amount", date_trunc('day', o_orderdate) as "Timestamp", 'c' || o_custkey || '@ok' as "Extracted_UPI_ID", 0.0::double as "Closing_Balance" from orders where o_orderkey % 5 <> 0""")
def parsed_statements(spark, d):
    o = ad.table(spark, d, "orders")
    narration = F.when(F.col("o_orderkey") % 5 == 0, "Opening Balance").otherwise(F.concat(F.lit("UPI "), F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@ok paid")))
    cells = F.array(F.date_format("o_orderdate", "dd/MM/yyyy"), narration, F.lit("1"), F.lit(""), F.format_number("o_orderkey", 2), F.lit(""), F.lit("n/a"))
    rows = o.select(F.lit("f").alias("file"), F.col("o_orderkey").alias("row_no"), cells.alias("cells"))
    header = ["Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"]
    return statements.parse_rows(rows, header).select("Transaction_Type", "Transaction_Amount", "Timestamp", "Extracted_UPI_ID", "Closing_Balance")


# ---- columns

@query("""select o_orderkey as id, o_orderdate as bank_date, o_totalprice as bank_price, case when o_orderpriority = '1-URGENT' then least(95.0 + 20, 100)::double else 95.0::double end as bank_score,
  case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'held' else o_orderstatus end as bank_status from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus is not null""")
def shaped_orders(spark, d):
    o = shaping.complete(ad.table(spark, d, "orders"), "o_orderstatus")
    o = o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.lit(95.0).alias("score"))
    o = shaping.updated(o, F.col("priority") == "1-URGENT", score=ids.raised("score", 20.0), status=F.when(F.col("status") == "F", "held").otherwise(F.col("status")))
    return shaping.first_columns(shaping.prefixed(shaping.without(o, "priority", "no_such_column"), "bank_", keep=("id",)), "id", "bank_date")


MODE = "case o_orderkey % 8 when 0 then 'UPI' when 1 then 'ATM Cash' when 2 then 'Cash Deposit' when 3 then 'NEFT' when 4 then 'RTGS' when 5 then 'POS' when 6 then 'card swipe' else 'Withdrawal' end"


@query(f"""with m as (select o_orderkey as id, {MODE} as mode, 'Shop ' || (o_custkey % 4) as shop from orders) select id, case when upper(mode) = 'UPI' then 'Mobile_App' when upper(mode) in ('ATM CASH', 'WITHDRAWAL') then 'ATM' when mode = 'Cash Deposit' then 'Branch' when mode in ('NEFT', 'RTGS') then 'Net_Banking' else 'POS' end as channel,
  case when mode = 'Cash Deposit' then 'Cash Deposit' else shop end as merchant, case when mode = 'Cash Deposit' then 'Bank' when shop = 'Shop 0' then 'Food' when shop = 'Shop 1' then 'Travel' else 'Bank' end as category from m""")
def channels_and_merchants(spark, d):
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(MODE).alias("mode"), F.concat(F.lit("Shop "), (F.col("o_custkey") % 4).cast("string")).alias("shop"))
    o = o.withColumn("merchant", ids.merchant_of("mode", "shop"))
    return o.select("id", ids.channel_of_mode("mode", "id").alias("channel"), "merchant", ids.merchant_category("merchant", {"Shop 0": "Food", "Shop 1": "Travel"}).alias("category"))


@query("""with m as (select o_orderkey as id, case o_orderkey % 6 when 0 then 'UPI' when 1 then 'IMPS' when 2 then 'NEFT' when 3 then 'ATM' when 4 then 'Cash Deposit' else 'POS' end as mode, o_orderstatus = 'F' as paid, o_orderkey::varchar as ref, 'n' || o_custkey as name from orders),
  t as (select id, case mode when 'UPI' then 'UPI-' || name || '@ok-' || ref || case when paid then '' else '-CR' end when 'IMPS' then 'IMPS-' || ref || '-' || name || case when paid then '' else '-CR' end when 'NEFT' then 'NEFT ' || case when paid then 'DR' else 'CR' end || '-' || ref || '-' || name when 'ATM' then 'ATM ' || case when paid then '' else 'REVERSAL ' end || ref when 'Cash Deposit' then case when paid then '' else 'BY ' end || 'CASH ' || ref else 'TXN ' || ref || case when paid then '' else ' CR' end end as narration, mode from m)
  select id, narration, case when mode = 'Cash Deposit' then 'CASH' when mode = 'POS' then 'OTHER' else mode end as kind from t""")
def made_narrations(spark, d):
    o = ad.table(spark, d, "orders")
    mode = F.expr("case o_orderkey % 6 when 0 then 'UPI' when 1 then 'IMPS' when 2 then 'NEFT' when 3 then 'ATM' when 4 then 'Cash Deposit' else 'POS' end")
    made = o.select(F.col("o_orderkey").alias("id"), ids.narration(mode, F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"), F.concat(F.lit("n"), F.col("o_custkey").cast("string"))).alias("narration"))
    return made.withColumn("kind", ids.transaction_type("narration"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(ts) % 1000000 = 0 then '' else '.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') end as iso from events")
def iso_times(spark, d):
    return ad.table(spark, d, "events").select("event_id", ids.iso_time("ts").alias("iso"))


# ---- lookups and first matches

@query("""select o_orderkey as id, s.c_name as sender_name, s.c_nationkey as sender_nation, r.c_name as receiver_name, r.c_nationkey as receiver_nation from orders left join customer s on s.c_custkey = o_custkey left join customer r on r.c_custkey = o_orderkey % 997""")
def transfers_with_parties(spark, d):
    master = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    rows = ad.table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 997).alias("to"))
    found = shaping.with_master(rows, master, "id", sender="o_custkey", receiver="to")
    return shaping.without(found, "o_custkey", "to").withColumnRenamed("o_orderkey", "id")


@query("select o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'unknown' end as state from orders")
def mapped_values(spark, d):
    return ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), shaping.mapped_value("o_orderstatus", {"F": "done", "O": "open"}, "unknown").alias("state"))


@query(f"""with s as {SIGNALS}, f as (select kind, entity_id, us, id, row_number() over (partition by kind, entity_id order by us, id) as place from s)
  select c.id, c.entity_id, b.id as bank_id, b.us as bank_us, i.id as session_id from s c left join f b on b.kind = 'bank' and b.entity_id = c.entity_id and b.place = 1 left join f i on i.kind = 'session' and i.entity_id = c.entity_id and i.place = 1 where c.kind = 'call' and c.injected""")
def injected_first_matches(spark, d):
    s = ad.signals(spark, d).withColumn("us", audit.micros("ts"))
    calls = s.where("kind = 'call' and injected").select("id", "entity_id")
    of = {k: s.where(F.col("kind") == k).select("entity_id", "us", "id") for k in ("bank", "session")}
    found = shaping.first_match(shaping.first_match(calls, of["bank"], "entity_id", "us", "id", prefix="bank_"), of["session"], "entity_id", "us", "id", prefix="session_")
    return found.select("id", "entity_id", "bank_id", "bank_us", "session_id")


@query(f"""with s as {SIGNALS}, c as (select distinct entity_id as account from s where injected and kind = 'bank' and entity_id % 3 = 0), f as (select entity_id as account, count(*) as n from s where kind = 'bank' and entity_id not in (select account from c) group by 1 order by n desc, account limit 50),
  p as (select account, row_number() over (order by n desc, account) as place from f) select account, 'chosen' as origin from c union all select account, 'frequent' from p where place <= 50 - (select count(*) from c)""")
def accounts_filled_up(spark, d):
    bank = ad.signals(spark, d).where("kind = 'bank'").withColumnRenamed("entity_id", "account")
    return shaping.filled_up(bank.where("injected and account % 3 = 0").select("account"), bank, "account", 50)


@query(f"with l as {LEDGER} select src, count(*) as n from l group by 1 order by n desc, src limit 10")
def most_frequent_senders(spark, d):
    return shaping.most_frequent(ad.ledger(spark, d), "src", 10)


@query(f"""with g as {GEO} select 'p' || entity_id as entity_id, ts, lat, lon, 'bank' as source, event_id::varchar as event_id, null::varchar as city from g where entity_id % 2 = 0""")
def ledger_points(spark, d):
    g = ad.geo(spark, d)
    bank = g.select(F.col("entity_id").cast("string").alias("Sender_Phone_Number"), F.col("ts").alias("Timestamp"), F.lit(0.0).alias("Receiver_Latitude"), F.col("lat").alias("Sender_Latitude"), F.col("lon").alias("Longitude"), F.col("event_id").alias("Transaction_ID"))
    phones = g.where("entity_id % 2 = 0").select(F.col("entity_id").cast("string").alias("phone"), F.concat(F.lit("p"), F.col("entity_id").cast("string")).alias("entity_id")).distinct()
    return shaping.ledger_points(bank, phones)


# ---- quality

@query(f"""with c as (select case when event_type = 'error' then 'Missed' when event_type = 'signup' then 'Incoming' else 'Outgoing' end as t, case when {K} % 10 = 3 then 'Failed' else 'Completed' end as s, case when {K} % 4 = 0 then 0 else {K} end as d, {K} + 1 + {K} % 3 as span from events)
  select count(*) filter (t = 'Missed') as missed, count(*) filter (t = 'Missed' and d = 0) as missed_without_length, count(*) filter (s = 'Failed') as failed, count(*) filter (s = 'Failed' and d = 0) as failed_without_length, count(*) filter (s = 'Completed' and t <> 'Missed') as completed, count(*) filter (s = 'Completed' and t <> 'Missed' and abs(d - span) > 1) as mismatched from c""")
def call_quality(spark, d):
    e = ad.table(spark, d, "events").withColumn("k", ad.prop())
    kind = F.when(F.col("event_type") == "error", "Missed").when(F.col("event_type") == "signup", "Incoming").otherwise("Outgoing")
    end = F.col("ts") + F.make_dt_interval(secs=(F.col("k") + 1 + F.col("k") % 3).cast("decimal(18,6)"))
    return audit.call_quality(e.select(kind.alias("Call_Type"), F.when(F.col("k") % 10 == 3, "Failed").otherwise("Completed").alias("Call_Status"), F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k")).alias("Call_Duration_Seconds"), F.col("ts").alias("Call_Start_Time"), end.alias("Call_End_Time")))


def describe_sql(table: str, column: str) -> str:
    v = f"{column}::double"
    return f"select '{column}' as column_name, count({v}) as n, round(avg({v}), 4) as mean, round(stddev_samp({v}), 4) as deviation, min({v}) as least, quantile_cont({v}, 0.25) as quarter, quantile_cont({v}, 0.5) as half, quantile_cont({v}, 0.75) as three_quarters, max({v}) as greatest from {table}"


@query(f"{describe_sql('orders', 'o_totalprice')} union all {describe_sql('orders', 'o_custkey')}")
def described_orders(spark, d):
    found = audit.described(ad.table(spark, d, "orders"), "o_totalprice", "o_custkey")
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query("select count(*) as in_chains, count(*) filter (event_type = 'error') as flagged, count(*) = count(*) filter (event_type = 'error') as agree from events where event_type = 'error'")
def reconciled_chains(spark, d):
    e = ad.table(spark, d, "events")
    chains = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("length"))
    return audit.reconciled(chains, "length", e, F.col("event_type") == "error")


@query("""select c_custkey as person, c_custkey in (select o_custkey from orders where o_orderstatus = 'P') as in_bank, c_custkey in (select user_id from events) as in_calls from customer""")
def verified_overlap(spark, d):
    persons = ad.table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_custkey").alias("phone"))
    return audit.verified_overlap(persons, bank=ad.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"), calls=ad.table(spark, d, "events").select("user_id")).drop("phone")



@query("select o_orderkey, o_custkey from orders order by md5('7:' || o_orderkey), o_orderkey limit 100")
def sampled_orders(spark, d):
    return shaping.sampled(ad.table(spark, d, "orders"), 100, "o_orderkey", seed=7).select("o_orderkey", "o_custkey")


@query("""with recursive x as (select o_orderkey as id, 0 as hop, 'c' || o_custkey as src, 'r' || o_orderkey as dst, cast(o_orderdate as timestamp) as ts, o_totalprice as amount, 'r' || o_orderkey as root from orders where o_orderstatus = 'P'
  union all select id, hop + 1, dst, root || '#' || (hop + 1), ts + to_seconds(30 + (id * 7919 + (hop + 1) * 104729) % 571), amount, root from x where hop < 4)
  select id || '-' || hop as id, src, dst, ts, round(amount * power(0.9, hop), 6) as amount from x""")
def transfer_chains(spark, d):
    o = ad.table(spark, d, "orders").where("o_orderstatus = 'P'")
    key = F.col("o_orderkey").cast("string")
    seeds = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("r"), key).alias("dst"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("amount"))
    return shaping.chains(seeds, 4)


# ---- entity resolution over three sources

#: The oracle knows the components: users share a handset by threes, and a call names the next number as receiver without linking it.
SOURCES = """u as (select distinct user_id as id from events), called as (select distinct user_id + 1 as id from events where event_type in ('signup', 'error')), c as (select distinct o_custkey as id from orders),
  p as (select id from u union select id from called union select id from c),
  e as (select p.id, 'phone:' || (9000000000 + case when p.id in (select id from u) then (select min(id) from u x where x.id // 3 = p.id // 3) else p.id end) as entity_id from p)"""


@query(f"""with {SOURCES} select 'phone' as kind, (9000000000 + id)::varchar as value, entity_id from e union all select 'account', 'A' || id, entity_id from e where id in (select id from c)
  union all select distinct 'imei', (351000000000000 + id // 3)::varchar, entity_id from e where id in (select id from u)
  union all select distinct 'ip', '49.1.' || (id // 3) || '.1', entity_id from e where id in (select user_id from events where event_type not in ('signup', 'error'))
  union all select distinct 'device', 'D' || id, entity_id from e where id in (select user_id from events where event_type not in ('signup', 'error'))""")
def resolved_identifiers(spark, d):
    return entities.resolve(*ad.investigation(spark, d), fuzzy_threshold=None)[0]


@query(f"""with {SOURCES}, s as (select user_id as id from events where event_type not in ('signup', 'error')), k as (select user_id as id from events where event_type in ('signup', 'error')),
  w as (select id, 'city' as kind, 'city ' || (id % 5) as value from c union select id, 'name', 'name ' || id from c union select id, 'upi', (9000000000 + id) || '@ok' from c union select id, 'city', 'city ' || (id % 7) from k union select id, 'network', 'net ' || (id % 4) from k union select id, 'name', 'caller ' || id from k union select id, 'ip', '10.0.0.' || id from s
  union select id, 'ip', '49.1.' || (id // 3) || '.1' from s),
  l as (select distinct entity_id, kind, value from e left join w using (id))
  select entity_id, coalesce(string_agg(value, ',' order by value) filter (kind = 'city'), '') as cities, coalesce(string_agg(value, ',' order by value) filter (kind = 'name'), '') as names, coalesce(string_agg(value, ',' order by value) filter (kind = 'upi'), '') as upis, coalesce(string_agg(value, ',' order by value) filter (kind = 'network'), '') as networks, coalesce(string_agg(value, ',' order by value) filter (kind = 'ip'), '') as ips from l group by entity_id""")
def resolved_entities(spark, d):
    found = entities.resolve(*ad.investigation(spark, d), fuzzy_threshold=None)[1]
    return found.select("entity_id", *(F.array_join(c, ",").alias(c.replace("network_providers", "networks")) for c in ("cities", "names", "upis", "network_providers", "ips")))


@query(f"""with {SOURCES}, r as (select o_custkey as id, 'bank' as kind, 0 as other from orders union all select user_id, 'call', user_id + 1 from events where event_type in ('signup', 'error') union all select user_id, 'session', 0 from events where event_type not in ('signup', 'error')),
  b as (select kind, x.entity_id, case when kind = 'call' then y.entity_id end as second from r join e x on x.id = r.id left join e y on y.id = r.other),
  l as (select kind, entity_id from b union all select kind, second from b where second <> entity_id) select entity_id, kind, count(*) as n from l group by entity_id, kind""")
def entity_signals(spark, d):
    bank, calls, sessions = ad.investigation(spark, d)
    mapped, _ = entities.resolve(bank, calls, sessions, fuzzy_threshold=None)
    return entities.signals(bank, calls, sessions, mapped).groupBy("entity_id", "kind").agg(F.count("*").alias("n"))
