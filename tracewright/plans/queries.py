"""Queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import identifiers as ids
from tracewright.operators import audit, detectors, entities, shaping
from tracewright.operators.components import connected_components
from tracewright.plans.fragments import EDGES, FARMS, GEO, K, LEDGER, MULES, ROWS, SIGNALS, alike, fused, haversine_sql
from tracewright.plans.registry import ORACLES, QUERIES, query
from tracewright.session import release, staged
from tracewright.sources import adapters as ad
from tracewright.streaming import events as streaming

@query(f"select event_id, ts, {K} as k, round(value, 2) as amount from events where event_type = 'purchase'")
def scan_typed_events(spark, d):
    return ad.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts", ad.prop().alias("k"), F.round("value", 2).alias("amount"))


@query("select count(*) as n, sum(cast(l_extendedprice as decimal(18,2)))::double as total from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def scan_orders_success(spark, d):
    return ad.ledger(spark, d).where("status = 'SUCCESS'").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""with x as (select o_orderkey as id, (9000000000 + o_custkey)::varchar || case when o_orderkey % 3 = 0 then '.0' when o_orderkey % 7 = 0 then '1' else '' end as phone,
  case when o_orderkey % 2 = 0 then (351000000000000 + o_custkey)::varchar || '.0' else o_custkey::varchar end as imei, '10.0.' || (o_orderkey % 256)::varchar || '.7' as ip, o_custkey::varchar || '9876543210@ok' as upi from orders)
  select id, case when regexp_matches(regexp_replace(phone, '\\.0$', ''), '^[0-9]{10}$') then regexp_replace(phone, '\\.0$', '') end as phone,
  case when regexp_matches(split_part(imei, '.', 1), '^[0-9]{14,}$') then split_part(imei, '.', 1) end as imei, ip,
  nullif(regexp_extract(upi, '([0-9]{10})', 1), '') as upi_any, nullif(regexp_extract(upi, '^([0-9]{10})@', 1), '') as upi_handle from x""")
def norm_identifiers(spark, d):
    o = ad.table(spark, d, "orders")
    phone = F.concat((F.lit(9000000000) + F.col("o_custkey")).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".0").when(F.col("o_orderkey") % 7 == 0, "1").otherwise(""))
    imei = F.when(F.col("o_orderkey") % 2 == 0, F.concat((F.lit(351000000000000) + F.col("o_custkey")).cast("string"), F.lit(".0"))).otherwise(F.col("o_custkey").cast("string"))
    x = o.select(F.col("o_orderkey").alias("id"), phone.alias("phone"), imei.alias("imei"), F.concat(F.lit("10.0."), (F.col("o_orderkey") % 256).cast("string"), F.lit(".7")).alias("ip"), F.concat(F.col("o_custkey").cast("string"), F.lit("9876543210@ok")).alias("upi"))
    return x.select("id", ids.norm_phone("phone").alias("phone"), ids.norm_imei("imei").alias("imei"), ids.norm_ip("ip").alias("ip"), ids.upi_phone_any("upi").alias("upi_any"), ids.upi_phone_handle("upi").alias("upi_handle"))


def keyword_sql(column: str) -> str:
    cases = " ".join(f"when {' or '.join(f'contains(lower({column}), {chr(39)}{w}{chr(39)})' for w in words)} then '{kind}'" for kind, words in ids.TRANSACTION_KEYWORDS.items())
    return f"case {cases} else 'OTHER' end"


@query(f"select doc_id, {keyword_sql('text')} as kind, nullif(lower(regexp_extract(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+')), '') as handle from documents where not regexp_matches(text, '[^\\x00-\\x7f]')")
def classify_narrations(spark, d):
    docs = ad.table(spark, d, "documents").where(~F.col("text").rlike(r"[^\x00-\x7f]"))
    return docs.select("doc_id", ids.transaction_type("text").alias("kind"), ids.extract_upi("text").alias("handle"))


@query(f"select doc_id, {keyword_sql('text')} as kind, nullif(lower(regexp_extract(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+')), '') as handle from documents")
def classify_all_narrations(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", ids.transaction_type("text").alias("kind"), ids.extract_upi("text", ascii_only=True).alias("handle"))


@query("""with x as (select l_orderkey as id, l_linenumber as line, l_partkey as part, case when l_partkey % 3 = 0 then '(' || l_quantity::bigint::varchar || ',000.50)' when l_partkey % 3 = 1 then '₹' || l_quantity::bigint::varchar else 'n/a' end as w from lineitem)
  , y as (select *, case when part % 3 = 0 then -(replace(replace(split_part(w, ')', 1), '(', ''), ',', '')::double) when part % 3 = 1 then replace(w, '₹', '')::double else 0.0 end as withdrawal from x)
  select id, line, part, withdrawal, case when withdrawal > 0 then -withdrawal when 5.0 > 0 then 5.0 else 0 end as signed from y""")
def parse_amounts(spark, d):
    q = F.col("l_quantity").cast("long").cast("string")
    w = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("("), q, F.lit(",000.50)"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("₹"), q)).otherwise("n/a")
    x = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), ids.parse_amount(w).alias("withdrawal"))
    return x.withColumn("signed", ids.signed_amount("withdrawal", F.lit(5.0)))


@query("""select o_orderkey as id, date_trunc('day', o_orderdate) as parsed from orders""")
def parse_dates(spark, d):
    day = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "d-M-yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "d MMM yyyy"))
    return ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ids.parse_date(written).alias("parsed"))


@query(f"select src::varchar as src, dst::varchar as dst, amount::double as amount, n_txn, src_bank, dst_bank from {EDGES}")
def ledger_edges(spark, d):
    return detectors.ledger_edges(ad.ledger(spark, d)).withColumn("amount", F.col("amount").cast("double"))


@query(f"with {MULES} select * from mules")
def mule_accounts_top50(spark, d):
    return detectors.mule_accounts(detectors.ledger_edges(ad.ledger(spark, d)), neighbours=False)


@query(FARMS)
def device_farms_top50(spark, d):
    return detectors.device_farms(ad.device_pairs(spark, d, "l_quantity >= 48"), lists=False)


@query(FARMS.replace(" where l_quantity >= 48", ""))
def device_farms_whole_top50(spark, d):
    return detectors.device_farms(ad.device_pairs(spark, d), lists=False)


@query(fused(1_800_000_000, ROWS.replace("WIDTH", "1800000000")))
def temporal_fusion(spark, d):
    return detectors.fusion_events(ad.signals(spark, d), 30, lists=False)


@query(fused(21_600_000_000, ROWS.replace("WIDTH", "21600000000")))
def temporal_fusion_6h(spark, d):
    return detectors.fusion_events(ad.signals(spark, d), 360, lists=False)


@query(fused(1_800_000_000, " select count(*) as events, count(*) filter (is_injected) as injected, count(distinct entity_id) as entities, sum(risk_score)::bigint as total_risk from r"))
def fusion_summary(spark, d):
    return detectors.fusion_events(ad.signals(spark, d), 30, lists=False).agg(F.count("*").alias("events"), F.count_if("is_injected").alias("injected"), F.count_distinct("entity_id").alias("entities"), F.sum("risk_score").alias("total_risk"))


@query(fused(1_800_000_000, ROWS.replace("WIDTH", "1800000000") + " order by risk_score desc, entity_id, window_start limit 20"))
def fusion_top(spark, d):
    return detectors.fusion_events(ad.signals(spark, d), 30, lists=False).orderBy(F.desc("risk_score"), "entity_id", "window_start").limit(20)


@query(f"""with p as (select *, lag(ts) over w as pts, lag(lat) over w as plat, lag(lon) over w as plon, lag(event_id) over w as pid from {GEO} window w as (partition by entity_id order by ts, event_id)),
  q as (select *, (epoch_us(ts) - epoch_us(pts)) / 3600000000.0::double as hours, {haversine_sql('plat', 'plon', 'lat', 'lon')} as km from p where pid is not null)
  select entity_id, pid as from_event, event_id as to_event, round(km, 2) as distance_km, round(hours, 4) as time_delta_hours, round(km / hours, 1) as velocity_kmh, case when km / hours > 1200 then 'critical' else 'high' end as severity
  from q where hours > 0 and km / hours > 800 and km > 100""")
def impossible_travel(spark, d):
    return detectors.impossible_travel(ad.geo(spark, d))


@query(f"""with g as (select *, ts::date as day, avg(lat) over w as lat0, avg(lon) over w as lon0, min(epoch_us(ts)) over w as us0 from {GEO} window w as (partition by ts::date)),
  p as (select day, event_id, (lon - lon0) * 111.32 * cos(radians(lat0)) as x, (lat - lat0) * 111.32 as y, floor((epoch_us(ts) - us0) / 1000000.0::double) / 3600.0::double as t from g)
  select day, event_id, round((x - avg(x) over w) / coalesce(nullif(stddev_pop(x) over w, 0), 1), 6) + 0 as xs, round((y - avg(y) over w) / coalesce(nullif(stddev_pop(y) over w, 0), 1), 6) + 0 as ys, round((t - avg(t) over w) / coalesce(nullif(stddev_pop(t) over w, 0), 1), 6) + 0 as t_scaled
  from p window w as (partition by day)""")
def spatial_scaled_points(spark, d):
    made = detectors.scaled_points(ad.geo(spark, d))
    return made.select("day", "event_id", *((F.round(c, 6) + 0.0).alias(n) for c, n in (("xs", "xs"), ("ys", "ys"), ("ts", "t_scaled"))))


@query()
def hideouts(spark, d):
    points = ad.geo(spark, d).withColumn("ord", F.col("event_id"))
    found = detectors.numbered_clusters(detectors.co_location(points, lists=False))
    return found.select("cluster_id", "day", "point_count", "unique_entity_count", F.round("center_lat", 6).alias("center_lat"), F.round("center_lon", 6).alias("center_lon"), F.round("time_span_hours", 2).alias("time_span_hours"), F.least("point_count", F.lit(20)).cast("int").alias("n_events"))


#: The rows of lineitem that the SQL of the components reads.
SOME_EDGES = "l_quantity = 50 and l_discount <= 0.05"
COMPONENTS = """with recursive e as (select distinct 'phone:' || o_custkey as a, 'imei:' || l_partkey as b from lineitem join orders on l_orderkey = o_orderkey where l_quantity = 50 and l_discount <= 0.05),
  u as (select a, b from e union select b, a from e), r(node, seen) as (select a, a from u union select r.node, u.b from r join u on r.seen = u.a),
  c as (select node, coalesce(min(seen) filter (seen like 'phone:%'), min(seen)) as entity_id, count(*) as size from r group by node)"""


@query(COMPONENTS + " select split_part(node, ':', 1) as kind, split_part(node, ':', 2) as value, entity_id from c")
def entity_components(spark, d):
    return entities.entity_map(ad.identity_edges(spark, d, SOME_EDGES))


def profile(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("entity_id").agg(F.count_if(F.col("kind") == "phone").alias("phones"), F.count_if(F.col("kind") == "imei").alias("imeis"))


@query(COMPONENTS + " select entity_id, count(*) filter (node like 'phone:%') as phones, count(*) filter (node like 'imei:%') as imeis from c group by entity_id")
def entity_profile(spark, d):
    return profile(entities.entity_map(ad.identity_edges(spark, d, SOME_EDGES)))


@query(COMPONENTS + """, m as (select node, entity_id from c) select l_orderkey as id, l_linenumber as line, l_partkey as part, coalesce(p.entity_id, i.entity_id) as entity_id
  from (select * from lineitem where l_quantity = 50) join orders on l_orderkey = o_orderkey left join m p on p.node = 'phone:' || o_custkey left join m i on i.node = 'imei:' || l_partkey""")
def cascade_lookup(spark, d):
    return looked_up(spark, d, entities.entity_map(ad.identity_edges(spark, d, SOME_EDGES)), "l_quantity = 50")


def looked_up(spark: SparkSession, d: str, mapped: DataFrame, only: str = "true") -> DataFrame:
    rows = ad.table(spark, d, "lineitem").where(only).join(ad.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("o_custkey").cast("string").alias("phone"), F.col("l_partkey").cast("string").alias("imei"))
    return entities.lookup(rows, mapped, [("phone", "phone"), ("imei", "imei")]).drop("phone", "imei")


# over all rows, where recursive SQL is too slow: tests/test_whole.py has brute force
@query()
def entity_components_whole(spark, d):
    return entities.entity_map(ad.identity_edges(spark, d))


@query()
def entity_profile_whole(spark, d):
    return profile(entities.entity_map(ad.identity_edges(spark, d)))


@query()
def cascade_lookup_whole(spark, d):
    return looked_up(spark, d, entities.entity_map(ad.identity_edges(spark, d)))


@query(alike("(select min(p_partkey) as k, p_name as name, 'all' as block from part group by p_name)", 80) + " select a, name_a, b, name_b, score from best where place <= 3")
def fuzzy_name_pairs(spark, d):
    return entities.fuzzy_pairs(named_parts(spark, d, F.lit("all")), 80.0)


BY_BRAND = "(select min(p_partkey) as k, p_name as name, p_brand as block from part group by p_name, p_brand)"


@query(alike(BY_BRAND, 85) + " select a, name_a, b, name_b, score from best where place <= 3")
def fuzzy_name_pairs_by_brand(spark, d):
    return entities.fuzzy_pairs(named_parts(spark, d, F.col("p_brand")), 85.0)


MERGED = """, u as (select a, b from best where place <= 3 union select b, a from best where place <= 3), reached(node, seen) as (select a, a from u union select reached.node, u.b from reached join u on reached.seen = u.a)
  select node, min(seen) as component from reached group by node"""


@query(alike("(select min(p_partkey) as k, p_name as name, 'all' as block from part group by p_name)", 80).replace("with ", "with recursive ", 1) + MERGED)
def fuzzy_entity_merge(spark, d):
    return connected_components(entities.fuzzy_pairs(named_parts(spark, d, F.lit("all")), 80.0), "a", "b")


def named_parts(spark: SparkSession, d: str, block) -> DataFrame:
    """Parts as entities with a name and a block in which names may merge."""
    parts = ad.table(spark, d, "part").groupBy("p_name", block.alias("block")).agg(F.min("p_partkey").alias("k"))
    return parts.select(F.concat(F.lit("e"), F.col("k").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), "block")


@query(f"select a.src::varchar as src, a.dst::varchar as dst, a.amount::double as amount, b.amount::double as amount_back from {EDGES} a join {EDGES} b on a.src = b.dst and a.dst = b.src")
def circular_pairs(spark, d):
    return audit.reciprocal(detectors.ledger_edges(ad.ledger(spark, d))).withColumns({c: F.col(c).cast("double") for c in ("amount", "amount_back")})


@query(f"select count(*) as n from {EDGES} a join {EDGES} b on a.src = b.dst and a.dst = b.src where a.src::varchar < a.dst::varchar")
def circular_pairs_unordered(spark, d):
    return audit.reciprocal(detectors.ledger_edges(ad.ledger(spark, d))).where("src < dst").agg(F.count("*").alias("n"))


@query(f"""with e as (select distinct src::varchar as s, dst::varchar as t from {LEDGER} where ok and src <> dst and src % 4 = 0 and dst % 4 = 0)
  select x.s as a, x.t as b, y.t as c from e x join e y on x.t = y.s join e z on z.s = y.t and z.t = x.s where x.s < x.t and x.s < y.t and x.t <> y.t""")
def cycles3(spark, d):
    branch = ad.ledger(spark, d).where("src % 4 = 0 and dst % 4 = 0")  # the accounts of one branch
    return audit.cycles3(detectors.ledger_edges(branch))


@query(f"""with e as (select distinct src::varchar as s, dst::varchar as t from {LEDGER} where ok and src <> dst)
  select x.s as a, x.t as b, y.t as c from e x join e y on x.t = y.s join e z on z.s = y.t and z.t = x.s where x.s < x.t and x.s < y.t and x.t <> y.t""")
def cycles3_whole_ledger(spark, d):
    return audit.cycles3(detectors.ledger_edges(ad.ledger(spark, d)))


@query("select case when l_extendedprice >= 9000 and l_extendedprice < 10000 then '9000-10000' else '45000-50000' end as band, count(*) as n from lineitem where (l_extendedprice >= 9000 and l_extendedprice < 10000) or (l_extendedprice >= 45000 and l_extendedprice < 50000) group by 1")
def structuring_bands(spark, d):
    return audit.structuring(ad.table(spark, d, "lineitem"), "l_extendedprice")


@query("select user_id, count(*) as n, count(*) filter (hour(ts) >= 23 or hour(ts) <= 5) as n_night from events group by user_id")
def night_activity(spark, d):
    return audit.night_activity(ad.table(spark, d, "events"), "user_id", "ts")


@query("select user_id, count(*) as n from (select user_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as gap from events) where gap < 3600000000 group by user_id")
def rapid_gap(spark, d):
    return audit.rapid_gap(ad.table(spark, d, "events"), "user_id", "ts", "event_id")


@query(f"""with l as {LEDGER}, m as (select dst as account, 1 as received, epoch_us(ts) as us from l union all select src, 0, epoch_us(ts) from l)
  select account, count(*) as n from (select account, received, max(received) over (partition by account order by us range between 86400000000::bigint preceding and current row) as b from m) where received = 0 and b = 1 group by account""")
def rapid_in_out_strict(spark, d):
    return audit.rapid_in_out(ad.ledger(spark, d), 86_400)


@query("""with s as (select c_custkey::varchar as v, 'a' as s from customer union all select o_custkey::varchar, 'b' from orders union all select user_id::varchar, 'c' from events), g as (select v, string_agg(distinct s, '+' order by s) as sets from s group by v) select sets, count(*) as n from g group by sets""")
def phone_overlap(spark, d):
    return audit.overlap(a=ad.table(spark, d, "customer").select("c_custkey"), b=ad.table(spark, d, "orders").select("o_custkey"), c=ad.table(spark, d, "events").select("user_id"))


@query("select c_custkey from customer except select o_custkey from orders")
def customers_without_orders(spark, d):
    return ad.table(spark, d, "customer").select("c_custkey").join(ad.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").distinct()


@query("select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'P'")
def customers_without_partial_orders(spark, d):
    partial = ad.table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return shaping.members(ad.table(spark, d, "customer").select("c_custkey"), "c_custkey", partial, inside=False).distinct()


@query("select month(o_orderdate) as month, count(*) as n, min(o_orderdate) as first, max(o_orderdate) as last from orders group by 1")
def monthly_histogram(spark, d):
    return ad.table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("""with r as (select count(*) as rows, count(*) - count(doc_id) as d, count(*) - count(text) as t, count(*) - count(lang) as l, count(*) - count(source) as s, count(*) - count(n_chars) as c from documents)
  select 'doc_id' as column_name, rows, d as nulls from r union all select 'text', rows, t from r union all select 'lang', rows, l from r union all select 'source', rows, s from r union all select 'n_chars', rows, c from r""")
def null_profile(spark, d):
    return audit.null_profile(ad.table(spark, d, "documents"))


@query("""select 'o_orderstatus' as column_name, 'string' as dtype, count(*) - count(o_orderstatus) as nulls, count(distinct o_orderstatus) as n_distinct, substr(min(o_orderstatus), 1, 50) as sample from orders
  union all select 'o_orderpriority', 'string', count(*) - count(o_orderpriority), count(distinct o_orderpriority), substr(min(o_orderpriority), 1, 50) from orders
  union all select 'o_custkey', 'bigint', count(*) - count(o_custkey), count(distinct o_custkey), substr(min(o_custkey)::varchar, 1, 50) from orders""")
def column_profile(spark, d):
    return audit.column_profile(ad.table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query("select c_nationkey, min(c_acctbal) as lowest, max(c_acctbal) as highest, count(*) as n, round(max(c_acctbal) - min(c_acctbal), 2) as spread from customer group by c_nationkey order by c_nationkey limit 5")
def city_bounds(spark, d):
    c = ad.table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lowest"), F.max("c_acctbal").alias("highest"), F.count("*").alias("n"), F.round(F.max("c_acctbal") - F.min("c_acctbal"), 2).alias("spread"))
    return c.orderBy("c_nationkey").limit(5)


@query("select l_orderkey as key, count(distinct l_suppkey) as n_values from lineitem group by 1 having count(distinct l_suppkey) > 1")
def fd_violations(spark, d):
    return audit.violations(ad.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("l_orderkey", "key")


@query("select event_type, count(*) as n from events group by 1")
def value_counts(spark, d):
    return audit.value_counts(ad.table(spark, d, "events"), "event_type")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def nested_value_counts(spark, d):
    return audit.value_counts(ad.table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("select count(*) as rows, count(distinct (l_orderkey, l_linenumber)) as distinct_rows, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicates from lineitem")
def duplicate_rows(spark, d):
    return audit.duplicates(ad.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"""with s as {SIGNALS} select b.id from s b where b.kind = 'bank' and exists (select 1 from s c where c.kind = 'call' and c.entity_id = b.entity_id and abs(c.us - b.us) <= 1800000000) and exists (select 1 from s i where i.kind = 'session' and i.entity_id = b.entity_id and abs(i.us - b.us) <= 1800000000)""")
def coincidence_3way(spark, d):
    of = {k: ad.signals(spark, d).where(F.col("kind") == k).select(F.col("entity_id").alias("phone"), "ts", "id") for k in detectors.KINDS}
    return audit.coincidences(of["bank"], of["call"], of["session"]).select("id")


COINCIDENT = ORACLES["coincidence_3way"].replace("1800000000", "21600000000")


@query(COINCIDENT)
def coincidence_3way_6h(spark, d):
    of = {k: ad.signals(spark, d).where(F.col("kind") == k).select(F.col("entity_id").alias("phone"), "ts", "id") for k in detectors.KINDS}
    return audit.coincidences(of["bank"], of["call"], of["session"], minutes=360).select("id")


@query("select o_custkey, o_orderkey, (1000.0 + sum(cast(case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as decimal(18,2))) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)::double) as balance from orders")
def running_balance(spark, d):
    rows = ad.table(spark, d, "orders").withColumn("signed", F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    return audit.running_balance(rows, "o_custkey", "o_orderdate", "o_orderkey", "signed", 1000.0).select("o_custkey", "o_orderkey", "balance")


@query("select event_id, 'TXN' || lpad((row_number() over (order by ts, event_id))::varchar, 10, '0') as seq_id from events")
def sequential_ids(spark, d):
    return audit.sequential_ids(ad.table(spark, d, "events").select("ts", "event_id"), "ts", "event_id").select("event_id", "seq_id")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1")
def first_per_key(spark, d):
    return audit.first_per_key(ad.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("select user_id, event_id, rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as rank from events) where rank <= 3")
def top_n_per_group(spark, d):
    return audit.top_per_group(ad.table(spark, d, "events"), "user_id", 3, F.desc("value"), "event_id").select("user_id", "event_id", "rank")


RISK = f"""travel as (select entity_id::varchar as entity_id, 100.0 as points from (select *, lag(ts) over w as pts, lag(lat) over w as plat, lag(lon) over w as plon from {GEO} window w as (partition by entity_id order by ts, event_id)) where pts is not null and epoch_us(ts) > epoch_us(pts) and {haversine_sql('plat', 'plon', 'lat', 'lon')} > 100 and {haversine_sql('plat', 'plon', 'lat', 'lon')} / ((epoch_us(ts) - epoch_us(pts)) / 3600000000.0::double) > 800),
  fusion as (select entity_id::varchar as entity_id, risk_score::double as points from r), p as (select *, 'travel' as part from travel union all select *, 'fusion' from fusion)
  select entity_id, coalesce(sum(points) filter (part = 'fusion'), 0)::double as fusion, 0.0::double as mule, 0.0::double as farm, coalesce(sum(points) filter (part = 'travel'), 0)::double as travel, 0.0::double as hideout, round(sum(points)::double, 2) as score,
  case when sum(points) >= 300 then 'CRITICAL' when sum(points) >= 150 then 'HIGH' when sum(points) >= 50 then 'MEDIUM' else 'LOW' end as tier from p group by entity_id"""


@query(fused(1_800_000_000, ", " + RISK))
def entity_risk(spark, d):
    name = F.col("entity_id").cast("string").alias("entity_id")
    fusion = detectors.fusion_events(ad.signals(spark, d), 30, lists=False).select(name, F.col("risk_score").alias("points"))
    travel = detectors.impossible_travel(ad.geo(spark, d)).select(name, F.lit(100.0).alias("points"))
    none = fusion.where("false")
    return entities.entity_risk(fusion, none, none, travel, none)


# customers, users and phones have the same numbers, as in phone_overlap; account n is that of entity n
@query()
def entity_risk_whole(spark, d):
    return whole_risk(spark, d, detectors.ledger_edges(ad.ledger(spark, d)), detectors.scored_handsets(ad.device_pairs(spark, d)), detectors.fusion_events(ad.signals(spark, d), 30, lists=False))


def whole_risk(spark: SparkSession, d: str, edges: DataFrame, handsets: DataFrame, windows: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The scores of all entities, or of those ``among`` (entity_id) alone."""
    name = F.col("entity_id").cast("string").alias("entity_id")
    fusion = windows.select(name, F.col("risk_score").alias("points"))
    mules = detectors.scored_accounts(edges, neighbours=False).select(F.col("account").alias("entity_id"), F.col("risk_score").alias("points"))
    farms = handsets.where("risk_score > 0").select(F.explode("msisdns").alias("entity_id"), F.col("risk_score").alias("points"))
    travel = detectors.impossible_travel(ad.geo(spark, d)).select(name, F.lit(100.0).alias("points"))
    places = detectors.co_located_entities(ad.geo(spark, d).withColumn("ord", F.col("event_id"))).select(name, F.lit(75.0).alias("points"))

    def summed(df: DataFrame, part: str) -> DataFrame:
        # one part after the other, so that what they shuffle doesn't lie on disk together
        own = df if among is None else df.join(among, "entity_id", "left_semi")
        return staged(own.groupBy("entity_id").agg(F.sum(F.col("points").cast("double")).alias("points")), part, clear=True)

    return entities.entity_risk(summed(fusion, "fusion"), summed(mules, "mule"), summed(farms, "farm"), summed(travel, "travel"), summed(places, "hideout"))


#: Bytes that the list of a report's entities may take as Spark holds it, if all tasks get it; else it is joined by a shuffle.
SENT, ENTITY = 64 << 20, 64


@query()
def entity_dossier(spark, d):
    name = F.col("user_id").cast("string").alias("entity_id")
    users = staged(ad.table(spark, d, "events").select(name).distinct(), "users", clear=True)
    among = F.broadcast(users) if users.count() * ENTITY <= SENT else users
    # what several parts of a report read is joined once, and goes when they have read it
    edges = staged(detectors.ledger_edges(ad.ledger(spark, d)), "edges", clear=True)
    pairs = staged(ad.device_pairs(spark, d), "pairs", clear=True)
    own = pairs.select(F.col("msisdn").alias("entity_id"), "imei").join(among, "entity_id", "left_semi")
    handsets = staged(own.groupBy("entity_id").agg(F.sort_array(F.collect_set("imei")).alias("imeis")), "handsets", clear=True)
    scored = staged(detectors.scored_handsets(pairs), "scored", clear=True)
    release(pairs)
    windows = staged(detectors.fusion_events(ad.signals(spark, d), 30, lists=False), "windows", clear=True)
    risk = staged(whole_risk(spark, d, edges, scored, windows, among), "risk", clear=True)
    mules = detectors.mule_accounts(edges, neighbours=False).withColumn("entity_id", F.col("account"))
    farms = staged(detectors.top(scored, "imei", 50), "farms", clear=True)
    release(scored)
    events = ad.table(spark, d, "events").groupBy(name).agg(F.sort_array(F.collect_set("event_type")).alias("names"))
    found = events.join(handsets, "entity_id", "left")
    city = ad.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.array(F.col("c_nationkey").cast("string")).alias("cities"))
    found = found.join(city, "entity_id", "left").select("entity_id", F.array("entity_id").alias("phones"), F.array(F.concat(F.lit("account "), "entity_id")).alias("accounts"), F.array(F.concat("entity_id", F.lit("@ok"))).alias("upis"), "imeis", "names", "cities", F.array(F.concat(F.lit("10.0.0."), "entity_id")).alias("ips"))
    return entities.dossier(found, risk, mules, farms.withColumn("entity_id", F.explode("msisdns")), windows)


def riskiest(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    mules = detectors.mule_accounts(edges, neighbours=False).withColumn("entity_id", F.col("account"))
    return mules, detectors.device_farms(pairs).withColumn("entity_id", F.explode("msisdns"))


def findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The riskiest accounts and handsets, and all fused windows, by entity."""
    found = riskiest(detectors.ledger_edges(ad.ledger(spark, d)), ad.device_pairs(spark, d))
    return *found, detectors.fusion_events(ad.signals(spark, d), 30, lists=False)


TIMELINE = """, o as (select *, row_number() over (partition by entity_id order by risk_score desc, us) as place from r)
  select entity_id::varchar as entity_id, string_agg(strftime(make_timestamp(us - 1800000000), '%Y-%m-%dT%H:%M:%S') || case when us % 1000000 = 0 then '' else '.' || lpad((us % 1000000)::varchar, 6, '0') end || ' to ' || strftime(make_timestamp(us + 1800000000), '%Y-%m-%dT%H:%M:%S') || case when us % 1000000 = 0 then '' else '.' || lpad((us % 1000000)::varchar, 6, '0') end
  || ': risk ' || risk_score || ', ' || bank_count || ' bank, ' || call_count || ' call, ' || session_count || ' session' || case when is_injected then ' (injected)' else '' end, chr(10) order by risk_score desc, us) as timeline from o where place <= 10 group by entity_id"""


@query(fused(1_800_000_000, TIMELINE))
def dossier_timeline(spark, d):
    return entities.timeline_lines(findings(spark, d)[2])


@query(f"""with {MULES} select account as entity_id, '| ' || account || ' | ' || bank_name || ' | ' || format('{{:,.2f}}', money_in) || ' | ' || format('{{:,.2f}}', money_out) || ' | ' || in_degree || ' | ' || out_degree || ' | ' || format('{{:,.2f}}', risk_score) || ' |' as accounts_table from mules""")
def dossier_accounts(spark, d):
    return entities.account_lines(findings(spark, d)[0])


SIMS = "select imei, list_sort(list(distinct msisdn)) as msisdns from (select cast(l_partkey as varchar) as imei, cast(o_custkey as varchar) as msisdn from lineitem join orders on l_orderkey = o_orderkey) group by imei"


@query(f"""with top as ({FARMS.replace(' where l_quantity >= 48', '')}), s as ({SIMS}), x as (select unnest(msisdns) as entity_id, top.imei, risk_score, '| ' || top.imei || ' | ' || sim_count || ' | ' || array_to_string(msisdns[1:5], ', ') || case when len(msisdns) > 5 then '...' else '' end || ' | ' || upper(risk_tier) || ' | ' || format('{{:,.2f}}', risk_score) || ' |' as line from top join s on top.imei = s.imei)
  select entity_id, string_agg(line, chr(10) order by risk_score desc, imei) as handsets_table from x group by entity_id""")
def dossier_handsets(spark, d):
    return entities.handset_lines(findings(spark, d)[1])


@query(fused(1_800_000_000, f""", x as (select r.*, make_timestamp(us) as at from r)
  select x.entity_id, x.at - interval 30 minutes as window_start, array_to_string(list_sort(list(s.id) filter (s.kind = 'bank')), ',') as bank_ids, array_to_string(list_sort(list(s.id) filter (s.kind = 'call')), ',') as call_ids, array_to_string(list_sort(list(s.id) filter (s.kind = 'session')), ',') as session_ids
  from x join {SIGNALS} s on s.entity_id = x.entity_id and s.us between x.us - 1800000000 and x.us + 1800000000 group by x.entity_id, x.at"""))
def temporal_fusion_ids(spark, d):
    """The id lists of the windows; an empty list is null here, as the SQL has it."""
    listed = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return detectors.fusion_events(ad.signals(spark, d), 30).select("entity_id", "window_start", *(listed(f"{k}_ids") for k in detectors.KINDS))


@query(f"""with {MULES}, x as (select dst::varchar as account, src::varchar as other, 'in' as side from e union all select src::varchar, dst::varchar, 'out' from e)
  select m.account, array_to_string(list_sort(list(distinct other) filter (side = 'in')), ',') as senders, array_to_string(list_sort(list(distinct other) filter (side = 'out')), ',') as receivers from mules m join x using (account) group by m.account""")
def mule_neighbours_top50(spark, d):
    found = detectors.mule_accounts(detectors.ledger_edges(ad.ledger(spark, d)))
    return found.select("account", F.array_join("unique_senders", ",").alias("senders"), F.array_join("unique_receivers", ",").alias("receivers"))


@query(f"""with {MULES}, c as (select account from mules order by risk_score desc, account limit 15), g as (select src::varchar as s, dst::varchar as t, amount, n_txn from e),
  i as (select s as account from (select s, row_number() over (partition by t order by s) as place from g where t in (select account from c)) where place <= 8),
  o as (select t as account from (select t, row_number() over (partition by s order by t) as place from g where s in (select account from c)) where place <= 8),
  nodes as (select account from c union select account from i union select account from o)
  select s as src, t as dst, amount::double as amount, n_txn from g where s in (select account from nodes) and t in (select account from nodes)""")
def mule_neighbourhood(spark, d):
    edges = detectors.ledger_edges(ad.ledger(spark, d))
    found = detectors.neighbourhood(edges, detectors.mule_accounts(edges, neighbours=False))
    return found.select("src", "dst", F.col("amount").cast("double").alias("amount"), "n_txn")


@query("select time_bucket(interval '60 minutes', ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def stream_event_counts(spark, d):
    return streaming.counts(ad.table(spark, d, "events"))


@query("""select user_id, min(ts) as session_start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as k from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) < 1800000000 then 0 else 1 end as new from events)) group by user_id, k""")
def user_sessions(spark, d):
    return streaming.sessions(ad.table(spark, d, "events"))


@query("select user_id, string_agg(event_id::varchar, '|' order by ts, event_id) as chain, count(*) as length, min(ts) as first, max(ts) as last from events where event_type = 'error' group by user_id")
def chain_summary(spark, d):
    e = ad.table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", F.col("event_id").cast("string").alias("id")))).alias("c"))
    return e.select("user_id", F.array_join(F.transform("c", lambda x: x["id"]), "|").alias("chain"), F.size("c").cast("long").alias("length"), F.col("c")[0]["ts"].alias("first"), F.element_at("c", -1)["ts"].alias("last"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_fusion(spark, sf_dir)


# registers the queries over files, columns and lookups
from tracewright.plans import shaped  # noqa: E402, F401
