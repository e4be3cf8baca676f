"""Parts of the SQL: the driver's tables in the shapes of the library's inputs, and results that several queries build on."""

from __future__ import annotations

K = "cast(json_extract_string(props, '$.k') as int)"
LEDGER = "(select o_custkey % 400 as src, l_partkey % 400 as dst, l_extendedprice as amount, o_orderstatus = 'F' as ok, o_orderdate as ts, l_orderkey as id from lineitem join orders on l_orderkey = o_orderkey)"
EDGES = f"(select src, dst, sum(cast(amount as decimal(18,2))) as amount, count(amount) as n_txn, 'bank' || (src % 7) as src_bank, 'bank' || (dst % 7) as dst_bank from {LEDGER} where ok group by src, dst)"
GEO = f"(select user_id as entity_id, ts, 8 + (29 * {K} % 2900) / 100.0::double as lat, 68 + ((53 * {K} + user_id) % 2900) / 100.0::double as lon, event_id from events)"
SIGNALS = f"(select user_id as entity_id, case when event_type = 'purchase' then 'bank' when event_type in ('signup', 'error') then 'call' else 'session' end as kind, epoch_us(ts) as us, event_id as id, {K} = 7 as injected from events)"
PAIRS = "(select cast(l_partkey as varchar) as imei, cast(o_custkey as varchar) as msisdn, l_linestatus = 'O' as cdr from lineitem join orders on l_orderkey = o_orderkey where l_quantity >= 48)"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


MULES = f"""e as {EDGES}, n as (
  select account, count(*) filter (side = 'in') as in_degree, count(*) filter (side = 'out') as out_degree, coalesce(sum(amount) filter (side = 'in'), 0)::double as money_in, coalesce(sum(amount) filter (side = 'out'), 0)::double as money_out, min(bank) as bank_name
  from (select dst::varchar as account, 'in' as side, amount, dst_bank as bank from e union all select src::varchar, 'out', amount, src_bank from e) group by account having count(*) >= 3)
  , r as (select *, case when greatest(money_in, money_out) > 0 then least(money_in, money_out) / greatest(money_in, money_out) else 0 end as ratio, money_in + money_out as volume from n)
  , mules as (select account, in_degree, out_degree, money_in, money_out, bank_name, round(ratio, 4) as throughput_ratio, round(volume, 2) as total_volume, round((in_degree + 1) * (out_degree + 1) * ratio * ln(1 + volume), 4) as risk_score
  from r order by risk_score desc, account limit 50)"""


FARMS = f"""with g as (select imei, count(distinct msisdn) as sim_count, count(*) filter (cdr) as cdr_count, count(*) filter (not cdr) as ipdr_count, count(msisdn) as total_record_count from {PAIRS} group by imei)
  select *, case when sim_count >= 6 then 'critical' when sim_count >= 4 then 'high' when sim_count >= 3 then 'medium' else 'low' end as risk_tier,
  case when sim_count > 1 then round(power(sim_count - 1.0, 1.8) * ln(1 + total_record_count::double), 4) else 0.0 end as risk_score from g order by risk_score desc, imei limit 50"""


FUSED = f"""with s as {SIGNALS}, f as (select *, count(*) filter (kind = 'bank') over w as bank_count, count(*) filter (kind = 'call') over w as call_count, count(*) filter (kind = 'session') over w as session_count, max(injected::int) over w = 1 as is_injected
  from s window w as (partition by entity_id order by us range between WIDTH::bigint preceding and WIDTH::bigint following)),
  e as (select distinct entity_id, us, bank_count, call_count, session_count, is_injected from f where (bank_count > 0)::int + (call_count > 0)::int + (session_count > 0)::int >= 2),
  k as (select entity_id, unnest(list_reduce(list_prepend([]::bigint[], list_transform(list_sort(list(us)), lambda t: [t])), lambda a, x: case when len(a) = 0 or x[1] > a[len(a)] + WIDTH::bigint then list_concat(a, x) else a end)) as us from e group by entity_id),
  r as (select e.*, (case when bank_count > 0 and call_count > 0 and session_count > 0 then 50 when bank_count > 0 and (call_count > 0 or session_count > 0) then 30 else 0 end + case when is_injected then 100 else 0 end) as risk_score from e join k using (entity_id, us))"""


def fused(width: int, select: str) -> str:
    return FUSED.replace("WIDTH", str(width)) + select


ROWS = " select entity_id, make_timestamp(us - WIDTH::bigint) as window_start, make_timestamp(us + WIDTH::bigint) as window_end, bank_count, call_count, session_count, is_injected, risk_score from r"


def alike(names: str, threshold: int) -> str:
    """CTE ``best`` of pairs of names of ``names`` (k, name, block) by the common subsequence of their sorted words."""
    # a row of the table of lengths for each character of one name, folded over those of the other
    step = "lambda row, c: list_reduce(list_prepend([0]::bigint[], list_transform(range(1, len(y.cs) + 1), lambda j: [j]::bigint[])), lambda made, j: list_append(made, case when y.cs[j[1]] = c[1] then row[j[1]] + 1 else greatest(row[j[1] + 1], made[j[1]]) end))"
    common = f"list_reduce(list_prepend(list_transform(range(0, len(y.cs) + 1), lambda j: 0::bigint), list_transform(x.cs, lambda c: [c]::bigint[])), {step})[-1]"
    return f"""with s as (select 'e' || k as entity_id, name, block, array_to_string(list_sort(list_filter(string_split(trim(name), ' '), lambda t: t <> '')), ' ') as sorted from {names}),
  t as (select distinct sorted, list_transform(string_split(sorted, ''), lambda c: unicode(c)::bigint) as cs from s),
  scored as (select x.sorted as sa, y.sorted as sb, 200.0::double * {common} / (len(x.cs) + len(y.cs)) as score from t x join t y on 2.0 * least(len(x.cs), len(y.cs)) / (len(x.cs) + len(y.cs)) >= {threshold} / 100.0),
  pairs as (select distinct a.entity_id as a, a.name as name_a, b.entity_id as b, b.name as name_b, score from s a join scored on scored.sa = a.sorted join s b on scored.sb = b.sorted and a.block = b.block and a.entity_id <> b.entity_id and a.name <> b.name where score >= {threshold}),
  best as (select *, dense_rank() over (partition by name_a order by score desc, name_b) as place from pairs)"""
