"""Detectors as plans: windows fused in time, mules, device farms, impossible travel, co-location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scores
from tracewright.operators import density
from tracewright.session import staged

KINDS = ("bank", "call", "session")


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def greedy_anchors(times: Column, width: int) -> Column:
    """Of ascending times those more than ``width`` after the last one kept."""
    return F.aggregate(
        times,
        F.array().cast("array<bigint>"),
        lambda kept, t: F.when((F.size(kept) == 0) | (t > F.try_element_at(kept, F.lit(-1)) + width), F.concat(kept, F.array(t))).otherwise(kept),
    )


#: Least length of a slice of time, in microseconds; slices are at least 16 windows' halves long, so few rows lie in two.
SLICE = 86_400_000_000


def fusion_events(signals: DataFrame, minutes: int = 30, lists: bool = True) -> DataFrame:
    """Windows of +-``minutes`` around anchors that hold two kinds of signals or more.

    ``signals``: entity_id, kind (bank, call, session), ts, id, injected. In
    the order of time a row anchors a window unless a kept window holds it;
    windows take in all rows, also those of windows before. Eligible anchors
    come from one RANGE frame over slices of an entity's time, which overlap
    by a half window, so that a busy entity is many tasks. An eligible time
    further than a half window from the one before is always kept; between
    such times a fold chooses.
    """
    width = minutes * 60_000_000
    size = max(SLICE, 16 * width)
    rows = signals.where("entity_id is not null and ts is not null").withColumn("us", micros("ts"))
    slice_of = lambda us: F.floor(us / size)
    rows = rows.withColumn("slice", F.explode(F.sequence(slice_of(F.col("us") - width), slice_of(F.col("us") + width))))
    frame = Window.partitionBy("entity_id", "slice").orderBy("us").rangeBetween(-width, width)
    of = lambda k: F.count(F.when(F.col("kind") == k, 1)).over(frame)
    own = {f"{k}_count": of(k) for k in KINDS} | {"is_injected": F.max(F.coalesce("injected", F.lit(False))).over(frame)}
    if lists:
        own |= {f"{k}_ids": F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("id"))).over(frame)) for k in KINDS}
    framed = rows.select("entity_id", "slice", "us", *(c.alias(n) for n, c in own.items())).where(F.col("slice") == slice_of(F.col("us")))
    kinds = sum((F.col(f"{k}_count") > 0).cast("int") for k in KINDS)
    eligible = framed.where(kinds >= 2).drop("slice").dropDuplicates(["entity_id", "us"])
    by = Window.partitionBy("entity_id").orderBy("us")
    times = eligible.select("entity_id", "us").withColumn("before", F.lag("us").over(by))
    first = F.when(F.col("before").isNull() | (F.col("us") - F.col("before") > width), F.col("us"))
    times = times.withColumn("run", F.max(first).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    anchors = times.groupBy("entity_id", "run").agg(greedy_anchors(F.sort_array(F.collect_list("us")), width).alias("kept")).select("entity_id", F.explode("kept").alias("us"))
    risk = scores.fusion_risk(F.col("bank_count"), F.col("call_count"), F.col("session_count"), F.col("is_injected"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return eligible.join(anchors, ["entity_id", "us"]).select("entity_id", time(F.col("us") - width).alias("window_start"), time(F.col("us") + width).alias("window_end"), *own, risk.alias("risk_score"))


def ledger_edges(ledger: DataFrame) -> DataFrame:
    """Successful transfers by (src, dst): decimal sum, number, banks (the smallest name, as order must not matter)."""
    done = ledger.where(F.col("status") == "SUCCESS")
    return done.groupBy(F.coalesce(F.col("src").cast("string"), F.lit("None")).alias("src"), F.coalesce(F.col("dst").cast("string"), F.lit("None")).alias("dst")).agg(
        F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"), F.count("amount").alias("n_txn"), F.min("src_bank").alias("src_bank"), F.min("dst_bank").alias("dst_bank")
    )


def mule_accounts(edges: DataFrame, min_edges: int = 3, top_n: int | None = 50, neighbours: bool = True) -> DataFrame:
    """Pass-through accounts: distinct senders and receivers, money both ways, throughput and risk."""
    return top(scored_accounts(edges, min_edges, neighbours), "account", top_n)


def scored_accounts(edges: DataFrame, min_edges: int = 3, neighbours: bool = True) -> DataFrame:
    """All rows of ``mule_accounts``, in no order: nothing is sorted."""
    # both ends of an edge in one pass: one shuffle by account instead of two and a full outer join
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit("in").alias("side"), F.col("amount"), F.col("dst_bank").alias("bank")),
        F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit("out").alias("side"), F.col("amount"), F.col("src_bank").alias("bank")),
    )).alias("e")).select("e.*")
    side = lambda s, c: F.when(F.col("side") == s, F.col(c))
    lists = [F.sort_array(F.collect_set(side(s, "other"))).alias(n) for s, n in (("in", "unique_senders"), ("out", "unique_receivers"))] if neighbours else []
    nodes = ends.groupBy("account").agg(
        F.count(side("in", "other")).alias("in_degree"), F.count(side("out", "other")).alias("out_degree"),
        F.coalesce(F.sum(side("in", "amount")), F.lit(0)).cast("double").alias("money_in"), F.coalesce(F.sum(side("out", "amount")), F.lit(0)).cast("double").alias("money_out"),
        F.min("bank").alias("bank_name"), *lists,
    ).where(F.col("in_degree") + F.col("out_degree") >= min_edges)
    ratio, volume = scores.throughput(F.col("money_in"), F.col("money_out")), F.col("money_in") + F.col("money_out")
    scored = nodes.withColumn("throughput_ratio", F.round(ratio, 4)).withColumn("total_volume", F.round(volume, 2))
    return scored.withColumn("risk_score", F.round(scores.mule_risk(F.col("in_degree"), F.col("out_degree"), ratio, volume), 4))


def top(df: DataFrame, key: str, n: int | None) -> DataFrame:
    ordered = df.orderBy(F.desc("risk_score"), key)
    return ordered.limit(n) if n else ordered


def device_farms(pairs: DataFrame, top_n: int | None = 50, lists: bool = True) -> DataFrame:
    """Handsets by the SIMs seen in them. ``pairs``: imei, msisdn, source (cdr or ipdr)."""
    return top(scored_handsets(pairs, lists), "imei", top_n)


def scored_handsets(pairs: DataFrame, lists: bool = True) -> DataFrame:
    """All rows of ``device_farms``, in no order: nothing is sorted."""
    seen = pairs.where(F.col("imei").isNotNull())
    # a set of numbers only where they are asked for: counted, no handset gathers its numbers
    listed = [F.sort_array(F.collect_set("msisdn")).alias("msisdns")] if lists else []
    # the list's length where there is one: counting too would first shuffle every pair beside its list
    sims = F.size(F.collect_set("msisdn")).cast("long") if lists else F.count_distinct("msisdn")
    found = seen.groupBy("imei").agg(
        sims.alias("sim_count"), *listed, F.count(F.when(F.col("source") == "cdr", 1)).alias("cdr_count"), F.count(F.when(F.col("source") == "ipdr", 1)).alias("ipdr_count"), F.count("msisdn").alias("total_record_count")
    )
    return found.withColumns({"risk_tier": scores.device_tier(F.col("sim_count")), "risk_score": scores.device_risk(F.col("sim_count"), F.col("total_record_count"))})


def neighbourhood(edges: DataFrame, accounts: DataFrame, n: int = 15, most: int = 8) -> DataFrame:
    """The edges among the ``n`` riskiest accounts and up to ``most`` senders and receivers of each, the first by name."""
    chosen = accounts.orderBy(F.desc("risk_score"), "account").limit(n).select("account")
    sides = []
    for own, other in (("dst", "src"), ("src", "dst")):
        rank = F.row_number().over(Window.partitionBy(own).orderBy(other))
        sides.append(edges.join(F.broadcast(chosen), F.col(own) == F.col("account"), "left_semi").withColumn("rank", rank).where(F.col("rank") <= most).select(F.col(other).alias("account")))  # n accounts at most
    nodes = chosen.union(sides[0]).union(sides[1]).distinct()
    inside = edges.join(nodes, F.col("src") == F.col("account"), "left_semi")
    return inside.join(nodes, F.col("dst") == F.col("account"), "left_semi")


def call_points(calls: DataFrame, include_receiver: bool = True) -> DataFrame:
    """Both parties of a call at the caller's tower."""
    parties = F.array(*(F.struct(F.col(c).alias("msisdn"), F.lit(r).alias("role")) for c, r in (("Caller_MSISDN", "caller"), ("Receiver_MSISDN", "receiver"))[: 2 if include_receiver else 1]))
    return calls.where("Latitude is not null and Longitude is not null and Call_Start_Time is not null").select(F.explode(parties).alias("p"), F.col("Call_Start_Time").alias("ts"), F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"), F.col("CDR_ID").alias("event_id"), F.col("Tower_City").alias("city")).select("p.*", "ts", "lat", "lon", "event_id", "city")


def impossible_travel(points: DataFrame, max_kmh: float = 800.0, min_km: float = 100.0) -> DataFrame:
    """Consecutive events of an entity too far apart for the time between. ``points``: entity_id, ts, lat, lon, source, event_id."""
    by = Window.partitionBy("entity_id").orderBy("ts", "source", "event_id")
    before = F.lag(F.struct("ts", "lat", "lon", "source", "event_id")).over(by)
    pairs = points.where("entity_id is not null and ts is not null and lat is not null and lon is not null").withColumn("p", before).where("p is not null")
    pairs = pairs.select("entity_id", F.col("p.event_id").alias("from_event"), F.col("event_id").alias("to_event"), F.col("p.lat").alias("lat1"), F.col("p.lon").alias("lon1"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), ((micros("ts") - micros(F.col("p.ts"))) / 3_600_000_000.0).alias("hours"))
    pairs = pairs.where("hours > 0").withColumn("km", scores.haversine("lat1", "lon1", "lat2", "lon2")).withColumn("kmh", F.col("km") / F.col("hours"))
    return pairs.where((F.col("kmh") > max_kmh) & (F.col("km") > min_km)).select("entity_id", "from_event", "to_event", F.round("km", 2).alias("distance_km"), F.round("hours", 4).alias("time_delta_hours"), F.round("kmh", 1).alias("velocity_kmh"), scores.travel_severity(F.col("kmh")).alias("severity"))


def scaled_points(points: DataFrame) -> DataFrame:
    """Per day: kilometres from the day's centre and hours from its first event, each over its deviation (1 if 0).

    The days' figures are aggregated with map-side combine and sent to the
    rows, a row a day, so a day isn't one task and no point is shuffled.
    """
    rows = points.withColumn("day", F.to_date("ts"))
    centres = rows.groupBy(F.col("day").alias("_day")).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.min(micros("ts")).alias("us0"), F.count("*").alias("day_points"))
    rows = rows.join(F.broadcast(centres), F.col("day").eqNullSafe(F.col("_day"))).drop("_day")
    rows = rows.withColumns({"x": (F.col("lon") - F.col("lon0")) * scores.KM_PER_DEGREE * F.cos(F.radians("lat0")), "y": (F.col("lat") - F.col("lat0")) * scores.KM_PER_DEGREE, "t": F.floor((micros("ts") - F.col("us0")) / 1_000_000) / 3600.0})
    spreads = rows.groupBy(F.col("day").alias("_day")).agg(*(F.avg(c).alias(f"_m{c}") for c in "xyt"), *(F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s{c}") for c in "xyt"))
    rows = rows.join(F.broadcast(spreads), F.col("day").eqNullSafe(F.col("_day")))
    return rows.withColumns({f"{c}s": (F.col(c) - F.col(f"_m{c}")) / F.col(f"_s{c}") for c in "xyt"}).drop("lat0", "lon0", "us0", "_day", *(f"_{k}{c}" for k in "ms" for c in "xyt"))


def co_location(points: DataFrame, eps: float = 0.5, min_samples: int = 3, min_entities: int = 2, lists: bool = True) -> DataFrame:
    """Density clusters of a day's points in scaled space and time with two entities or more.

    ``points``: ord (unique, the order of scanning), entity_id, ts, lat, lon.
    A border point joins the cluster whose first core point comes first.
    Entities and the first 20 points are listed only where asked for:
    counted, no cluster gathers its entities.
    """
    placed = located(points, eps, min_samples)
    by = ["day", "cluster"]
    listed = [F.sort_array(F.collect_set("entity_id")).alias("entity_ids")] if lists else []
    found = placed.groupBy(*by).agg(
        F.count("*").alias("point_count"), *listed, F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"), ((F.max(micros("time")) - F.min(micros("time"))) / 3_600_000_000.0).alias("time_span_hours"), F.count_distinct("entity_id").cast("int").alias("unique_entity_count")
    )
    found = found.where(F.col("unique_entity_count") >= min_entities)
    if not lists:
        return found
    first = placed.select(*by, "ord", F.row_number().over(Window.partitionBy(*by).orderBy("ord")).alias("place")).where(F.col("place") <= 20)
    return found.join(first.groupBy(*by).agg(F.sort_array(F.collect_list("ord")).alias("events")), by)


def located(points: DataFrame, eps: float = 0.5, min_samples: int = 3) -> DataFrame:
    """The points in density clusters of their day: day, cluster, ord, entity_id, time, lat, lon."""
    scaled = scaled_points(points.withColumn("time", F.col("ts")))  # the scaled t is called ts, after x, y and t
    rows = scaled.select("day", "ord", "entity_id", "time", "lat", "lon", F.col("xs").alias("x"), F.col("ys").alias("y"), F.col("ts").alias("t"))
    return density.clusters(staged(rows, "scaled"), eps, min_samples).drop("x", "y", "t")


def co_located_entities(points: DataFrame, eps: float = 0.5, min_samples: int = 3, min_entities: int = 2) -> DataFrame:
    """(day, cluster, entity_id) of the clusters of ``co_location``, a row for each entity."""
    inside = located(points, eps, min_samples).select("day", "cluster", "entity_id").where("entity_id is not null").distinct()
    several = inside.groupBy("day", "cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_entities).select("day", "cluster")
    return inside.join(several, ["day", "cluster"], "left_semi")


def numbered_clusters(clusters: DataFrame) -> DataFrame:
    """cluster_id from 0 on, over days and in each day by the first core point: a prefix sum of the days' counts."""
    inside = clusters.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy("cluster")))
    per_day = clusters.groupBy("day").agg(F.count("*").alias("n"))
    before = per_day.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("offset"))  # a row a day
    return inside.join(before, "day").withColumn("cluster_id", (F.col("offset") + F.col("rank") - 1).cast("long")).drop("rank", "offset")
