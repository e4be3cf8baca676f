"""Queries over whole tables against brute force."""

import re

import duckdb
from pyspark.sql import functions as F

from tests.test_operators import textbook
from tracewright.operators import detectors
from tracewright.plans import queries as plans
from tracewright.sources import adapters as ad

SF = "/root/testdata/sf0.001"


def lines(columns):
    return duckdb.sql(f"select {columns} from '{SF}/lineitem.parquet' join '{SF}/orders.parquet' on l_orderkey = o_orderkey").fetchall()


def test_cycles_of_all_accounts(spark):
    after = {}
    for src, dst, status in lines("o_custkey % 400, l_partkey % 400, o_orderstatus"):
        if status == "F" and src != dst:
            after.setdefault(str(src), set()).add(str(dst))
    want = {(a, b, c) for a in after for b in after[a] if a < b for c in after.get(b, ()) if a < c and a in after.get(c, ())}
    got = [tuple(r) for r in plans.QUERIES["cycles3_whole_ledger"](spark, SF).select("a", "b", "c").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > len(plans.QUERIES["cycles3"](spark, SF).collect())


def test_all_narrations_are_classified(spark, tmp_path):
    texts = ["Zahlung für Miete upi Jürgen@bank", None, "plain neft a.b-c@ok", "東京 ATM", "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, plans.QUERIES["classify_all_narrations"](spark, str(tmp_path)).collect()))
    assert got == [(0, "UPI", "rgen@bank"), (1, "OTHER", None), (2, "NEFT", "a.b-c@ok"), (3, "ATM", None), (4, "OTHER", None)]
    whole = plans.QUERIES["classify_all_narrations"](spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count() > plans.QUERIES["classify_narrations"](spark, SF).count()


def test_entities_of_all_rows(spark):
    rows = lines("l_orderkey, l_linenumber, l_partkey, o_custkey")
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for *_, part, customer in rows:
        parent[root(f"phone:{customer}")] = root(f"imei:{part}")
    members = {}
    for x in list(parent):
        members.setdefault(root(x), []).append(x)
    name = {r: min(x for x in m if x.startswith("phone:")) for r, m in members.items()}
    got = [tuple(r) for r in plans.QUERIES["entity_components_whole"](spark, SF).select("kind", "value", "entity_id").collect()]
    assert sorted(got) == sorted((*x.split(":"), name[root(x)]) for x in parent)
    count = lambda m, kind: sum(x.startswith(kind) for x in m)
    got = [tuple(r) for r in plans.QUERIES["entity_profile_whole"](spark, SF).select("entity_id", "phones", "imeis").collect()]
    assert sorted(got) == sorted((name[r], count(m, "phone:"), count(m, "imei:")) for r, m in members.items())
    got = [tuple(r) for r in plans.QUERIES["cascade_lookup_whole"](spark, SF).select("id", "line", "part", "entity_id").collect()]
    assert sorted(got) == sorted((o, n, part, name[root(f"phone:{customer}")]) for o, n, part, customer in rows)


def test_farms_of_all_rows(spark):
    sims = {}
    for part, customer in lines("l_partkey, o_custkey"):
        sims.setdefault(str(part), set()).add(customer)
    got = plans.QUERIES["device_farms_whole_top50"](spark, SF).collect()
    assert len(got) == 50 and all(r["sim_count"] == len(sims[r["imei"]]) for r in got)


def test_hideouts_of_all_events(spark):
    """Textbook density clustering of the whole small table, day by day."""
    points = detectors.scaled_points(ad.geo(spark, SF).withColumn("time", F.col("ts"))).select("day", "event_id", "entity_id", "xs", "ys", F.col("ts").alias("t")).collect()
    days = {}
    for p in sorted(points, key=lambda p: p["event_id"]):
        days.setdefault(p["day"], []).append(p)
    want = []
    for day, own in days.items():
        label = textbook([(p["xs"], p["ys"], p["t"]) for p in own], 0.5, 3)
        for k in set(label) - {None}:
            inside = [p for p, x in zip(own, label) if x == k]
            if len({p["entity_id"] for p in inside}) > 1:
                want.append((str(day), len(inside), len({p["entity_id"] for p in inside})))
    got = plans.QUERIES["hideouts"](spark, SF).collect()
    assert sorted((str(r["day"]), r["point_count"], r["unique_entity_count"]) for r in got) == sorted(want) and want
    assert sorted(r["cluster_id"] for r in got) == list(range(len(got)))


def test_risk_has_all_five_parts(spark):
    got = {r["entity_id"]: r for r in plans.QUERIES["entity_risk_whole"](spark, SF).collect()}
    for part in ("fusion", "mule", "farm", "travel", "hideout"):
        assert any(r[part] > 0 for r in got.values()), part
    assert all(abs(r["score"] - sum(r[p] for p in ("fusion", "mule", "farm", "travel", "hideout"))) < 0.02 for r in got.values())
    for r in plans.QUERIES["mule_accounts_top50"](spark, SF).collect():
        assert abs(got[r["account"]]["mule"] - r["risk_score"]) < 1e-6
    for r in plans.QUERIES["entity_risk"](spark, SF).collect():
        assert (got[r["entity_id"]]["fusion"], got[r["entity_id"]]["travel"]) == (r["fusion"], r["travel"])
    dossier = plans.QUERIES["entity_dossier"](spark, SF).where("report not like '%shared places: 0.00%'")
    assert dossier.count() > 0


def test_scores_of_all_sort_nothing_and_keep_to_the_entities_asked_for(spark, monkeypatch):
    """An order of all handsets beside their lists was a second shuffle of all pairs; reports need few entities of them."""
    monkeypatch.setattr(detectors, "co_located_entities", lambda points: points.select("entity_id").distinct())
    plans_of = []
    monkeypatch.setattr(plans, "staged", lambda df, *_, **__: plans_of.append(df) or df)
    whole = plans.QUERIES["entity_risk_whole"](spark, SF)
    for df in (whole, *plans_of):
        assert not re.search(r"Sort \[.*\], true", df._jdf.queryExecution().optimizedPlan().toString())
    edges, handsets = detectors.ledger_edges(ad.ledger(spark, SF)), detectors.scored_handsets(ad.device_pairs(spark, SF))
    among = spark.createDataFrame([("3",), ("7",)], "entity_id string")
    few = plans.whole_risk(spark, SF, edges, handsets, detectors.fusion_events(ad.signals(spark, SF), 30, lists=False), among)
    want = {r["entity_id"]: round(r["score"], 1) for r in whole.where("entity_id in ('3', '7')").collect()}
    assert {r["entity_id"]: round(r["score"], 1) for r in few.collect()} == want and len(want) == 2
