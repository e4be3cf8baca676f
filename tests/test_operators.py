"""Operators against plain Python, and fixtures of the investigation data's shape."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import identifiers as ids
from tracewright.functions.similarity import common_subsequence, subsequence_ratio
from tracewright.operators import audit, detectors, entities, shaping, statements
from tracewright.operators.components import connected_components
from tracewright.sources import tables
from tracewright.streaming import events as streaming

T0 = dt.datetime(2025, 3, 1, 12)


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(60)] + [(999, i) for i in range(300, 380)] + [(7, 7), (500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: root(x) for x in parent}
    assert connected_components(df.where("false")).count() == 0


def greedy(rows, width):
    rows, used, out = sorted(rows), set(), []
    for i, (t, *_) in enumerate(rows):
        if i in used:
            continue
        inside = [j for j, r in enumerate(rows) if abs(r[0] - t) <= width]
        if len({rows[j][1] for j in inside}) >= 2:
            out.append((t, len(inside)))
            used |= set(inside)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fusion_is_the_greedy_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{e}", rng.choice(detectors.KINDS), minutes(rng.randrange(600)), f"{e}-{i}", False) for e in range(6) for i in range(rng.randrange(40))]
    got = detectors.fusion_events(spark.createDataFrame(rows, "entity_id string, kind string, ts timestamp_ntz, id string, injected boolean"), 30).collect()
    for e in range(6):
        own = [((t - T0).total_seconds(), k) for x, k, t, *_ in rows if x == f"e{e}"]
        # rows of one instant anchor once
        want = {(t, n) for t, n in greedy(own, 1800)}
        assert {((r["window_start"] - T0).total_seconds() + 1800, r["bank_count"] + r["call_count"] + r["session_count"]) for r in got if r["entity_id"] == f"e{e}"} == want


def textbook(points, eps, least):
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q)) <= eps * eps] for p in points]
    label = [None] * len(points)
    n = -1
    for i in range(len(points)):
        if label[i] is not None or len(near[i]) < least:
            continue
        n += 1
        label[i], todo = n, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] is None:
                    label[j] = n
                    if len(near[j]) >= least:
                        todo.append(j)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_co_location_is_density_clustering(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"e{rng.randrange(9)}", minutes(rng.randrange(600)), 20 + rng.random() * 3, 75 + rng.random() * 3) for i in range(90)]
    df = spark.createDataFrame(rows, "ord long, entity_id string, ts timestamp_ntz, lat double, lon double")
    points = {r["ord"]: (r["xs"], r["ys"], r["ts"]) for r in detectors.scaled_points(df).collect()}
    label = textbook([points[i] for i in range(90)], 0.6, 4)
    sizes = sorted((label.count(k), len({rows[i][1] for i in range(90) if label[i] == k})) for k in set(label) - {None})
    got = detectors.co_location(df, 0.6, 4).collect()
    assert sorted((r["point_count"], r["unique_entity_count"]) for r in got) == [x for x in sizes if x[1] >= 2]


def write(tmp_path, name, columns, rows):
    path = tmp_path / name
    path.write_text("\n".join(",".join(str(r.get(c, "")) for c in columns) for r in [dict(zip(columns, columns)), *rows]))
    return str(path)


@pytest.fixture
def sources(spark, tmp_path):
    """Ten planted sequences of call, session and transfer, a shared handset, and noise."""
    bank, calls, sessions = [], [], []
    for i in range(10):
        phone, other = 9000000000 + i, 9100000000 + i
        calls.append({"CDR_ID": f"INJ_CDR_{i}", "Call_Start_Time": minutes(200 * i), "Caller_MSISDN": phone, "Receiver_MSISDN": other, "IMEI": f"3510000000000{i:02d}.0", "Latitude": 19, "Longitude": 72, "Caller_Name": f"name {i}"})
        sessions.append({"IPDR_ID": f"INJ_IPDR_{i}", "Session_Start_Time": minutes(200 * i + 3), "User_MSISDN": phone, "IMEI": f"3510000000000{i:02d}.0", "Public_IP_Address": f"49.1.1.{i}", "Device_ID": f"D{i}"})
        bank.append({"Transaction_ID": f"INJ_TXN_{i}", "Timestamp": minutes(200 * i + 8), "Transaction_Status": "SUCCESS", "Transaction_Amount": 100 + i, "Sender_Phone_Number": f"{phone}.0", "Sender_Account_Number": f"1000{i}", "Receiver_Account_Number": f"77{i}", "Sender_City": "Pune", "Channel": "Internet_Banking"})
    paths = [write(tmp_path, "bank.csv", [c for c in tables.BANK if c != "Currency"], bank), write(tmp_path, "cdr.csv", [c for c in tables.CALLS if c != "Subscriber_ID"], calls), write(tmp_path, "ipdr.csv", [c for c in tables.SESSIONS if c != "Subscriber_ID"], sessions)]
    return tables.load_bank(spark, paths[0]), tables.load_calls(spark, paths[1]), tables.load_sessions(spark, paths[2])


def test_planted_sequences(sources):
    bank, calls, sessions = sources
    assert bank.select("Currency", "Channel").distinct().collect() == [(None, "Net_Banking")]
    mapped, found = entities.resolve(bank, calls, sessions)
    assert {r["entity_id"] for r in found.where("size(imeis) > 0").collect()} == {f"phone:900000000{i}" for i in range(10)}
    assert found.where("entity_id = 'phone:9000000003'").first()["accounts"] == ["10003"]
    events = detectors.fusion_events(entities.signals(bank, calls, sessions, mapped)).where("is_injected and risk_score = 150").collect()
    assert sorted((r["entity_id"], *r["bank_ids"], *r["call_ids"], *r["session_ids"]) for r in events) == [(f"phone:900000000{i}", f"INJ_TXN_{i}", f"INJ_CDR_{i}", f"INJ_IPDR_{i}") for i in range(10)]
    points = detectors.call_points(calls)
    assert points.count() == 20 and detectors.call_points(calls, include_receiver=False).count() == 10


@pytest.mark.parametrize(("threshold", "seed"), [(85.0, 1), (80.0, 2), (60.0, 3), (95.0, 4)])
def test_no_alike_pair_is_lost(spark, threshold, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    names = ["katherine", "catherine", "rao kavita", "kavita rao", "x", "y", "", "  "] + [" ".join(word() for _ in range(rng.randrange(1, 3))) for _ in range(50)]
    names += ["".join(c for c in n if rng.random() > 0.1) for n in names[:40]]
    rows = [(f"e{i % 70}", n, rng.choice(["c:1", "c:2"])) for i, n in enumerate(names)] + [("e1", None, "c:1"), ("e2", "x", None)]

    def ratio(a, b):
        return 200 * common_subsequence(a, b) / (len(a) + len(b))

    def tidy(n):
        return " ".join(sorted(n.split()))

    want = {}
    for e, n, b in rows:
        for f, m, c in rows:
            if n and m and b and b == c and e != f and n != m and tidy(n) and tidy(m) and (score := ratio(tidy(n), tidy(m))) >= threshold:
                want.setdefault(n, set()).add((-score, m, e, f))
    best = {(e, n, f, m) for n, found in want.items() for top in [sorted({x[:2] for x in found})[:3]] for s, m, e, f in found if (s, m) in top}
    got = entities.fuzzy_pairs(spark.createDataFrame(rows, "entity_id string, name string, block string"), threshold)
    assert {tuple(r)[:4] for r in got.collect()} == best and len(best) >= (threshold < 90) * 5


def test_alike_names_merge_with_a_weak_identifier_in_common(spark):
    rows = [("a", "niraj rathod", "c:pune"), ("b", "niraj rathodd", "c:pune"), ("c", "niraj rathodd", "c:goa"), ("d", "kavita rao", "c:pune")]
    got = entities.fuzzy_pairs(spark.createDataFrame(rows, "entity_id string, name string, block string")).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [("a", "b"), ("b", "a")]


def test_subsequence(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in "ab")
        assert common_subsequence(a, b) == slow(a, b)
    df = spark.createDataFrame([("ayushman", "ayushmann"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] and round(r[0], 1) for r in df.select(subsequence_ratio("a", "b")).collect()] == [94.1, 100.0, None]


def test_identifiers(spark):
    rows = [("9876543210.0", "8.12866462699514E14", "by cash deposit", "UPI-MERCHANT-7160477095@okhdfcbank-IRCTC"), ("98765", "123", "treatment", "none"), (None, None, None, None), ("NaN", "NULL", "total", "")]
    df = spark.createDataFrame(rows, "p string, i string, n string, u string")
    got = df.select(ids.norm_phone("p"), ids.norm_imei("i"), ids.transaction_type("n"), ids.transaction_type("n", word_boundary=True), ids.extract_upi("u"), ids.upi_phone_any("u")).collect()
    assert tuple(got[0]) == ("9876543210", "812866462699514", "POS", "CASH", "upi-merchant-7160477095@okhdfcbank-irctc", "7160477095")
    assert tuple(got[1]) == (None, None, "ATM", "OTHER", None, None)
    assert got[2][0] is None and got[3][0] is None and got[3][1] is None


def test_statement(spark, tmp_path):
    header = ["Date", "Narration", "Chq./Ref.No.", "Value Dt", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"]
    assert statements.column_roles(header) == {"date": 0, "narration": 1, "chq_ref": 2, "value_date": 3, "withdrawal": 4, "deposit": 5, "balance": 6}
    with pytest.raises(ValueError, match="no statement parser"):
        statements.parser_for("other")
    cells = [["01/02/2025", "UPI-a.b@okaxis", "1", "01/02/2025", "1,234.50", "", "10"], ["1/2/25", "Opening Balance", "", "", "", "5", ""], ["x", "NEFT", "", "", "5", "", ""], ["3 Feb 2025", "Total Oil", "", "", "5", "", ""], ["4-Feb-2025", "cheque", "", "", "(5)", "₹7", None], ["05/02/2025", "short"], ["05/02/2025", None, "", "", "1", "", ""]]
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate(cells)], "file string, row_no int, cells array<string>")
    got = [(str(r["Timestamp"]), r["Transaction_Amount"], r["Transaction_Type"], r["Extracted_UPI_ID"]) for r in statements.parse_rows(df, header).orderBy("Timestamp").collect()]
    assert got == [("2025-02-01 00:00:00", -1234.5, "UPI", "upi-a.b@okaxis"), ("2025-02-04 00:00:00", 7.0, "CHEQUE", None)]
    (tmp_path / "s.csv").write_text("Account Statement for: A B\nAccount Number: 123\nRegistered Phone: 9\n----\nDate,Narration,Withdrawal,Deposit,Running_Balance\n01-01-2025 10:00:00,UPI/x,5,,-5\n02-01-2025 10:00:00,ATM,,7,2\n")
    rows = tables.load_raw_statements(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["Account_Name"], r["Account_Number"], r["Narration"], r["Deposit"]) for r in rows] == [("A B", "123", "UPI/x", None), ("A B", "123", "ATM", "7")]


def test_farms_and_mules(spark):
    pairs = spark.createDataFrame([("i1", f"s{k % 3}", "cdr" if k % 2 else "ipdr") for k in range(9)] + [("i2", "s1", "cdr"), (None, "s", "cdr")], "imei string, msisdn string, source string")
    first = detectors.device_farms(pairs).first()
    assert (first["imei"], first["risk_score"], first["risk_tier"], first["total_record_count"], first["msisdns"]) == ("i1", 8.0181, "medium", 9, ["s0", "s1", "s2"])
    ledger = spark.createDataFrame([("a", "m", 100.0, "SUCCESS", "x", "y"), ("b", "m", 100.0, "SUCCESS", "x", "y"), ("m", "c", 200.0, "SUCCESS", "y", "z"), ("m", "q", 5.0, "FAILED", "y", "z"), (None, "m", 0.0, "SUCCESS", None, "y")], "src string, dst string, amount double, status string, src_bank string, dst_bank string")
    mule = detectors.mule_accounts(detectors.ledger_edges(ledger)).first()
    assert (mule["account"], mule["in_degree"], mule["out_degree"], mule["throughput_ratio"], mule["unique_senders"]) == ("m", 3, 1, 1.0, ["None", "a", "b"])


def test_busy_entities_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(detectors, "SLICE", 1)
    rng = random.Random(9)
    rows = [("e", rng.choice(detectors.KINDS), minutes(rng.randrange(60 * 24 * 4)), str(i), False) for i in range(700)]
    got = detectors.fusion_events(spark.createDataFrame(rows, "entity_id string, kind string, ts timestamp_ntz, id string, injected boolean"), 30).collect()
    own = [((t - T0).total_seconds(), k) for _, k, t, *_ in rows]
    assert {((r["window_start"] - T0).total_seconds() + 1800, r["bank_count"] + r["call_count"] + r["session_count"]) for r in got} == set(greedy(own, 1800))


@pytest.mark.parametrize("header", [["Value Date", "Txn Date", "Chq Value Date", "Ref No", "WDL", "Credit.", "Closing"], ["Date", "Date", "Particulars", None, "value", "Debit/Credit", "x"]])
def test_column_roles(header):
    roles = {"Value Date": "value_date", "Txn Date": "date", "Chq Value Date": "chq_ref", "Ref No": "chq_ref", "WDL": "withdrawal", "Credit.": "deposit", "Closing": "balance", "Date": "date", "Particulars": "narration", "Debit/Credit": "withdrawal"}
    assert statements.column_roles(header) == {roles[h]: i for i, h in enumerate(header) if h in roles}


def test_place_columns(spark):
    assert shaping.place_columns(["Receiver_Lat", "sender_lat", "Lon", "x"]) == ("sender_lat", "Lon")
    assert shaping.place_columns(["Lat", "x"]) is None
    assert shaping.ledger_points(spark.createDataFrame([("1",)], "Sender_Phone_Number string"), None).count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "y"), (3, "c", "z"), (None, "c", "z")], "k long, v string, w string")
    assert [r["k"] for r in shaping.complete(df).collect()] == [3] and shaping.complete(df, "v").count() == 3
    assert shaping.first_columns(shaping.prefixed(shaping.without(df, "w", "q"), "p_", keep=("k",)), "p_v").columns == ["p_v", "k"]
    some = spark.createDataFrame([(1,), (None,), (9,)], "k long")
    assert sorted(r["k"] for r in shaping.members(df, "k", some).collect()) == [1]
    assert sorted(r["k"] or 0 for r in shaping.members(df, "k", some, inside=False).collect()) == [0, 2, 3]
    changed = shaping.updated(df, F.col("v") == "c", v=F.col("w"), w=F.col("v")).where("k = 3").first()
    assert (changed["v"], changed["w"]) == ("z", "c")
    first = shaping.first_match(df, spark.createDataFrame([(3, 5, "late"), (3, 4, "soon")], "k long, at long, what string"), "k", "at").where("k = 3").first()
    assert (first["first_at"], first["first_what"]) == (4, "soon")


def test_channels_and_names(spark):
    df = spark.range(4000).select("id", F.lit("IMPS").alias("imps"), F.lit("other").alias("other"), F.lit("Rahul Sharma").alias("name"))
    got = df.select(ids.channel_of_mode("imps", "id").alias("i"), ids.channel_of_mode("other", "id").alias("o"), ids.name_variant("name", "id").alias("n")).toPandas()
    assert abs((got.i == "Mobile_App").mean() - 0.7) < 0.05 and set(got.i) == {"Mobile_App", "Net_Banking"}
    assert abs((got.o == "Branch").mean() - 0.1) < 0.03 and set(got.n) == {"Rahul Sharma", "Rahul S.", "rahul sharma", "Rahul"}
    assert [tuple(r) for r in spark.createDataFrame([(None,), ("Asha",)], "n string").select(ids.name_variant("n", F.lit(1))).collect()] == [("Unknown",), ("Asha",)]


def test_inferred_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,t,s,empty\n1,1.5,2025-01-02 03:04:05,a,\nNULL,2,NaN,1,NULL\n")
    df = tables.read_inferred(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "timestamp_ntz", "string", "string"]
    assert df.where("n is null and t is null and empty is null").count() == 1
    assert tables.read_inferred(spark, str(tmp_path / "a.csv"), dates=False).dtypes[2][1] == "string"
    assert tables.read_inferred(spark, str(tmp_path / "a.csv"), dates=False, parse_dates=("t",)).dtypes[2][1] == "timestamp_ntz"


def test_dossier(spark):
    none = "array<string>"
    found = spark.createDataFrame([("phone:1", ["1"], [], ["h@ok"], [], ["asha"], [], ["9.9.9.9", "1.1.1.1"]), ("phone:2", ["2"], [], [], [], [], [], [])], f"entity_id string, phones {none}, accounts {none}, upis {none}, imeis {none}, names {none}, cities {none}, ips {none}")
    points = lambda *rows: spark.createDataFrame(list(rows), "entity_id string, points double")
    nothing = points(("phone:0", 0.0)).where("false")
    risk = entities.entity_risk(points(("phone:1", 150.0)), points(("phone:1", 12.5)), points(("phone:1", 8.0)), nothing, nothing)
    mules = spark.createDataFrame([("phone:1", "77", "bank a", 1234.5, 1000.0, 3, 4, 12.5), ("phone:1", "78", None, 1.0, 1.0, 1, 2, 99.0)], "entity_id string, account string, bank_name string, money_in double, money_out double, in_degree long, out_degree long, risk_score double")
    farms = spark.createDataFrame([("phone:1", "35", 6, list("abcdef"), "critical", 8.0)], f"entity_id string, imei string, sim_count long, msisdns {none}, risk_tier string, risk_score double")
    windows = spark.createDataFrame([("phone:1", minutes(i), minutes(60 + i), 1, 1, 1, i == 3, 50 + 100 * (i == 3)) for i in range(12)], "entity_id string, window_start timestamp_ntz, window_end timestamp_ntz, bank_count long, call_count long, session_count long, is_injected boolean, risk_score int")
    got = entities.dossier(found, risk, mules, farms, windows)
    texts = {r["entity_id"]: r["report"] for r in got.collect()}
    one = texts["phone:1"].split("\n")
    assert one[:2] == ["# Suspicious transaction report STR-20250101-phone:1", "## A. Subject"] and "| Handles | h@ok |" in one and "| Cities | *Not found in dataset* |" in one
    assert "Score 170.50, tier HIGH" in one
    at = one.index("| 78 |  | 1.00 | 1.00 | 1 | 2 | 99.00 |")
    assert one[at + 1] == "| 77 | bank a | 1,234.50 | 1,000.00 | 3 | 4 | 12.50 |" and "| 35 | 6 | a, b, c, d, e... | CRITICAL | 8.00 |" in one
    assert one[one.index("Addresses") + 1 :][:2] == ["- 1.1.1.1", "- 9.9.9.9"]
    timeline = one[one.index("## D. Timeline") + 1 : one.index("## E. Next steps")]
    assert len(timeline) == 10 and timeline[0] == "2025-03-01T12:03:00 to 2025-03-01T13:03:00: risk 150, 1 bank, 1 call, 1 session (injected)" and timeline[1].startswith("2025-03-01T12:00:00")
    assert "- Seize the shared handsets." in one and "- Watch the shared places." not in one
    assert "## D. Timeline" not in texts["phone:2"] and "Nothing was found by rule" in texts["phone:2"]
    assert entities.report_of(got).first()["report"] == texts["phone:1"] and entities.report_of(got, "phone:2").first()["report"] == texts["phone:2"]
    assert entities.report_of(got, "phone:9").first()["report"] == "Entity phone:9 not found" and entities.report_of(got.where("false")).first()["report"] == "No entities"


def test_travel_needs_time_between(spark):
    rows = [("e", minutes(0), 10.0, 70.0, "cdr", 1), ("e", minutes(0), 20.0, 80.0, "cdr", 2), ("e", minutes(60), 10.0, 70.0, "cdr", 3), ("e", minutes(61), 10.0, 70.1, "cdr", 4)]
    got = detectors.impossible_travel(spark.createDataFrame(rows, "entity_id string, ts timestamp_ntz, lat double, lon double, source string, event_id long")).collect()
    assert [(r["from_event"], r["to_event"], r["severity"]) for r in got] == [(2, 3, "critical")]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001"
    batch = streaming.counts(spark.read.parquet(f"{path}/events.parquet"))
    stream = streaming.stream_counts(spark, path, "events.parquet")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "y")], "k int, v string")
    assert {r["column_name"]: r["nulls"] for r in audit.null_profile(df).collect()} == {"k": 0, "v": 1}
    assert [r["k"] for r in audit.violations(df, "k", "v").collect()] == [2]
