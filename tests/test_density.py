"""Density clusters against textbook clustering, where cells are dense, sparse, or just apart."""

import math
import os
import random

import pytest

from tests.test_operators import textbook
from tracewright.operators import density, detectors
from tracewright.session import scratch_dir, staged

EPS = 0.5


def days():
    rng = random.Random(7)
    cube = lambda n, size, x=0.0: [(x + rng.random() * size, rng.random() * size, rng.random() * size) for _ in range(n)]
    yield from (cube(n, size) for n, size in ((150, 3.0), (400, 3.0), (300, 1.5), (120, 6.0)))
    # two slabs of dense cells whose faces are hardly nearer or further than eps
    for gap in (EPS, math.nextafter(EPS, 1), EPS * (1 - 1e-9), EPS * (1 + 1e-9), EPS * 1.02):
        face = [(0.0, rng.random(), rng.random()) for _ in range(80)]
        yield [*face, *((-p[0] - rng.random() * 0.1, p[1], p[2]) for p in face), *((gap, p[1], p[2]) for p in face), *((gap + rng.random() * 0.1, p[1], p[2]) for p in face)]
    yield [(i * 0.25, j * 0.25, k * 0.5) for i in range(7) for j in range(7) for k in range(4)]  # many exactly eps apart
    yield [(i * EPS, 0.0, 0.0) for i in range(40)]
    yield [(x, 0.0, 0.0) for x in (0.0, EPS, 2 * EPS, 10.0, math.nextafter(10.5, 11)) for _ in range(4)]  # piles of equal points
    yield [(x, 0.0, 0.0) for x in (0.0, 0.0, 0.0, EPS, 2 * EPS, 2 * EPS, 2 * EPS)]  # a point that joins, or borders on two
    yield [(x, 0.0, 0.0) for x in (0.0, 0.1, 0.2, 0.65, 1.1, 1.2, 1.3)]
    yield [*cube(60, 0.2), *cube(60, 0.2, 0.7), *cube(2, 0.2, 1.3), *cube(60, 0.2, 3.0)]


@pytest.mark.parametrize(("least", "compared"), [(3, density.COMPARED), (4, 0), (1, 0)])
def test_clusters_are_those_of_the_textbook(spark, monkeypatch, least, compared):
    monkeypatch.setattr(density, "COMPARED", compared)
    monkeypatch.setattr(density, "LEVELS", 8)  # the points of what is open then are compared
    rows, want = [], {}
    for day, points in enumerate(days()):
        random.Random(day).shuffle(points)
        first = len(rows)
        label = textbook(points, EPS, least)
        core = [sum(sum((a - b) ** 2 for a, b in zip(p, q)) <= EPS * EPS for q in points) >= least for p in points]
        name = {k: first + min(i for i, x in enumerate(label) if x == k and core[i]) for k in set(label) - {None}}
        want |= {first + i: name[k] for i, k in enumerate(label) if k is not None}
        rows += [(day, first + i, *map(float, p)) for i, p in enumerate(points)]
    nulls = [(0, -1, None, 0.0, 0.0), (None, -2, 0.0, 0.0, 0.0), (99, -3, math.nan, 0.0, 0.0), (99, -4, math.nan, 0.0, 0.0), (99, -5, math.nan, 0.0, 0.0)]
    df = spark.createDataFrame(rows + nulls, "day int, ord long, x double, y double, t double")
    got = {r["ord"]: r["cluster"] for r in density.clusters(staged(df, "points"), EPS, least).collect() if r["day"] != 99}
    assert got == want


def test_a_dense_day_is_written_once(spark):
    """20,000 points in a few cells have many millions of near pairs, none of which is written."""
    df = spark.range(20000).selectExpr("id as ord", "id % 49 as entity_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 60) as ts", "20 + (id % 7) * 0.0001 + if(id % 100 = 0, 1, 0) as lat", "75 + (id % 11) * 0.0001 as lon")
    df = df.selectExpr("ord", "entity_id", "ts", "cast(lat as double) as lat", "cast(lon as double) as lon")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(scratch_dir(spark).removeprefix("file:")) for f in files)
    before = size()
    found = detectors.co_location(df)
    assert sum(r["point_count"] for r in found.collect()) == 20000
    assert size() - before < 4_000_000


def test_farms_with_lists_shuffle_once(spark):
    """The numbers of a handset are counted from their list, not shuffled pair by pair beside it."""
    pairs = spark.createDataFrame([("i", "a", "cdr"), ("i", "b", "ipdr"), ("i", "a", "cdr"), ("i", None, "cdr")], "imei string, msisdn string, source string")
    found = detectors.device_farms(pairs, top_n=None)
    assert [(r["sim_count"], r["msisdns"], r["total_record_count"]) for r in found.collect()] == [(2, ["a", "b"], 3)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Aggregate(") == 2
