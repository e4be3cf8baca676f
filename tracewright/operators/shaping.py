"""Columns dropped, prefixed, ordered and rewritten; lookups and first matches."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.sources.tables import PLACES

PLACE_ROWS = "entity_id string, ts timestamp_ntz, lat double, lon double, source string, event_id string, city string"


def without(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` without the columns, as far as it has them."""
    return df.drop(*columns)


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns renamed, but those to ``keep``."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def first_columns(df: DataFrame, *columns: str) -> DataFrame:
    """These columns first, the rest after them in their order."""
    return df.select(*columns, *(c for c in df.columns if c not in columns))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without null in the columns; in any column if none is named."""
    return df.na.drop(how="any", subset=list(columns) or None)


def updated(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """The columns set where ``when`` holds, from the row as it was; null counts as no."""
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def members(df: DataFrame, column: str, of: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose value is (or isn't) among those of the one-column ``of``; null is in no set."""
    values = of.select(F.col(of.columns[0]).alias("_value"))
    return df.join(values, F.col(column) == F.col("_value"), "left_semi" if inside else "left_anti")


def mapped_value(column: Column | str, table: dict, default=None) -> Column:
    """The value's entry in a small fixed table, else ``default``."""
    found = F.create_map(*(F.lit(x) for x in chain(*table.items())))[F.col(column) if isinstance(column, str) else column]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def with_master(df: DataFrame, master: DataFrame, key: str, **sides: str) -> DataFrame:
    """``df`` with the master's columns once for each side: prefix=column that holds the key. The keys of the master go."""
    for prefix, column in sides.items():
        own = prefixed(master, f"{prefix}_")
        df = df.join(own, F.col(column) == F.col(f"{prefix}_{key}"), "left").drop(f"{prefix}_{key}")
    return df


def first_match(df: DataFrame, other: DataFrame, key: str, *order: str, prefix: str = "first_") -> DataFrame:
    """Each row with the first row of ``other`` of its key in the given order; null where none is."""
    columns = [c for c in other.columns if c != key]
    # an aggregate with map-side combine, not a ranking window: a key of very many rows doesn't gather
    first = other.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    joined = df.join(first, F.col(key) == F.col("_key"), "left")
    return joined.select(*df.columns, *(F.col("_first")[c].alias(f"{prefix}{c}") for c in columns))


def most_frequent(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with their counts; ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def filled_up(chosen: DataFrame, df: DataFrame, key: str, n: int) -> DataFrame:
    """All of ``chosen``, then the most frequent other values of ``df`` until there are ``n``."""
    first = chosen.select(F.col(chosen.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("origin", F.lit("chosen"))
    rest = most_frequent(members(df.where(F.col(key).isNotNull()), key, first, inside=False), key, n).select(key, F.lit("frequent").alias("origin"), "n")
    ranked = rest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))  # n rows at most
    room = F.lit(n) - F.lit(first.count())
    return first.unionByName(ranked.where(F.col("place") <= room).select(key, "origin"))


def place_columns(columns: list[str], side: str = "sender") -> tuple[str, str] | None:
    """Names of the latitude and longitude columns: the last that names the side, else the first of its kind; None if either lacks."""
    found = []
    for part in PLACES:
        fitting = [c for c in columns if part in c.lower()]
        of_side = [c for c in fitting if side in c.lower()]
        found += of_side[-1:] or fitting[:1]
    return tuple(found) if len(found) == len(PLACES) else None


def ledger_points(bank: DataFrame, phones: DataFrame) -> DataFrame:
    """Transfers with a place as points of the sender's entity; no rows where the table has no place columns. ``phones``: phone, entity_id."""
    places = place_columns(bank.columns)
    if places is None:
        return bank.sparkSession.createDataFrame([], PLACE_ROWS)
    lat, lon = (F.col(c).cast("double") for c in places)
    rows = bank.where(lat.isNotNull() & lon.isNotNull() & F.col("Timestamp").isNotNull())
    city = F.col("Sender_City") if "Sender_City" in bank.columns else F.lit(None).cast("string")
    joined = rows.join(phones.select(F.col("phone").alias("_phone"), "entity_id"), F.col("Sender_Phone_Number") == F.col("_phone"))
    return joined.select("entity_id", F.col("Timestamp").alias("ts"), lat.alias("lat"), lon.alias("lon"), F.lit("bank").alias("source"), F.col("Transaction_ID").cast("string").alias("event_id"), city.alias("city"))


def sampled(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows, the same for the same keys and seed, however the rows are spread."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order that tells nothing, the same for the same keys and seed."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)


def chains(seeds: DataFrame, hops: int, factor: float = 0.9, least: int = 30, most: int = 600) -> DataFrame:
    """Chains of transfers for fixtures: each seed (id, src, dst, ts, amount), then ``hops`` more, in each of which the last receiver sends on.

    The n-th comes ``least`` to ``most`` seconds after the one before, by arithmetic on id and hop, with ``factor`` of its amount.
    """
    step = lambda k: F.lit(least) + (F.col("id") * 7919 + k * 104_729) % (most - least + 1)
    rows = seeds.withColumn("hop", F.explode(F.sequence(F.lit(0), F.lit(hops))))
    waited = F.aggregate(F.sequence(F.lit(0), F.col("hop")), F.lit(0).cast("bigint"), lambda a, k: a + F.when(k > 0, step(k)).otherwise(0))
    rows = rows.withColumn("waited", waited)
    name = lambda k: F.concat("dst", F.when(k > 0, F.concat(F.lit("#"), k.cast("string"))).otherwise(""))
    src = F.when(F.col("hop") == 0, F.col("src")).otherwise(name(F.col("hop") - 1))
    return rows.select(F.concat("id", F.lit("-"), F.col("hop").cast("string")).alias("id"), src.alias("src"), name(F.col("hop")).alias("dst"), (F.col("ts") + F.make_dt_interval(secs=F.col("waited").cast("decimal(18,6)"))).alias("ts"), F.round(F.col("amount") * F.pow(F.lit(factor), F.col("hop")), 6).alias("amount"))
