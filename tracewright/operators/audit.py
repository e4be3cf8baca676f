"""Profiles, overlaps and pattern counts of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.detectors import micros
from tracewright.session import staged


def null_profile(df: DataFrame) -> DataFrame:
    """Rows and nulls of every column, in one aggregation."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))
    return one.unpivot(["_rows"], df.columns, "column_name", "nulls").select("column_name", F.col("_rows").alias("rows"), "nulls")


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """dtype, nulls, distinct values and the smallest value (50 characters) of every column."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), distinct(c).alias("n_distinct"), F.substring(F.min(c).cast("string"), 1, 50).alias("sample")) for c, t in df.dtypes)).alias("p"))
    return one.select(F.explode("p").alias("x")).select("x.*")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: breaches of key -> value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def duplicates(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*columns)).alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def overlap(**sets: DataFrame) -> DataFrame:
    """How many values each combination of the (one-column) sets shares."""
    every = None
    for name, df in sets.items():
        own = df.select(F.col(df.columns[0]).cast("string").alias("value"), F.lit(name).alias("set"))
        every = own if every is None else every.unionByName(own)
    return every.where("value is not null").groupBy("value").agg(F.array_join(F.sort_array(F.collect_set("set")), "+").alias("sets")).groupBy("sets").agg(F.count("*").alias("n"))


def structuring(df: DataFrame, amount: str, bands=((9000, 10000), (45000, 50000))) -> DataFrame:
    band = None
    for low, high in bands:
        hit = (F.col(amount) >= low) & (F.col(amount) < high)
        band = F.when(hit, f"{low}-{high}") if band is None else band.when(hit, f"{low}-{high}")
    return df.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("n"))


def night_activity(df: DataFrame, key: str, ts: str) -> DataFrame:
    night = (F.hour(ts) >= 23) | (F.hour(ts) <= 5)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(night, 1)).alias("n_night"))


def rapid_gap(df: DataFrame, key: str, ts: str, tie: str, seconds: int = 3600) -> DataFrame:
    """Rows whose next of the same key follows within the time."""
    after = F.lead(micros(ts)).over(Window.partitionBy(key).orderBy(ts, tie))
    return df.withColumn("_gap", after - micros(ts)).where(F.col("_gap") < seconds * 1_000_000).groupBy(key).agg(F.count("*").alias("n"))


def rapid_in_out(ledger: DataFrame, seconds: int) -> DataFrame:
    """Accounts that send within the time after receiving: the strict variant."""
    moves = ledger.select(F.explode(F.array(F.struct(F.col("dst").alias("account"), F.lit(1).alias("received"), F.col("ts"), F.col("id")), F.struct(F.col("src").alias("account"), F.lit(0).alias("received"), F.col("ts"), F.col("id")))).alias("m")).select("m.*")
    by = Window.partitionBy("account").orderBy(micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return moves.withColumn("before", F.max("received").over(by)).where("received = 0 and before = 1").groupBy("account").agg(F.count("*").alias("n"))


def reciprocal(edges: DataFrame) -> DataFrame:
    """Ordered pairs with transfers both ways; a loop counts once."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("amount").alias("amount_back"))
    return edges.join(back, ["src", "dst"]).select("src", "dst", "amount", "amount_back")


def cycles3(edges: DataFrame) -> DataFrame:
    """Cycles a -> b -> c -> a of three accounts, each once, from its smallest account."""
    e = edges.where("src <> dst").select("src", "dst")
    ab, bc, ca = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("c", "a")
    return ab.where("a < b").join(bc, "b").where("a < c and b <> c").join(ca, ["c", "a"], "left_semi").select("a", "b", "c")


def coincidences(bank: DataFrame, calls: DataFrame, sessions: DataFrame, minutes: int = 30) -> DataFrame:
    """Transfers with a call and a session of the same phone within the time. Inputs: phone, ts, id.

    Both sides carry the bucket of the time's width, transfers also its
    neighbours, so the join has an equality on time and no hot phone meets all
    its rows.
    """
    width = minutes * 60_000_000

    def kept(left: DataFrame, right: DataFrame) -> DataFrame:
        near = right.select(F.col("phone").alias("p2"), micros("ts").alias("u2")).withColumn("b2", F.explode(F.array(*(F.floor(F.col("u2") / width) + d for d in (-1, 0, 1)))))
        hit = left.join(near, (F.col("phone") == F.col("p2")) & (F.floor(F.col("us") / width) == F.col("b2")) & (F.abs(F.col("us") - F.col("u2")) <= width), "left_semi")
        return hit

    rows = bank.withColumn("us", micros("ts"))
    return kept(kept(rows, calls), sessions).drop("us")


def call_quality(calls: DataFrame) -> DataFrame:
    """One row: missed and failed calls and those of them without length; completed calls, and those whose length differs from their ends by over a second."""
    length, status, kind = F.col("Call_Duration_Seconds"), F.col("Call_Status"), F.col("Call_Type")
    missed, failed = kind == "Missed", status == "Failed"
    completed = (status == "Completed") & kind.isin("Incoming", "Outgoing")
    between = (micros("Call_End_Time") - micros("Call_Start_Time")) / 1_000_000
    return calls.agg(
        F.count_if(missed).alias("missed"), F.count_if(missed & (length == 0)).alias("missed_without_length"),
        F.count_if(failed).alias("failed"), F.count_if(failed & (length == 0)).alias("failed_without_length"),
        F.count_if(completed).alias("completed"), F.count_if(completed & (F.abs(length - between) > 1)).alias("mismatched"),
    )


def described(df: DataFrame, *columns: str, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest of numeric columns. ``exact=False``: quartiles by sketches of bounded size, for tables too large for exact ones."""
    at = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))

    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        quartiles = F.percentile(v, at) if exact else F.percentile_approx(v, at)
        parts = {"n": F.count(v), "mean": F.avg(v), "deviation": F.stddev_samp(v), "least": F.min(v), "greatest": F.max(v)}
        return F.struct(F.lit(c).alias("column_name"), *(x.alias(n) for n, x in parts.items()), quartiles.alias("q"))

    made = df.agg(F.array(*map(one, columns)).alias("p")).select(F.explode("p").alias("x")).select("x.*")
    return made.select("column_name", "n", "mean", "deviation", "least", *(F.col("q")[i].alias(n) for i, n in enumerate(("quarter", "half", "three_quarters"))), "greatest")


def reconciled(chains: DataFrame, length: str, rows: DataFrame, flag: Column) -> DataFrame:
    """One row: the sum of the chains' lengths, the flagged rows, and whether they agree."""
    summed = chains.agg(F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("in_chains"))
    return summed.join(rows.agg(F.count_if(flag).alias("flagged"))).withColumn("agree", F.col("in_chains") == F.col("flagged"))  # a row each


def verified_overlap(persons: DataFrame, **sets: DataFrame) -> DataFrame:
    """Each person (person, phone) and whether the phone is in each of the one-column sets."""
    for name, df in sets.items():
        own = df.select(F.col(df.columns[0]).alias(f"_{name}")).where(F.col(f"_{name}").isNotNull()).distinct()
        persons = persons.join(own, F.col("phone") == F.col(f"_{name}"), "left").withColumn(f"in_{name}", F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    return persons


def running_balance(df: DataFrame, key: str, ts: str, tie: str, signed: str, start: float = 0.0) -> DataFrame:
    by = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("balance", F.lit(start) + F.sum(F.col(signed).cast("decimal(18,2)")).over(by).cast("double"))


def sequential_ids(df: DataFrame, *order: str, prefix: str = "TXN", digits: int = 10) -> DataFrame:
    """Ids in the order of the columns. Ranges of the order are numbered apart, then shifted by the counts before them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a range
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_p").withColumn("seq_id", F.concat(F.lit(prefix), F.lpad((F.col("_before") + F.col("_own")).cast("string"), digits, "0"))).drop("_p", "_own", "_before")


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    columns = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def top_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
