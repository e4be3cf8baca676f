"""The driver's tables in the shapes of the library's inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import scratch_dir
from tracewright.sources import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prop(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("int")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "bank").when(F.col("event_type").isin("signup", "error"), "call").otherwise("session")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), kind.alias("kind"), "ts", F.col("event_id").alias("id"), (prop() == 7).alias("injected"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    src, dst = F.col("o_custkey") % 400, F.col("l_partkey") % 400
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(src.alias("src"), dst.alias("dst"), F.col("l_extendedprice").alias("amount"), status.alias("status"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("bank"), (src % 7).cast("string")).alias("src_bank"), F.concat(F.lit("bank"), (dst % 7).cast("string")).alias("dst_bank"), F.col("l_orderkey").alias("id"))


def device_pairs(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(only).select("l_orderkey", "l_partkey", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").cast("string").alias("imei"), F.col("o_custkey").cast("string").alias("msisdn"), F.when(F.col("l_linestatus") == "O", "cdr").otherwise("ipdr").alias("source"))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = prop()
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts", (8 + (29 * k % 2900) / 100.0).alias("lat"), (68 + ((53 * k + F.col("user_id")) % 2900) / 100.0).alias("lon"), F.lit("cdr").alias("source"), F.col("event_id"))


def identity_edges(spark: SparkSession, sf_dir: str, only: str = "true") -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(only).select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("phone:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("imei:"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


def as_csv(df: DataFrame, name: str) -> str:
    """Writes rows as CSV with a header into the scratch folder, for the loaders to read; returns the path."""
    path = f"{scratch_dir(df.sparkSession)}/csv-{uuid.uuid4().hex}/{name}"
    df.write.option("header", True).csv(path)
    return path


def investigation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as a ledger, events as calls and sessions, in the loaders' columns. Users share a handset and an address by threes."""
    phone = lambda c: (F.lit(9000000000) + F.col(c)).cast("string")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    bank = o.select(text("T", F.col("o_orderkey")).alias("Transaction_ID"), F.col("o_orderdate").cast("string").alias("Timestamp"), F.concat(phone("o_custkey"), F.lit(".0")).alias("Sender_Phone_Number"), F.concat(phone("o_custkey"), F.lit("@ok")).alias("Sender_UPI_ID"), text("A", c).alias("Sender_Account_Number"), text("City ", c % 5).alias("Sender_City"), text("Name ", c).alias("Sender_Customer_Name"))
    e = table(spark, sf_dir, "events")
    u, three = F.col("user_id"), F.floor(F.col("user_id") / 3)
    imei = F.concat((F.lit(351000000000000) + three).cast("string"), F.lit(".0"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    calls = e.where("event_type in ('signup', 'error')").select(text("C", F.col("event_id")).alias("CDR_ID"), at.alias("Call_Start_Time"), phone("user_id").alias("Caller_MSISDN"), F.concat((F.lit(9000000000) + (u + 1)).cast("string")).alias("Receiver_MSISDN"), imei.alias("IMEI"), text("City ", u % 7).alias("Tower_City"), text("Net ", u % 4).alias("Network_Provider"), text("Caller ", u).alias("Caller_Name"))
    sessions = e.where("event_type not in ('signup', 'error')").select(text("S", F.col("event_id")).alias("IPDR_ID"), at.alias("Session_Start_Time"), phone("user_id").alias("User_MSISDN"), imei.alias("IMEI"), F.concat(F.lit("49.1."), three.cast("string"), F.lit(".1")).alias("Public_IP_Address"), F.concat(F.lit("10.0.0."), u.cast("string")).alias("Private_IP_Address"), text("D", u).alias("Device_ID"))
    return tables.by_name(bank, tables.BANK), tables.by_name(calls, tables.CALLS), tables.by_name(sessions, tables.SESSIONS)
