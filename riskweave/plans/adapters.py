"""Transactions made from the event and order tables, so that every operator has input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accounts that counterparties are drawn from.
PARTNERS = 150


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event; k is the number in its props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = e.withColumn("k", k)
    kinds = ("retail", "electronics", "travel", "crypto", "gaming", "utilities")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("account_id"), F.concat(F.lit("U"), ((F.col("k") * 7 + F.col("event_id")) % PARTNERS).cast("string")).alias("counterparty_account_id"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("amount"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") % 6 + 1).cast("int")).alias("merchant_category"),
        F.when(F.col("event_type") == "purchase", "wire").otherwise(F.col("event_type")).alias("channel"), F.concat(F.lit("D"), F.col("k").cast("string")).alias("device_id"), F.concat(F.lit("I"), (F.col("event_id") % 2003).cast("string")).alias("ip_address"),
        F.when(F.col("k") % 3 != 0, F.col("k") * 10.0).alias("balance"), ((F.col("event_type") == "error") & (F.col("value") >= 100)).cast("int").alias("label"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order; times are whole days, so accounts have ties."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_id"), F.concat(F.lit("C"), ((F.col("o_orderkey") * 7) % 1000).cast("string")).alias("counterparty_account_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("channel"), F.concat(F.lit("D"), (F.col("o_orderkey") % 997).cast("string")).alias("device_id"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("label"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with three plain scores, for the operators that come after models."""
    tx = events(spark, sf_dir)
    return tx.withColumns({"s_supervised": F.col("amount") / 500, "s_anomaly": F.abs(F.col("amount") - 250) / 250, "s_graph": F.log1p(F.coalesce(F.col("balance"), F.lit(0.0)))})


EVENTS_SQL = f"""
    raw AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
    tx AS (SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'U' || user_id AS account_id, 'U' || ((k * 7 + event_id) % {PARTNERS}) AS counterparty_account_id, ts AS timestamp, value AS amount,
        ['retail', 'electronics', 'travel', 'crypto', 'gaming', 'utilities'][k % 6 + 1] AS merchant_category, CASE WHEN event_type = 'purchase' THEN 'wire' ELSE event_type END AS channel,
        'D' || k AS device_id, 'I' || (event_id % 2003) AS ip_address, CASE WHEN k % 3 <> 0 THEN k * 10.0::DOUBLE END AS balance,
        CASE WHEN event_type = 'error' AND value >= 100 THEN 1 ELSE 0 END AS label FROM raw)"""
ORDERS_SQL = """
    tx AS (SELECT o_orderkey AS transaction_id, 'C' || o_custkey AS account_id, 'C' || ((o_orderkey * 7) % 1000) AS counterparty_account_id, o_orderdate AS timestamp, o_totalprice AS amount,
        o_orderpriority AS channel, 'D' || (o_orderkey % 997) AS device_id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders)"""
SCORED_SQL = EVENTS_SQL + """,
    scored AS (SELECT *, amount / 500 AS s_supervised, abs(amount - 250) / 250 AS s_anomaly, ln(1 + coalesce(balance, 0)) AS s_graph FROM tx)"""
