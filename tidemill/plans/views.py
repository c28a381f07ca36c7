"""The driver's tables seen as trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as canonical trades with their arrival."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 3 == 0, "B").otherwise("F").alias("exchange"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.col("value").alias("price"), (F.col("user_id") % 100 + 1).alias("quantity"), F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("trade_id"), (F.col("event_id") % 15).cast("int").alias("trade_type"),
        F.col("user_id").cast("int").alias("buy_agent_id"), F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 7).cast("int")).alias("sell_agent_id"), (F.col("event_id") % 4).alias("flags"), F.col("event_id").alias("arrival"), F.lit(0).alias("sequence_within_ns"),
    )


TICKS_SQL = """ticks AS (SELECT event_type AS symbol, CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'F' END AS exchange, epoch_us(ts) * 1000 AS timestamp_ns, value AS price,
  user_id % 100 + 1 AS quantity, CASE WHEN event_id % 10 <> 0 THEN event_id END AS trade_id, CAST(event_id % 15 AS INT) AS trade_type, CAST(user_id AS INT) AS buy_agent_id,
  CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 7 AS INT) END AS sell_agent_id, event_id % 4 AS flags, event_id AS arrival, 0 AS sequence_within_ns FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as trades with many equal times; arrival: all columns, so equal rows are interchangeable."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").cast("string").alias("symbol"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("timestamp_ns"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("long").alias("quantity"),
        F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")).alias("trade_id"), F.col("l_linenumber").alias("buy_agent_id"), F.col("l_partkey").alias("sell_agent_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("arrival"),
    )


LINES_SQL = """lines AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, epoch_us(l_shipdate) * 1000 AS timestamp_ns, l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS quantity,
  CASE WHEN l_linenumber > 2 THEN l_orderkey END AS trade_id, l_linenumber AS buy_agent_id, l_partkey AS sell_agent_id,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS arrival FROM lineitem)"""


def contracts(spark: SparkSession) -> DataFrame:
    """Three contracts per root over the month of ``events``; each event type is one root's code."""
    return spark.sql(CONTRACTS)


CONTRACTS = """SELECT root AS symbol_root, code AS contract_code, CAST(a AS DATE) AS vigent_from, CAST(b AS DATE) AS vigent_until FROM (VALUES
  ('R', 'click', '2024-01-01', '2024-01-10'), ('R', 'view', '2024-01-11', '2024-01-20'), ('R', 'purchase', '2024-01-18', '2024-02-10'), ('R', 'none', '2024-02-01', '9999-12-31'), ('S', 'signup', '1900-01-01', '9999-12-31')) AS t(root, code, a, b)"""
