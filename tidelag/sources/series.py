"""Series made of the star-schema tables: one row for each day or hour, of a group if asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """day, t (days since the first), y (line items shipped), x (their mean discount in per cent), q (mean quantity)."""
    rows = table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    out = rows.agg(F.count("*").alias("y"), (100 * F.avg("l_discount")).alias("x"), F.avg("l_quantity").alias("q"))
    first = out.agg(F.min("day").alias("first"))
    return out.crossJoin(F.broadcast(first)).select("day", F.datediff("day", "first").alias("t"), "y", "x", "q")  # one row


def daily_grouped(spark: SparkSession, folder: str) -> DataFrame:
    """g (return flag), day, y, x, q."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.to_date("l_shipdate").alias("day"))
    return rows.agg(F.count("*").alias("y"), (100 * F.avg("l_discount")).alias("x"), F.avg("l_quantity").alias("q"))


def orders_daily(spark: SparkSession, folder: str) -> DataFrame:
    """day, y (orders), x (mean price in thousands); days without orders have no row."""
    rows = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return rows.agg(F.count("*").alias("y"), (F.avg("o_totalprice") / 1000).alias("x"))


def hourly(spark: SparkSession, folder: str, group: bool = False) -> DataFrame:
    """h (hour), y (events), x (mean value), and g (event type) if grouped."""
    key = [F.col("event_type").alias("g")] if group else []
    rows = table(spark, folder, "events").groupBy(*key, F.date_trunc("hour", "ts").alias("h"))
    return rows.agg(F.count("*").alias("y"), F.avg("value").alias("x"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """subject (customer), t (year from 1), x (price of that year's orders in thousands)."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("subject"), (F.year("o_orderdate") - 1991).alias("t"), "o_totalprice")
    return rows.groupBy("subject", "t").agg((F.sum("o_totalprice") / 1000).alias("x"))


def risk_sets(spark: SparkSession, folder: str) -> DataFrame:
    """stratum (order), case (returned), x (discount in per cent), q (quantity) of orders with both kinds of lines."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("stratum"), (F.col("l_returnflag") == "R").cast("int").alias("case"), (100 * F.col("l_discount")).alias("x"), F.col("l_quantity").alias("q"))
    mixed = rows.groupBy("stratum").agg(F.sum("case").alias("c"), F.count("*").alias("n")).filter("c > 0 AND c < n").select("stratum")
    return rows.join(mixed, "stratum")
