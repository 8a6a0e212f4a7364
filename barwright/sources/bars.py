"""Bars from event tables, and readers and writers for tables of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import KEYS, OHLCV


def build_bars(rows: DataFrame, series: Column, date: Column, price: Column, order: Column) -> DataFrame:
    """One row a series and period: open and close by `order`, high, low, and the count as volume."""
    at = rows.select(series.alias("series"), date.alias("date"), price.cast("double").alias("p"), order.alias("o"))
    return at.groupBy(*KEYS).agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def daily_order_bars(spark: SparkSession, sf_dir: str, panel: bool = False) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    series = F.col("o_orderpriority") if panel else F.lit("ALL")
    return build_bars(orders, series, F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def hourly_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return build_bars(events, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.col("ts"))


def normalise(rows: DataFrame, date: str, series: str | None = None) -> DataFrame:
    """Bars from a table with any of the OHLCV columns in any case; NaN becomes NULL; no rows is an error."""
    have = {c.lower(): c for c in rows.columns}
    columns = [F.nanvl(F.col(have[c]).cast("double"), F.lit(None)).alias(c) for c in OHLCV if c in have]
    if not columns:
        raise ValueError("no price columns")
    out = rows.select((F.col(series) if series else F.lit("ALL")).alias("series"), F.to_date(date).alias("date"), *columns)
    if out.isEmpty():
        raise ValueError("no rows")
    return out


def cached_table(spark: SparkSession, path: str, make) -> DataFrame:
    """Reads the Parquet table at `path`; where there is none, writes make() there first. The path names the content."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        write_table(make(), path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
