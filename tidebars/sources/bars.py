"""Bars (symbol, ts, open, high, low, close, volume, rn) from event tables, and coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions.rolling import bar


def bucket(ts: str | Column, seconds: int) -> Column:
    """Start of the bucket, counted from the epoch, without a time zone."""
    t = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")
    return F.window(t, f"{seconds} seconds")["start"].cast("timestamp_ntz")


def ohlcv(df: DataFrame, start: Column, order: Column, price: str, volume: Column, symbol: Column) -> DataFrame:
    """One pass of partial aggregates: the first and last price by order, not by arrival."""
    made = df.groupBy(symbol.alias("symbol"), start.alias("ts")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("double").alias("volume")
    )
    return numbered(made)


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", F.row_number().over(bar()))


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 1800, by_type: bool = True) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    return ohlcv(events, bucket("ts", seconds), F.struct("ts", "event_id"), "value", F.sum("value"), symbol)


def all_bars(spark: SparkSession, sf_dir: str, seconds: int = 1800) -> DataFrame:
    """A symbol for each event type, and ALL."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value")
    events = events.withColumn("symbol", F.explode(F.array("event_type", F.lit("ALL"))))
    return ohlcv(events, bucket("ts", seconds), F.struct("ts", "event_id"), "value", F.sum("value"), F.col("symbol"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    day = bucket("o_orderdate", 86400)
    return ohlcv(orders, day, F.struct("o_orderdate", "o_orderkey"), "o_totalprice", F.count("*"), F.lit("ORDERS"))


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    day = bucket("l_shipdate", 86400)
    return ohlcv(lines, day, F.struct("l_shipdate", "l_orderkey", "l_linenumber"), "l_extendedprice", F.sum("l_quantity"), F.lit("LINES"))


def resample(bars: DataFrame, seconds: int, fill: bool = True) -> DataFrame:
    """Coarser bars, labelled by their start; with fill, empty buckets between the first and last have NULL prices and no volume."""
    start = bucket("ts", seconds)
    made = bars.groupBy("symbol", start.alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    if fill:
        ends = made.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("ts"))
        made = grid.join(made, ["symbol", "ts"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return numbered(made)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last by order (which must tell them apart for a definite result)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
