"""Bars from a stream of events: watermarked windows, and a sink that keeps the last state of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebars.sources.bars import numbered


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as they come; the schema is that of the files present."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def bars(events: DataFrame, seconds: int = 1800, late: str = "10 minutes") -> DataFrame:
    """One bar for each event type and window. State is one row per open window: partial aggregates, no event is kept. Events
    later than the watermark are left out. ts must be a timestamp with a zone, as watermarks ask for."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = ts.groupBy(F.col("event_type").alias("symbol"), F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum("value").alias("volume")
    )
    return made.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def write_states(made: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every batch's changed bars, written under its number: a batch that is run again overwrites its own folder only."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return made.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each bar that write_states() has put down."""
    states = spark.read.parquet(path)
    columns = [c for c in states.columns if c not in ("symbol", "ts", "batch")]
    newest = states.groupBy("symbol", "ts").agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return numbered(newest.select("symbol", "ts", *[F.col(f"s.{c}").alias(c) for c in columns]))
