"""Bars from a stream equal those from the whole table."""

from pyspark.sql import functions as F

from tidebars.sources.bars import event_bars
from tidebars.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    for i, frame in enumerate(("ts < '2024-01-10'", "ts >= '2024-01-10'")):
        events.where(frame).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    made = stream.bars(stream.event_stream(spark, f"{tmp_path}/in", 1), late="60 days")
    stream.write_states(made, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    whole = event_bars(spark, str(SF))
    cols = ["symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.round("volume", 6).alias("volume"), "rn"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert key(stream.latest(spark, f"{tmp_path}/out")) == key(whole)


def test_late_events_are_left_out(spark, tmp_path):
    day = lambda s: f"timestamp'2024-01-0{s}'"
    for i, (ts, v) in enumerate(((f"{day('2 12:00:00')}", 1.0), (f"{day('3 12:00:00')}", 2.0), (f"{day('2 12:05:00')}", 9.0))):
        spark.sql(f"SELECT {ts} AS ts, {i}L AS event_id, 'x' AS event_type, CAST({v} AS DOUBLE) AS value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    seen = []
    for i in range(3):
        spark.read.parquet(f"{tmp_path}/in{i}").write.mode("append").parquet(f"{tmp_path}/in")
        made = stream.bars(stream.event_stream(spark, f"{tmp_path}/in"), late="10 minutes")
        stream.write_states(made, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        seen.append(stream.latest(spark, f"{tmp_path}/out").agg(F.max("high")).first()[0])
    assert seen == [1.0, 2.0, 2.0]
