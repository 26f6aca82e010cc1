"""The tick machine: by hand, and a stream against a replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebars.streaming import ticks as T

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "symbol string, ts timestamp, event_id long, price double"


def some_ticks(n=400, seed=1):
    rng, out, price = random.Random(seed), [], {"a": 100.0, "b": 50.0}
    for i in range(n):
        s = rng.choice("ab")
        price[s] += rng.choice([-3, -1, 0, 1, 3])
        out.append((s, START + dt.timedelta(seconds=100 * i + rng.randrange(50)), i, price[s]))
    return out


def test_an_entry_is_confirmed_or_cancelled_at_the_close():
    m = T.Ticks(T.Rule(seconds=10, stable=2, reach=0.0, n=1, k=1.0))
    told = []
    for i, p in enumerate([100, 99, 100, 98]):  # bars of two ticks: a falling stop above the close
        told += m.tick(i * 5_000_000, float(p))
    assert told == [] and m.level is not None
    for i, p in enumerate([m.level + 5, m.level + 6], 4):
        told += m.tick(i * 5_000_000, p)
    assert [e[2:4] for e in told] == [("open", 1)] and m.state == 1 and m.confirmed == 0
    told = m.closed()
    assert [e[2:4] for e in told] == [("confirm", 1)] and m.confirmed == 1
    assert m.closed() == []
    level = m.level
    told = [e for i, p in enumerate([level - 5, level - 6, level + 1]) for e in m.tick(60_000_000 + i * 1_000_000, p)] + m.closed()
    assert [e[2:4] for e in told] == [("open", -1), ("cancel", -1)] and m.state == m.confirmed == 1


def test_replay_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.replayed(none).count() == 0
    rows = [(None, START, 1, 1.0), ("a", None, 2, 1.0), ("a", START, 3, None), ("a", START, 4, 1.0), ("a", START, 4, 1.0)]
    assert T.replayed(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_replay(spark, tmp_path, shuffled):
    rows = some_ticks()
    table = spark.createDataFrame(rows, SCHEMA)
    rule = T.Rule(seconds=600, n=5, k=0.5)
    want = sorted(map(tuple, T.replayed(table, rule).collect()))
    assert {e[3] for e in want} == {"open", "confirm", "cancel"}
    rng = random.Random(2)
    for lot in range(0, len(rows), 100):
        part = rows[lot : lot + 100]
        if shuffled:
            rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("z", START + dt.timedelta(days=9), 0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        made = T.streamed(source, rule, late="2 hours" if shuffled else "10 minutes")
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        made.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where(F.col("symbol") != "z").drop("batch").collect()))
    assert got == want
