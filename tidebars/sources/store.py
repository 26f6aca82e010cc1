"""Stored bars: reading, sorted writing, and merging where the newer row of a key wins."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.sources.bars import keep_last

SCHEMA = "symbol string, timestamp long, open double, high double, low double, close double, volume double"


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Bars between two times, both included; none where nothing is stored. All three filters reach the scan."""
    try:
        df = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    for known, cond in ((symbol, F.col("symbol") == symbol), (since, F.col("timestamp") >= F.lit(since)), (until, F.col("timestamp") <= F.lit(until))):
        df = df if known is None else df.where(cond)
    return df


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each symbol, each file sorted by time."""
    df.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.mode(mode).partitionBy("symbol").parquet(path)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row of each symbol and time, of new where both have it. Write it to another path than the one it reads; among equal keys
    of one side the larger row stays."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return keep_last(both, ["symbol", "timestamp"], [F.col("_side"), F.struct("open", "high", "low", "close", "volume")]).drop("_side")


def high_water(df: DataFrame) -> DataFrame:
    """Where to go on: the last time of each symbol."""
    return df.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the session's shared folder. Without one a local session takes a folder of its own; a cluster
    has to name one in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()
