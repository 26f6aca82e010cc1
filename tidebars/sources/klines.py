"""Candles from exchange archives: CSV, plain or zipped, with or without a header, in milliseconds or microseconds."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.sources.bars import keep_last

#: Fields of a line, in order: a fixed format.
FIELDS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "num_trades", "taker_buy_base", "taker_buy_quote", "ignore"]


def month_url(host: str, symbol: str, interval: str, year: int, month: int) -> str:
    return f"{host}/data/spot/monthly/klines/{symbol}/{interval}/{symbol}-{interval}-{year:04d}-{month:02d}.zip"


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(year, month) from first to last, both included; 'yyyy-MM-dd'."""
    made = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.trunc(F.lit(last).cast("date"), "MM"), F.expr("interval 1 month"))).alias("m"))
    return made.select(F.year("m").alias("year"), F.month("m").alias("month"))


def epoch_ms(t: Column) -> Column:
    """Microseconds (more than 10^14) become milliseconds."""
    return F.when(t > F.lit(10**14), F.floor(t / 1000)).otherwise(t).cast("long")


def parsed(lines: DataFrame) -> DataFrame:
    """(path, timestamp, open, high, low, close, volume) from (path, n, value): a header or a broken line has no time and goes; of
    equal times in a file the last line stays."""
    cells = F.split("value", ",")
    at = {name: F.try_element_at(cells, F.lit(i + 1)) for i, name in enumerate(FIELDS)}
    number = lambda name, kind: F.trim(at[name]).try_cast(kind)
    rows = lines.select("path", "n", epoch_ms(number("open_time", "long")).alias("timestamp"), *[number(c, "double").alias(c) for c in FIELDS[1:6]])
    return keep_last(rows.where("timestamp is not null"), ["path", "timestamp"], [F.col("n")]).drop("n")


def read_zips(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every zip is one task's work, read line by line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as lines:
                            text = [x.decode("utf-8", "replace").strip() for x in lines]
                        if text:
                            yield pd.DataFrame({"path": [path] * len(text), "n": range(len(text)), "value": text})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return parsed(files.mapInPandas(run, "path string, n long, value string"))
