"""Coarser timeframes and other symbols beside each bar, never looking ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import pct, safe_div
from tidebars.operators import recurrence as S
from tidebars.sources.bars import bucket, resample

C = F.col
HOURS4, DAY = 14400, 86400


def join_closed(bars: DataFrame, coarse: DataFrame, seconds: int, columns: list[str]) -> DataFrame:
    """bars with columns of the coarse bar that had closed when their own coarse bar began: the one before it, by an equi-join on
    the bucket. The coarse grid must have no holes (resample with fill)."""
    closed = coarse.select("symbol", C("ts").alias("_bucket"), *[R.prev(c).alias(c) for c in columns])
    return bars.withColumn("_bucket", bucket("ts", seconds)).join(closed, ["symbol", "_bucket"], "left").drop("_bucket")


def four_hours(bars: DataFrame) -> DataFrame:
    """The features of 4-hour bars."""
    c = C("close")
    h = resample(bars, HOURS4)
    h = S.scan(h, [S.ema("_e21", 21), S.ema("_e50", 50), S.Scan(("htf4h_rsi",), S.Rsi), S.Scan(("_m", "_s"), S.Macd), S.Scan(("_p", "_n", "htf4h_adx"), S.Adx), S.Scan(("_a14",), S.Atr), S.Scan(("_a5",), lambda: S.Atr(5))])
    basis, sd = R.mean("close", 20), R.deviation("close", 20)
    return h.withColumns({
        "htf4h_bb_position": safe_div(c - (basis - 2.0 * sd), 4.0 * sd), "htf4h_macd_hist": C("_m") - C("_s"), "htf4h_ema21_pos": pct(c - C("_e21"), c), "htf4h_atr_ratio": safe_div(C("_a5"), C("_a14")),
        "htf4h_close_vs_ema50_pct": pct(c - C("_e50"), c), "htf4h_return_1bar": (safe_div(c, R.prev("close")) - 1) * 100, "htf4h_return_3bar": (safe_div(c, R.prev("close", 3)) - 1) * 100,
    })


def one_day(bars: DataFrame) -> DataFrame:
    """The features of daily bars."""
    c = C("close")
    d = resample(bars, DAY)
    d = S.scan(d, [S.ema("_e20", 20), S.ema("_e50", 50), S.ema("_e200", 200), S.Scan(("htf1d_rsi",), S.Rsi), S.Scan(("_a14",), S.Atr)])
    return d.withColumns({
        **{f"htf1d_ema{n}_pos": pct(c - C(f"_e{n}"), c) for n in (20, 50, 200)}, "htf1d_atr_pct": pct(C("_a14"), c),
        "htf1d_return_1bar": (safe_div(c, R.prev("close")) - 1) * 100, "htf1d_return_5bar": (safe_div(c, R.prev("close", 5)) - 1) * 100,
        "htf1d_close_vs_20d_high_pct": pct(c - R.highest("close", 20), c), "htf1d_close_vs_20d_low_pct": pct(c - R.lowest("close", 20), c),
    })


FOUR_HOURS = ["htf4h_bb_position", "htf4h_rsi", "htf4h_macd_hist", "htf4h_adx", "htf4h_ema21_pos", "htf4h_atr_ratio", "htf4h_close_vs_ema50_pct", "htf4h_return_1bar", "htf4h_return_3bar"]
ONE_DAY = ["htf1d_ema20_pos", "htf1d_ema50_pos", "htf1d_ema200_pos", "htf1d_rsi", "htf1d_atr_pct", "htf1d_return_1bar", "htf1d_return_5bar", "htf1d_close_vs_20d_high_pct", "htf1d_close_vs_20d_low_pct"]


def coarse_context(bars: DataFrame) -> DataFrame:
    df = join_closed(bars, four_hours(bars), HOURS4, FOUR_HOURS)
    return join_closed(df, one_day(bars), DAY, ONE_DAY)


def beside(df: DataFrame, lead: str, columns: list[str]) -> DataFrame:
    """df with the lead symbol's columns of the same ts, as lead_<column>; NULL where it has no bar."""
    other = df.where(C("symbol") == lead).select("ts", *[C(c).alias(f"lead_{c}") for c in columns])
    return df.join(other, "ts", "left")


def cross_asset(df: DataFrame, lead: str) -> DataFrame:
    """Features against the lead symbol. Needs atr_14."""
    daily = S.scan(resample(df.where(C("symbol") == lead), DAY), [S.ema("_e200", 200)])
    above = daily.select(C("ts").alias("_d"), R.prev(F.signum(C("close") - C("_e200"))).alias("lead_above_ema200_daily"))
    df = beside(df, lead, ["close", "atr_14"]).withColumn("_d", bucket("ts", DAY)).join(above, "_d", "left")
    df = df.withColumns({"_r": safe_div(C("close"), R.prev("close")) - 1, "_lr": safe_div(C("lead_close"), R.prev("lead_close")) - 1})
    return df.withColumns({
        "lead_corr_20bar": R.correlation("_r", "_lr", 20), **{f"lead_return_{n}bar": (safe_div(C("lead_close"), R.prev("lead_close", n)) - 1.0) * 100.0 for n in (1, 3, 12)},
        "lead_vs_asset_atr_norm_diff": safe_div(R.change("lead_close"), C("lead_atr_14")) - safe_div(R.change("close"), C("atr_14")),
        "lead_funding_rate": F.lit(None).cast("double"),
    })
