"""Features of single bars and their clock: candles, calendar, previous bars, volume."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import flag, pct, safe_div, zone
from tidebars.operators.recurrence import ema, scan
from tidebars.operators.swings import divergence
from tidebars.sources.bars import bucket

C = F.col
DAY, WEEK = 86400, 604800


def candles(df: DataFrame) -> DataFrame:
    o, h, low, c = (C(x) for x in ("open", "high", "low", "close"))
    body, po, pc = F.abs(c - o), R.prev("open"), R.prev("close")
    df = df.withColumns({"_body": body, "body_pct": safe_div(body, h - low), "upper_wick_pct": safe_div(h - F.greatest(o, c), h - low), "lower_wick_pct": safe_div(F.least(o, c) - low, h - low)})
    return df.withColumns({
        "range_pct": pct(h - low, c), "is_bullish": flag(c > o), "body_vs_prev_body": safe_div(C("_body"), R.prev("_body")),
        "engulfing_signal": flag((c > o) & (pc < po) & (c >= po) & (o <= pc)) - flag((c < o) & (pc > po) & (c <= po) & (o >= pc)),
        "pin_bar_signal": flag((C("lower_wick_pct") > 2 * C("body_pct")) & (C("upper_wick_pct") < C("body_pct"))) - flag((C("upper_wick_pct") > 2 * C("body_pct")) & (C("lower_wick_pct") < C("body_pct"))),
        "inside_bar_flag": flag((h < R.prev("high")) & (low > R.prev("low"))),
    })


def calendar(df: DataFrame) -> DataFrame:
    """Cyclic clock and session flags (UTC)."""
    hour, day = F.hour("ts"), F.weekday("ts")
    within = lambda a, b: flag((hour >= a) & (hour < b))
    turn = 2 * math.pi
    return df.withColumns({
        "hour_of_day_sin": F.sin(hour * (turn / 24)), "hour_of_day_cos": F.cos(hour * (turn / 24)), "day_of_week_sin": F.sin(day * (turn / 7)), "day_of_week_cos": F.cos(day * (turn / 7)),
        "is_weekend": flag(day >= 5), "session_overlap_asian_london": within(7, 9), "session_overlap_london_ny": within(13, 16),
        "session_overlap_ny_asian": flag((hour >= 21) | (hour < 6)), "month_of_year": F.month("ts"),
    })


def context(df: DataFrame) -> DataFrame:
    """The previous bar, and today's range so far."""
    c = C("close")
    today = Window.partitionBy("symbol", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({
        "prev_bar_close_vs_close_pct": pct(R.prev("close") - c, c), "prev_bar_high_vs_close_pct": pct(R.prev("high") - c, c),
        "prev_bar_low_vs_close_pct": pct(R.prev("low") - c, c), "prev_bar_volume_ratio": safe_div(R.prev("volume"), C("volume")), "_day": bucket("ts", DAY),
    })
    df = df.withColumns({"_open": F.first("open").over(today), "_up": F.max("high").over(today) - c, "_down": c - F.min("low").over(today)})
    return df.withColumns({
        "today_open_to_now_pct": pct(c - C("_open"), C("_open")),
        "today_high_low_distance_from_current_pct": pct(F.when(F.abs("_down") < F.abs("_up"), F.abs("_down")).otherwise(-F.least(F.abs("_up"), F.abs("_down"))), c),
    })


def vfi(df: DataFrame, period: int = 130, coef: float = 0.2, cap: float = 2.5) -> DataFrame:
    """Volume flow: capped volume signed by moves beyond a share of their usual size, over its mean."""
    df = df.withColumn("_typ", (C("high") + C("low") + C("close")) / 3)
    df = df.withColumns({"_in": F.ln(safe_div(C("_typ"), R.prev("_typ"))), "_mf": R.change("_typ"), "_mv": R.mean("volume", period)})
    df = df.withColumns({"_cut": coef * R.deviation("_in", 30) * C("close"), "_ave": R.prev("_mv")})
    flow = F.when(C("_ave").isNotNull(), F.least(C("volume"), C("_ave") * cap)) * F.when(F.abs("_mf") > C("_cut"), F.signum("_mf")).otherwise(0.0)
    df = df.withColumn("_flow", flow).withColumn("_raw", safe_div(R.total("_flow", period), C("_ave")))
    return df.withColumn("vfi", R.mean("_raw", 3))


def volume(df: DataFrame) -> DataFrame:
    v, c, h, low = C("volume"), C("close"), C("high"), C("low")
    df = vfi(df.withColumns({"_v20": R.mean("volume", 20), "_vs": R.deviation("volume", 20), "_sv": F.coalesce(F.signum(R.change("close")), F.lit(0.0)) * v}))
    df = scan(df, [ema("vfi_signal", 5, "vfi")])
    place = safe_div(c - low, h - low)
    df = df.withColumns({
        "volume_ratio_20": safe_div(v, C("_v20")), "volume_zscore_20": safe_div(v - C("_v20"), C("_vs")), "volume_spike_flag": flag(v > 3.0 * C("_v20")),
        "vfi_hist_slope": (C("vfi") - C("vfi_signal")) - (R.prev("vfi") - R.prev("vfi_signal")), "obv": F.sum("_sv").over(R.so_far()),
        "candle_buy_sell_signed": place * F.signum(c - C("open")), "_rv": (safe_div(c, R.prev("close")) - 1.0) * v,
        "high_vol_close_top_tercile": flag((v > 1.5 * C("_v20")) & (place >= 2 / 3)), "high_vol_close_bottom_tercile": flag((v > 1.5 * C("_v20")) & (place <= 1 / 3)),
    })
    df = df.withColumns({"obv_slope": R.change("obv", 10) / 10, "volume_weighted_momentum_10": safe_div(R.total("_rv", 10), R.total("volume", 10))})
    return divergence(df, "obv", "_obv").withColumn("obv_divergence_flag", C("_obv_regular"))


def money_flow(df: DataFrame) -> DataFrame:
    v, c, h, low = C("volume"), C("close"), C("high"), C("low")
    df = df.withColumns({"_mfv": safe_div((c - low) - (h - c), h - low) * v, "_typ": (h + low + c) / 3})
    df = df.withColumns({
        "cmf_20": safe_div(R.total("_mfv", 20), R.total("volume", 20)), "_up": F.when(C("_typ") > R.prev("_typ"), C("_typ") * v).otherwise(0.0), "_dn": F.when(C("_typ") < R.prev("_typ"), C("_typ") * v).otherwise(0.0),
        "ad_line": F.when(C("_mfv").isNotNull(), F.sum("_mfv").over(R.so_far())),
    })
    df = df.withColumns({"cmf_slope": R.change("cmf_20"), "mfi_14": 100 - safe_div(F.lit(100.0), 1 + safe_div(R.total("_up", 14), R.total("_dn", 14))), "ad_slope_10": R.change("ad_line", 10) / 10})
    df = df.withColumn("mfi_zone", zone(C("mfi_14"), 80, 20))
    return divergence(df, "ad_line", "_ad").withColumn("ad_price_divergence_flag", C("_ad_regular"))
