"""Chart studies over bars: weighted means, oscillators, channels, candle patterns, gaps, breakout odds, sessions and signals made of
several conditions. All are windows over a symbol's bars (one exchange, one sort) and stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import safe_div, true
from tidebars.operators.passages import passages

C = F.col


def flag(x: Column) -> Column:
    return true(x).cast("int")


# --- means


def weighted(x: str | Column, weights: Sequence[float]) -> Column:
    """Mean of the last values by the given weights, the oldest first."""
    parts = F.zip_with(R.values(x, len(weights)), F.array(*map(F.lit, weights)), lambda a, w: a * w)
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / float(sum(weights))


def wma(x: str | Column, n: int) -> Column:
    return weighted(x, [float(i) for i in range(1, n + 1)])


def kernel_weights(n: int, width: float, relative: float) -> list[float]:
    """Rational quadratic, the oldest first."""
    return [(1 + i * i / (2 * relative * width * width)) ** -relative for i in reversed(range(n))]


def means(df: DataFrame, n: int = 20, hull: int = 16) -> DataFrame:
    """wma, vwma, swma (1 2 2 1), hull and kernel."""
    df = df.withColumns({
        "wma": wma("close", n), "vwma": safe_div(R.total(C("close") * C("volume"), n), R.total("volume", n)), "swma": weighted("close", [1.0, 2.0, 2.0, 1.0]),
        "kernel": weighted("close", kernel_weights(25, 8.0, 8.0)), "_lead": 2 * wma("close", hull // 2) - wma("close", hull),
    })
    return df.withColumn("hull", wma("_lead", int(hull**0.5)))


# --- oscillators


def oscillators(df: DataFrame, n: int = 14, cycle: int = 21) -> DataFrame:
    """Vortex, choppiness, detrended price, awesome oscillator and its acceleration, spikes of the body, and the drop from recent
    closes with what makes it extreme."""
    c, h, lo = C("close"), C("high"), C("low")
    pc = R.prev("close")
    df = df.withColumns({
        "_tr": F.coalesce(F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)), h - lo), "_up": F.abs(h - R.prev("low")), "_down": F.abs(lo - R.prev("high")), "_mid": (h + lo) / 2, "_body": c - C("open"),
        "_drop": safe_div(R.highest("close", 22) - lo, R.highest("close", 22)) * 100, "_mean": R.mean("close", cycle),
    })
    ranges = R.total("_tr", n)
    df = df.withColumns({
        "vortex_plus": safe_div(R.total("_up", n), ranges), "vortex_minus": safe_div(R.total("_down", n), ranges),
        "choppiness": F.log10(safe_div(ranges, R.highest("high", n) - R.lowest("low", n))) / F.log10(F.lit(float(n))) * 100,
        "dpo": c - R.prev("_mean", cycle // 2 + 1), "ao": R.mean("_mid", 5) - R.mean("_mid", 34), "_spread": R.deviation("_body", 100), "vix_fix": C("_drop"),
    })
    return df.withColumns({
        "ac": C("ao") - R.mean("ao", 5), "body_spike": F.when(true(C("_body") > C("_spread")), 1).when(true(C("_body") < -C("_spread")), -1).otherwise(0),
        "vix_extreme": flag((C("_drop") >= R.mean("_drop", 20) + 2 * R.deviation("_drop", 20)) | (C("_drop") >= 0.85 * R.highest("_drop", 50))),
    })


# --- channels


def latched(up: Column, down: Column) -> Column:
    """1 since up last held, -1 since down did, 0 before either; up goes first."""
    return F.coalesce(R.carried(F.when(true(up), 1).when(true(down), -1)), F.lit(0))


#: Shares of three deviations at which bands lie: fixed values.
SHARES = (0.236, 0.382, 0.5, 0.618, 0.764, 1.0)


def channels(df: DataFrame, n: int = 10, length: int = 20, wide: int = 200) -> DataFrame:
    """SSL lines, the Donchian trend, and bands at shares of three deviations of the typical price around its volume-weighted mean."""
    c = C("close")
    df = df.withColumns({
        "_above": R.mean("high", n), "_below": R.mean("low", n), "_top": R.highest("high", length), "_bottom": R.lowest("low", length), "_typical": (C("high") + C("low") + c) / 3,
    })
    df = df.withColumns({
        "ssl_trend": latched(c > C("_above"), c < C("_below")), "donchian_trend": latched(c > R.prev("_top"), c < R.prev("_bottom")),
        "band_basis": safe_div(R.total(C("_typical") * C("volume"), wide), R.total("volume", wide)), "_dev": 3 * R.deviation("_typical", wide),
    })
    falls = C("ssl_trend") < 0
    bands = {f"band_{s}_{round(k * 1000)}": C("band_basis") + (k if s == "up" else -k) * C("_dev") for s in ("up", "down") for k in SHARES}
    return df.withColumns({"ssl_up": F.when(falls, C("_below")).otherwise(C("_above")), "ssl_down": F.when(falls, C("_above")).otherwise(C("_below"))} | bands)


# --- candles


PATTERNS = "doji bearish_harami bullish_harami bearish_engulfing bullish_engulfing piercing bullish_belt bullish_kicker bearish_kicker evening_star morning_star shooting_star hammer".split()


def patterns(df: DataFrame, back: int = 5) -> DataFrame:
    """Candle patterns as 0 or 1. A trend is the open against that `back` bars before; a star's or harami's bodies are compared by
    their ends."""
    o, h, lo, c = (C(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns({"_o1": R.prev("open"), "_c1": R.prev("close"), "_h1": R.prev("high"), "_l1": R.prev("low"), "_o2": R.prev("open", 2), "_c2": R.prev("close", 2), "_far": R.prev("open", back), "_floor": R.prev(R.lowest("low", 10))})
    body, body1, span = F.abs(c - o), F.abs(C("_c1") - C("_o1")), h - lo
    top, bottom, top1, bottom1 = F.greatest(o, c), F.least(o, c), F.greatest("_o1", "_c1"), F.least("_o1", "_c1")
    rose, fell, rose1, fell1 = c > o, c < o, C("_c1") > C("_o1"), C("_c1") < C("_o1")
    after_rise, after_fall = C("_far") < o, C("_far") > o
    inside, outside = (top <= top1) & (bottom1 <= bottom) & (body < body1), (top >= top1) & (bottom1 >= bottom) & (body > body1)
    reach = lambda x: (x - lo) / (span + 0.001)
    found = {
        "doji": body <= span * 0.05,
        "bearish_harami": rose1 & fell & inside & after_rise, "bullish_harami": fell1 & rose & inside & after_fall,
        "bearish_engulfing": rose1 & fell & outside & after_rise, "bullish_engulfing": fell1 & rose & outside & after_fall,
        "piercing": fell1 & (o < C("_l1")) & (c > C("_c1") + body1 / 2) & (c < C("_o1")) & after_fall,
        "bullish_belt": (lo == o) & (o < C("_floor")) & rose & (c > (C("_h1") + C("_l1")) / 2) & after_fall,
        "bullish_kicker": fell1 & (o >= C("_o1")) & rose & after_fall, "bearish_kicker": rose1 & (o <= C("_o1")) & (c <= o) & after_rise,
        "evening_star": (C("_c2") > C("_o2")) & (bottom1 > C("_c2")) & (o < bottom1) & fell, "morning_star": (C("_c2") < C("_o2")) & (top1 < C("_c2")) & (o > top1) & rose,
        "shooting_star": rose1 & (o > C("_c1")) & (h - top >= body * 3) & (bottom - lo <= body), "hammer": (span > 3 * body) & (reach(c) > 0.6) & (reach(o) > 0.6),
    }
    return df.withColumns({k: flag(x) for k, x in found.items()})


def gaps(df: DataFrame, **more: int) -> DataFrame:
    """Fair value gaps: between a bar and the one two before lies a price range that neither touches. gap: 1 (rising), -1 or 0;
    its edges and middle, and the bars until a later one reaches its far edge, NULL if none does yet."""
    df = df.withColumns({"_h2": R.prev("high", 2), "_l2": R.prev("low", 2)})
    df = df.withColumn("gap", F.when(true(C("low") > C("_h2")), 1).when(true(C("high") < C("_l2")), -1).otherwise(0))
    rises, falls = C("gap") == 1, C("gap") == -1
    df = df.withColumns({"gap_low": F.when(rises, C("_h2")).when(falls, C("high")), "gap_high": F.when(rises, C("low")).when(falls, C("_l2"))})
    far = df.where("gap <> 0").select("symbol", C("rn").alias("after"), F.when(rises, C("gap_low")).otherwise(C("gap_high")).alias("level"), F.when(rises, F.lit("low")).otherwise(F.lit("high")).alias("value"), rises.alias("below"), F.lit(True).alias("touch"))
    filled = passages(df, far, ("low", "high"), **more).select("symbol", C("after").alias("rn"), (C("at") - C("after")).alias("bars_to_fill"))
    return df.join(filled, ["symbol", "rn"], "left").withColumn("gap_middle", (C("gap_low") + C("gap_high")) / 2)


def breaks(df: DataFrame, left: int = 2, right: int = 2) -> DataFrame:
    """Breaks of the last confirmed swing high (break_side 1) or low (-1) by the close, whether that turns the trend (turned), the
    trend since the last break, the range of the last bar against the break before it (block_low, block_high), and sweeps: a bar
    beyond the swing low (1) or high (-1) that closes back inside."""
    c = C("close")
    df = df.withColumns({"_ph": R.pivot_high("high", left, right), "_pl": R.pivot_low("low", left, right)})
    df = df.withColumns({"_top": R.carried(C("_ph")), "_bottom": R.carried(C("_pl"))} | {f"_{k}_{x}": R.carried(F.when(cond, C(x))) for k, cond in (("fell", c < C("open")), ("rose", c > C("open"))) for x in ("low", "high")})
    df = df.withColumn("break_side", F.when(true(R.crosses_above(c, C("_top"))), 1).when(true(R.crosses_below(c, C("_bottom"))), -1).otherwise(0))
    side = F.when(C("break_side") != 0, C("break_side"))
    block = lambda x: F.when(side == 1, C(f"_fell_{x}")).when(side == -1, C(f"_rose_{x}"))
    return df.withColumns({
        "turned": flag(R.previous(side) == -side), "trend": F.coalesce(R.carried(side), F.lit(0)), "block_low": block("low"), "block_high": block("high"),
        "sweep": F.when(true((C("high") > C("_top")) & (c < C("_top"))), -1).when(true((C("low") < C("_bottom")) & (c > C("_bottom"))), 1).otherwise(0),
    })


# --- odds, sessions, signals


def breakout_odds(df: DataFrame, step_pct: float = 0.1, steps: int = 3) -> DataFrame:
    """Percent of the bars so far, after a bar of the colour that the bar before had, that went beyond its high or low by 0, 1, ...
    steps (shares of the close before); NULL after a bar without a body."""
    pc, po = R.prev("close"), R.prev("open")
    df = df.withColumns({"_colour": F.when(pc > po, 1).when(pc < po, -1), "_step": pc * (step_pct / 100), "_h1": R.prev("high"), "_l1": R.prev("low")})
    seen = Window.partitionBy("symbol", "_colour").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda cond: F.when(C("_colour").isNotNull(), F.count_if(true(cond)).over(seen) * 100.0 / F.count(F.lit(1)).over(seen))
    out = {}
    for k in range(steps):
        out |= {f"odds_up_{k}": share(C("high") >= C("_h1") + k * C("_step")), f"odds_down_{k}": share(C("low") <= C("_l1") - k * C("_step"))}
    return df.withColumns(out)


#: Sessions and their hours, UTC, the last excluded: fixed values.
SESSIONS = (("asia", 0, 7), ("london", 7, 13), ("new_york", 13, 21))


def sessions(df: DataFrame) -> DataFrame:
    """The bar's session, and of that session so far: high, low, mean and volume-weighted mean of the close, and bars."""
    hour = F.hour("ts")
    name = F.lit("late")
    for s, a, b in reversed(SESSIONS):
        name = F.when((hour >= a) & (hour < b), s).otherwise(name)
    df = df.withColumns({"session": name, "_day": F.to_date("ts")})
    w = Window.partitionBy("symbol", "_day", "session").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        "session_high": F.max("high").over(w), "session_low": F.min("low").over(w), "session_mean": F.avg("close").over(w),
        "session_vwap": safe_div(F.sum(C("close") * C("volume")).over(w), F.sum("volume").over(w)), "session_bars": F.count(F.lit(1)).over(w),
    })


def composed(df: DataFrame, long: Column, short: Column, confirm_long: Column, confirm_short: Column, expiry: int = 3) -> DataFrame:
    """signal: 1, -1 or 0. A leading condition counts for `expiry` bars in a row while all confirmations hold, and signals
    alternate: one of the same side as the last is left out."""
    df = df.withColumns({"_long": true(long), "_short": true(short)})
    within = lambda x: (R.run_length(C(x)) >= 1) & (R.run_length(C(x)) <= expiry)
    df = df.withColumn("_side", F.when(within("_long") & true(confirm_long), 1).when(within("_short") & true(confirm_short), -1))
    last = R.previous(C("_side"))
    return df.withColumn("signal", F.when(C("_side").isNotNull() & (last.isNull() | (last != C("_side"))), C("_side")).otherwise(0))
