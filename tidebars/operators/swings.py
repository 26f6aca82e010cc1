"""Confirmed swing points and what is read off them: divergences, structure, memory of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import flag, pct, safe_div, true, zone

C = F.col


def divergence(df: DataFrame, oscillator: str, out: str, reach: int = 14) -> DataFrame:
    """<out>_regular and <out>_hidden, -1, 0 or +1: price and oscillator swing points on the same bar against those of the
    previous price swing point of the kind, at most `reach` bars before. A low's finding replaces a high's on the same bar."""
    df = df.withColumns({"_ph": R.pivot_high("close"), "_pl": R.pivot_low("close"), "_oh": R.pivot_high(oscillator), "_ol": R.pivot_low(oscillator)})
    seen = lambda p, o: R.previous(F.when(C(p).isNotNull(), F.struct(C("rn").alias("rn"), C(p).alias("p"), C(o).alias("o"))))
    df = df.withColumns({"_bh": seen("_ph", "_oh"), "_bl": seen("_pl", "_ol")})
    near = lambda b: C("rn") - C(b)["rn"] <= reach
    higher, lower = lambda p, b, o: (C(p) > C(b)["p"]) & (C(o) < C(b)["o"]), lambda p, b, o: (C(p) < C(b)["p"]) & (C(o) > C(b)["o"])
    return df.withColumns({
        f"{out}_regular": F.when(true(near("_bl") & lower("_pl", "_bl", "_ol")), 1).when(true(near("_bh") & higher("_ph", "_bh", "_oh")), -1).otherwise(0),
        f"{out}_hidden": F.when(true(near("_bl") & higher("_pl", "_bl", "_ol")), 1).when(true(near("_bh") & lower("_ph", "_bh", "_oh")), -1).otherwise(0),
    })


def divergences(df: DataFrame) -> DataFrame:
    """Needs rsi_14 and macd_hist."""
    df = divergence(divergence(df, "rsi_14", "_dr"), "macd_hist", "_dx")
    df = df.withColumns({
        "regular_bullish_div_rsi": flag(C("_dr_regular") > 0), "regular_bearish_div_rsi": flag(C("_dr_regular") < 0), "regular_bullish_div_macd": flag(C("_dx_regular") > 0),
        "regular_bearish_div_macd": flag(C("_dx_regular") < 0), "hidden_bullish_div_rsi": flag(C("_dr_hidden") > 0), "hidden_bearish_div_rsi": flag(C("_dr_hidden") < 0),
    })
    return df.withColumn("divergence_recency", R.bars_since((C("_dr_regular") != 0) | (C("_dx_regular") != 0) | (C("_dr_hidden") != 0)))


def swing_ratio(df: DataFrame) -> DataFrame:
    """swing_length_ratio: the last swing's length over the one before, along alternating highs and lows (of highs in a row only
    the highest counts, of lows the lowest)."""
    order = Window.partitionBy("symbol").orderBy("rn", "ord")
    points = df.select("symbol", "rn", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("ord"), C("_h").alias("p")), F.struct(F.lit(1).alias("ord"), C("_l").alias("p"))), lambda x: x["p"].isNotNull())).alias("e")).select("symbol", "rn", "e.ord", "e.p")
    points = points.withColumn("leg", F.sum(F.when(C("ord") != F.lag("ord").over(order), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("symbol", "leg").orderBy("rn", "ord").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("x", F.when(C("ord") == 0, F.max("p").over(inside)).otherwise(F.min("p").over(inside)))
    ends = points.groupBy("symbol", "leg").agg(F.max_by("x", F.struct("rn", "ord")).alias("end"))
    legs = Window.partitionBy("symbol").orderBy("leg")
    ends = ends.select("symbol", "leg", F.lag("end").over(legs).alias("e1"), F.lag("end", 2).over(legs).alias("e2"))
    ratio = safe_div(F.abs(C("x") - C("e1")), F.abs(C("e1") - C("e2")))
    last = points.join(ends, ["symbol", "leg"]).groupBy("symbol", "rn").agg(F.max_by(F.struct(ratio.alias("r")), C("ord")).alias("_r"))
    out = df.join(last.select("symbol", "rn", C("_r")["r"].alias("_ratio")), ["symbol", "rn"], "left")
    return out.withColumn("swing_length_ratio", R.carried(C("_ratio")))


def structure(df: DataFrame) -> DataFrame:
    c = C("close")
    df = df.withColumns({"_h": R.pivot_high("high"), "_l": R.pivot_low("low")})
    df = df.withColumns({"_h1": R.previous(C("_h")), "_l1": R.previous(C("_l"))})
    events = {"_hh": C("_h") > C("_h1"), "_hl": C("_l") > C("_l1"), "_lh": C("_h") < C("_h1"), "_ll": C("_l") < C("_l1")}
    df = df.withColumns({k: flag(v) for k, v in events.items()} | {"_any": flag(C("_h").isNotNull() | C("_l").isNotNull())})
    df = df.withColumns({
        "higher_highs_count_20": R.total("_hh", 20), "higher_lows_count_20": R.total("_hl", 20), "lower_highs_count_20": R.total("_lh", 20), "lower_lows_count_20": R.total("_ll", 20), "fractal_pivot_count_20": R.total("_any", 20),
        "_up": F.coalesce(R.carried(F.when(C("_hh") == 1, 1).when(C("_lh") == 1, 0)), F.lit(0)), "_lo": F.coalesce(R.carried(F.when(C("_hl") == 1, 1).when(C("_ll") == 1, 0)), F.lit(0)),
        "_ready": (F.count("_h").over(R.so_far()) >= 2) & (F.count("_l").over(R.so_far()) >= 2),
        "swing_high_dist_pct": pct(c - R.carried(C("_h")), c), "swing_low_dist_pct": pct(c - R.carried(C("_l")), c),
    })
    df = df.withColumn("structure_type", F.when(C("_ready") & (C("_up") == 1) & (C("_lo") == 1), 1).when(C("_ready") & (C("_up") == 0) & (C("_lo") == 0), -1).otherwise(0))
    was = F.coalesce(R.prev("structure_type"), F.lit(0))
    df = df.withColumn("break_of_structure", F.when((C("structure_type") == 1) & (was == -1), 1).when((C("structure_type") == -1) & (was == 1), -1).otherwise(0))
    return swing_ratio(df)


def memory(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Bars since events. levels: names of level columns by period. Needs momentum, trend, squeeze and levels."""
    c = C("close")
    crossed = lambda x, y: true(R.crosses_above(x, y)) | true(R.crosses_below(x, y))
    touched = lambda names: F.exists(F.array(*names), lambda p: true(safe_div(F.abs(p - c), c) <= 0.0005))
    side = zone(C("rsi_14"), 70, 30)
    df = df.withColumns({
        "_v20": R.mean("volume", 20), "_h": R.pivot_high("high"), "_l": R.pivot_low("low"), "_side": F.when(C("rsi_14").isNotNull(), side),
        "_fire": C("squeeze_state") == 1, "_enter": (C("squeeze_state") == -1) & (F.coalesce(R.prev("squeeze_state"), F.lit(0)) != -1),
        "_x21": crossed(c, C("ema21")), "_xz": crossed(C("macd_line"), 0), "_xs": crossed(C("macd_line"), C("macd_signal")), "_x50": crossed(C("rsi_14"), 50),
        "_trend": true((R.prev("adx") <= 25) & (C("adx") > 25)), "_weak": true((R.prev("adx") >= 15) & (C("adx") < 15)),
    })
    df = df.withColumns({"_h1": R.previous(C("_h")), "_l1": R.previous(C("_l")), "_side0": R.previous(C("_side"))})
    df = df.withColumn("_stay", F.sum(F.when(C("_side").isNotNull() & (F.coalesce("_side0", F.lit(0)) != C("_side")), 1).otherwise(0)).over(R.so_far()))
    stay = Window.partitionBy("symbol", "_stay").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_depth", F.when(C("_side") == 1, F.max(C("rsi_14") - 70).over(stay)).when(C("_side") == -1, F.max(30 - C("rsi_14")).over(stay)))
    return df.withColumns({
        "bars_since_rsi_ob": R.bars_since(C("rsi_14") > 70), "bars_since_rsi_os": R.bars_since(C("rsi_14") < 30), "bars_since_rsi_mid_cross": R.bars_since(C("_x50")),
        "bars_in_current_rsi_episode": R.run_length((C("rsi_14") > 70) | (C("rsi_14") < 30)), "last_rsi_extreme_depth": R.carried(C("_depth")),
        "bars_since_stoch_ob": R.bars_since(C("stoch_k") > 80), "bars_since_stoch_os": R.bars_since(C("stoch_k") < 20), "bars_since_wt_ob": R.bars_since(C("wt1") > 53), "bars_since_wt_os": R.bars_since(C("wt1") < -53),
        "bars_since_adx_trend_start": R.bars_since(C("_trend")), "bars_since_adx_weak_start": R.bars_since(C("_weak")),
        "bars_since_squeeze_fire": R.bars_since(C("_fire")), "bars_since_squeeze_entry": R.bars_since(C("_enter")), "squeeze_direction_at_fire": R.carried(F.when(C("_fire"), F.signum("squeeze_value"))),
        "bars_since_volume_spike": R.bars_since(C("volume") > 3.0 * C("_v20")), "bars_since_last_hh": R.bars_since(C("_h") > C("_h1")), "bars_since_last_ll": R.bars_since(C("_l") < C("_l1")),
        **{f"bars_since_pivot_touch_{k}": R.bars_since(touched(names)) for k, names in levels.items()},
        "bars_since_ema21_cross": R.bars_since(C("_x21")), "bars_since_macd_zero_cross": R.bars_since(C("_xz")), "bars_since_macd_signal_cross": R.bars_since(C("_xs")),
    })
