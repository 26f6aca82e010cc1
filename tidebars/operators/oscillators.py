"""Momentum, trend and adaptive means: what follows from one scan of recurrences and ordered windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import flag, pct, safe_div, sign0, zone
from tidebars.operators import recurrence as S
from tidebars.operators.boxes import box_dimension

C = F.col


def recurrences(bars: DataFrame) -> DataFrame:
    """bars with every exponential quantity that the feature families share, in one pass."""
    scans = [
        S.ema("ema9", 9), S.ema("ema21", 21), S.ema("ema50", 50), S.Scan(("rsi_14",), S.Rsi), S.Scan(("macd_line", "macd_signal"), S.Macd),
        S.Scan(("di_plus", "di_minus", "adx"), S.Adx), S.Scan(("wt1",), S.WaveTrend), S.Scan(("atr_14",), S.Atr), S.Scan(("atr_5",), lambda: S.Atr(5)),
        S.Scan(("tsi", "tsi_signal"), S.Tsi), S.Scan(("dema21", "tema21"), S.Cascade), S.Scan(("kama",), S.Kama), S.Scan(("psar", "psar_trend"), S.Psar),
    ]
    return S.scan(bars, scans)


def squeeze(df: DataFrame) -> DataFrame:
    """Bollinger (20, 2) and Keltner (20, 1.5) bands; squeeze_state: -1 inside, +1 on the first bar out, else 0."""
    df = df.withColumns({"_tr": F.greatest(C("high") - C("low"), F.abs(C("high") - R.prev("close")), F.abs(C("low") - R.prev("close")))})
    df = df.withColumns({"bb_basis": R.mean("close", 20), "_sd20": R.deviation("close", 20), "_tr20": R.mean("_tr", 20)})
    df = df.withColumns({
        "bb_upper": C("bb_basis") + 2.0 * C("_sd20"), "bb_lower": C("bb_basis") - 2.0 * C("_sd20"),
        "kc_upper": C("bb_basis") + 1.5 * C("_tr20"), "kc_lower": C("bb_basis") - 1.5 * C("_tr20"),
    })
    df = df.withColumns({
        "bb_width_pct": pct(C("bb_upper") - C("bb_lower"), C("bb_basis")),
        "bb_position": safe_div(C("close") - C("bb_lower"), C("bb_upper") - C("bb_lower")),
        "_in": flag((C("bb_upper") < C("kc_upper")) & (C("bb_lower") > C("kc_lower"))),
    })
    return df.withColumn("squeeze_state", F.when(C("_in") == 1, -1).when(R.prev("_in") == 1, 1).otherwise(0))


def volatility(df: DataFrame) -> DataFrame:
    """Range and band features; needs atr_14, atr_5 and squeeze()."""
    return df.withColumns({"atr_ratio": safe_div(C("atr_5"), C("atr_14")), "atr_percentile": R.percentile("atr_14", 100)})


def momentum(df: DataFrame) -> DataFrame:
    """Needs recurrences() and squeeze()."""
    c = C("close")
    mid = (R.highest("high", 20) + R.lowest("low", 20)) / 2
    df = df.withColumns({
        "rsi_slope": R.change("rsi_14"), "rsi_zone": zone(C("rsi_14"), 70, 30), "rsi_dist_from_50": C("rsi_14") - 50.0,
        "macd_hist": C("macd_line") - C("macd_signal"), "macd_zero_cross_state": F.signum("macd_line"),
        "wt2": R.mean("wt1", 4), "wt_ob_os_zone": zone(C("wt1"), 60, -60),
        "_k": pct(c - R.lowest("low", 14), R.highest("high", 14) - R.lowest("low", 14)),
        "_lift": c - (mid + R.mean("close", 20)) / 2,
        **{f"roc_{n}bar": (safe_div(c, R.prev("close", n)) - 1.0) * 100.0 for n in (1, 3, 6, 12)},
        "bars_in_squeeze": R.run_length(C("squeeze_state") == -1),
    })
    df = df.withColumns({
        "macd_hist_slope": R.change("macd_hist"), "stoch_k": R.mean("_k", 3), "squeeze_value": R.regression("_lift", 20, "rn"),
        "wt_cross_signal": flag(R.crosses_above(C("wt1"), C("wt2"))) - flag(R.crosses_below(C("wt1"), C("wt2"))),
        "squeeze_release_state": C("squeeze_state"),
        "rsi_wt_divergence_flag": F.when(C("rsi_14").isNull() | C("wt1").isNull(), 1).otherwise((F.signum(C("rsi_14") - 50) != F.signum("wt1")).cast("int")),
        "macd_rsi_alignment": F.signum("macd_hist") * F.signum(C("rsi_14") - 50),
        "d2_rsi": R.change("rsi_slope"), "_dm": R.change("macd_line"), "_dw": R.change("wt1"),
    })
    df = df.withColumns({
        "macd_hist_acceleration": R.change("macd_hist_slope"), "stoch_d": R.mean("stoch_k", 3), "stoch_ob_os_zone": zone(C("stoch_k"), 80, 20),
        "squeeze_signal": (C("squeeze_value") - R.prev("squeeze_value", 5)) / 5, "d2_macd_line": R.change("_dm"), "d2_wt1": R.change("_dw"), "_dk": R.change("stoch_k"),
    })
    return df.withColumns({"stoch_cross_signal": flag(R.crosses_above(C("stoch_k"), C("stoch_d"))) - flag(R.crosses_below(C("stoch_k"), C("stoch_d"))), "d2_stoch_k": R.change("_dk")})


def trend(df: DataFrame) -> DataFrame:
    c = C("close")
    slope = R.change("adx")
    return df.withColumns({
        "di_spread": C("di_plus") - C("di_minus"), "adx_slope": slope, "adx_trending": flag(C("adx") > 25), "adx_weak": flag(C("adx") < 20),
        "adx_accelerating": flag(slope > 0.5), "adx_decelerating": flag(slope < -0.5),
        **{f"ema{n}_dist_pct": pct(c - C(f"ema{n}"), c) for n in (9, 21, 50)},
        "ema_stack_30m": sign0(C("ema9") - C("ema21")) + sign0(C("ema21") - C("ema50")) + sign0(c - C("ema9")),
        "ema21_dist_atr": safe_div(c - C("ema21"), C("atr_14")),
    })


def lagged(df: DataFrame) -> DataFrame:
    """Needs trend()."""
    return df.withColumns({
        "delta_rsi_1": R.change("rsi_14"), "delta_rsi_3": R.change("rsi_14", 3), "delta_adx_3": R.change("adx", 3),
        "delta_volume_3": pct(R.change("volume", 3), R.prev("volume", 3)), "delta_close_vs_ema21_3": R.change("ema21_dist_pct", 3),
    })


def more_momentum(df: DataFrame) -> DataFrame:
    c = C("close")
    df = df.withColumns({"_tp": (C("high") + C("low") + c) / 3, "_d": R.change("close"), "williams_r": -pct(R.highest("high", 14) - c, R.highest("high", 14) - R.lowest("low", 14))})
    df = df.withColumns({"_tps": R.values("_tp", 20), "_tpm": R.mean("_tp", 20), "_up": R.total(F.when(C("_d") > 0, C("_d")).when(C("_d") <= 0, 0.0), 14), "_dn": R.total(F.when(C("_d") < 0, -C("_d")).when(C("_d") >= 0, 0.0), 14)})
    apart = F.aggregate(F.transform("_tps", lambda x: F.abs(x - C("_tpm"))), F.lit(0.0), lambda a, x: a + x) / 20
    df = df.withColumns({"cci_20": safe_div(C("_tp") - C("_tpm"), 0.015 * apart), "_cmo": pct(C("_up") - C("_dn"), C("_up") + C("_dn"))})
    return df.withColumns({
        "williams_r_zone": zone(C("williams_r"), -20, -80), "cci_zero_cross_state": F.signum("cci_20"), "cmo_zero_cross_state": F.signum("_cmo"),
        "tsi_signal_cross_state": F.signum(C("tsi") - C("tsi_signal")), "tsi_zero_cross_state": F.signum("tsi"),
    })


def adaptive(df: DataFrame) -> DataFrame:
    c = C("close")
    return df.withColumns({
        "kama_dist_pct": pct(c - C("kama"), c), "dema_dist_pct": pct(c - C("dema21"), c), "tema_dist_pct": pct(c - C("tema21"), c), "psar_state_dist_pct": pct(c - C("psar"), c),
    })


def ichimoku(df: DataFrame, fast: int = 9, slow: int = 26, span: int = 52) -> DataFrame:
    c = C("close")
    mid = lambda n: (R.highest("high", n) + R.lowest("low", n)) / 2
    df = df.withColumns({"_t": mid(fast), "_kj": mid(slow), "_b": mid(span)}).withColumn("_a", (C("_t") + C("_kj")) / 2)
    df = df.withColumns({"_a": R.prev("_a", slow), "_b": R.prev("_b", slow)})
    return df.withColumns({
        "tenkan_dist_pct": pct(c - C("_t"), c), "kijun_dist_pct": pct(c - C("_kj"), c), "tk_diff_pct": pct(C("_t") - C("_kj"), c),
        "senkou_a_dist_pct": pct(c - C("_a"), c), "senkou_b_dist_pct": pct(c - C("_b"), c), "cloud_dist_pct": pct(c - (C("_a") + C("_b")) / 2, c),
    })


def regime(df: DataFrame) -> DataFrame:
    """Needs recurrences(), squeeze() and volatility()."""
    tercile = lambda x: F.when(x < 33.33, 0).when(x > 66.67, 2).when(x.isNotNull(), 1)
    up, down = (C("ema9") > C("ema21")) & (C("ema21") > C("ema50")), (C("ema9") < C("ema21")) & (C("ema21") < C("ema50"))
    df = df.withColumns({"_bw": R.percentile("bb_width_pct", 100), "_vp": R.percentile("volume", 100)})
    df = df.withColumns({
        "trending_regime": flag((C("adx") > 25) & (F.abs(C("di_plus") - C("di_minus")) > 10)), "ranging_regime": flag((C("adx") < 20) & (C("_bw") < 30)),
        "volatility_regime": tercile(C("atr_percentile")), "volume_regime": tercile(C("_vp")),
        "trend_direction": flag(up) - flag(down),
        "vol_adjusted_momentum_regime": safe_div((safe_div(C("close"), R.prev("close", 3)) - 1.0) * 100.0, pct(C("atr_14"), C("close"))),
    })
    df = df.withColumn("_label", F.when(C("ranging_regime") == 1, 4).when(C("trending_regime") == 1, 1).otherwise(0))
    same = F.coalesce(C("_label") == R.prev("_label"), F.lit(False))
    df = df.withColumn("_same", same)
    return df.withColumn("regime_change_bar", R.bars_since(~C("_same")) + 1)


def mean_reversion(df: DataFrame) -> DataFrame:
    """Needs squeeze()."""
    z = lambda n: safe_div(C("close") - R.mean("close", n), R.deviation("close", n))
    df = log_return(df).withColumn("_r1", R.prev("_r"))
    return df.withColumns({
        "bb_pct_b": C("bb_position"), "bb_dist_mid_sigma": z(20), "zscore_20": z(20), "zscore_50": z(50),
        "skewness_20": R.skew("_r", 20), "kurtosis_20": R.kurtosis("_r", 20), "autocorr_1": R.correlation("_r", "_r1", 49),
    })


def log_return(df: DataFrame) -> DataFrame:
    """_r; NULL where a price is zero."""
    return df.withColumn("_r", F.ln(safe_div(C("close"), R.prev("close"))))


def fractal_stats(df: DataFrame) -> DataFrame:
    df = log_return(df)
    df = df.withColumns({"_w100": R.values("_r", 100), "_m100": R.mean("_r", 100), "_s100": R.deviation("_r", 100), "_w20": R.values("_r", 20), "_c50": R.values("close", 50), "_r5": R.prev("_r", 5), "_r20": R.prev("_r", 20), "_v": R.deviation("_r", 20)})
    # running sum of deviations with its extremes, in one fold
    zero = F.struct(F.lit(0.0).alias("z"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo"))

    def add(a, x):
        z = a["z"] + x - C("_m100")
        return F.struct(z.alias("z"), F.greatest(a["hi"], z).alias("hi"), F.least(a["lo"], z).alias("lo"))

    reach = F.aggregate("_w100", zero, add, lambda a: a["hi"] - a["lo"])
    ratio = F.when(C("_s100") > 1e-12, safe_div(reach, C("_s100")))
    low, high = F.array_min("_w20"), F.array_max("_w20")
    bins = F.when(high > low, F.transform("_w20", lambda x: F.least(F.floor((x - low) / (high - low) * 10), F.lit(9)).cast("int"))).otherwise(F.transform("_w20", lambda x: F.lit(5)))
    shares = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: F.size(F.filter(C("_bins"), lambda y: y == b)) / F.lit(20.0))
    entropy = -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.ln(p))
    dimension = F.pandas_udf(box_dimension, "double")
    return df.withColumn("_bins", F.when(C("_w20").isNotNull(), bins)).withColumns({
        "hurst_exponent": F.when(ratio > 0, F.ln(ratio) / F.ln(F.lit(100.0))), "fractal_dimension": dimension("_c50"),
        "autocorr_5": R.correlation("_r", "_r5", 45), "autocorr_20": R.correlation("_r", "_r20", 80),
        "entropy_20": F.when(C("_bins").isNotNull(), entropy), "realized_vol_of_realized_vol": R.deviation("_v", 20),
    })
