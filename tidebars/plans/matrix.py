"""The feature families, their order of dependence, and the assembled matrix."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators import bar_shapes, levels, oscillators, swings, timeframes
from tidebars.sources.bars import numbered
from tidebars.sources.store import cut

#: Columns of each family: fixed values.
FAMILIES: dict[str, list[str]] = {
    "momentum": "rsi_14 rsi_slope rsi_zone rsi_dist_from_50 macd_line macd_signal macd_hist macd_hist_slope macd_zero_cross_state macd_hist_acceleration wt1 wt2 wt_cross_signal wt_ob_os_zone stoch_k stoch_d stoch_cross_signal stoch_ob_os_zone squeeze_value squeeze_signal squeeze_release_state bars_in_squeeze roc_1bar roc_3bar roc_6bar roc_12bar rsi_wt_divergence_flag macd_rsi_alignment d2_rsi d2_macd_line d2_wt1 d2_stoch_k".split(),
    "trend": "di_plus di_minus adx di_spread adx_slope adx_trending adx_weak adx_accelerating adx_decelerating ema9_dist_pct ema21_dist_pct ema50_dist_pct ema_stack_30m ema21_dist_atr".split(),
    "coarse": timeframes.FOUR_HOURS + timeframes.ONE_DAY,
    "volatility": "atr_14 atr_5 atr_ratio atr_percentile bb_basis bb_upper bb_lower bb_width_pct bb_position kc_upper kc_lower squeeze_state".split(),
    "volume": "volume_ratio_20 volume_zscore_20 volume_spike_flag vfi vfi_signal vfi_hist_slope obv_slope obv_divergence_flag candle_buy_sell_signed volume_weighted_momentum_10 high_vol_close_top_tercile high_vol_close_bottom_tercile".split(),
    "vwap": "daily_vwap daily_vwap_upper_band_1sig daily_vwap_lower_band_1sig daily_vwap_dist_pct daily_vwap_zone swing_high_vwap_pos swing_low_vwap_pos htf_pivot_vwap_pos weekly_vwap_pos multi_anchor_confluence_signed_count vwap_of_vwaps_mean_reversion_dist_pct dist_to_nearest_anchored_vwap_atr vwap_cross_events_count_10 close_above_below_heavy_vwap_flag".split(),
    "pivots": [f"pivot_{n}_dist_pct" for n in levels.PIVOTS] + "pivot_zone pivot_times_tested_today pivot_position_daily_01 dist_to_nearest_pivot_atr daily_pivot_weekly_pivot_confluence".split() + [f"weekly_pivot_{n}_dist_pct" for n in levels.PIVOTS] + "weekly_pivot_zone weekly_pivot_times_tested_this_week pivot_position_weekly_01 dist_to_nearest_weekly_pivot_atr fib_retracement_pct in_golden_pocket nearest_fib_level_dist fib_touches_382 fib_touches_618 extension_progress_1272 swing_fib_pivot_confluence".split(),
    "calendar": "hour_of_day_sin hour_of_day_cos day_of_week_sin day_of_week_cos is_weekend session_overlap_asian_london session_overlap_london_ny session_overlap_ny_asian month_of_year".split(),
    "candles": "body_pct upper_wick_pct lower_wick_pct range_pct is_bullish body_vs_prev_body engulfing_signal pin_bar_signal inside_bar_flag".split(),
    "mean_reversion": "bb_pct_b bb_dist_mid_sigma zscore_20 zscore_50 skewness_20 kurtosis_20 autocorr_1".split(),
    "regime": "trending_regime ranging_regime volatility_regime volume_regime trend_direction regime_change_bar vol_adjusted_momentum_regime".split(),
    "context": "prev_bar_close_vs_close_pct prev_bar_high_vs_close_pct prev_bar_low_vs_close_pct prev_bar_volume_ratio today_open_to_now_pct today_high_low_distance_from_current_pct".split(),
    "lagged": "delta_rsi_1 delta_rsi_3 delta_adx_3 delta_volume_3 delta_close_vs_ema21_3".split(),
    "divergences": "regular_bullish_div_rsi regular_bearish_div_rsi regular_bullish_div_macd regular_bearish_div_macd hidden_bullish_div_rsi hidden_bearish_div_rsi divergence_recency".split(),
    "money_flow": "cmf_20 cmf_slope mfi_14 mfi_zone ad_slope_10 ad_price_divergence_flag".split(),
    "more_momentum": "williams_r williams_r_zone cci_20 cci_zero_cross_state tsi_signal_cross_state tsi_zero_cross_state cmo_zero_cross_state".split(),
    "structure": "swing_high_dist_pct swing_low_dist_pct structure_type swing_length_ratio higher_highs_count_20 higher_lows_count_20 lower_highs_count_20 lower_lows_count_20 fractal_pivot_count_20 break_of_structure".split(),
    "fractal_stats": "hurst_exponent fractal_dimension autocorr_5 autocorr_20 entropy_20 realized_vol_of_realized_vol".split(),
    "adaptive": "kama_dist_pct dema_dist_pct tema_dist_pct psar_state_dist_pct".split(),
    "ichimoku": "tenkan_dist_pct kijun_dist_pct tk_diff_pct senkou_a_dist_pct senkou_b_dist_pct cloud_dist_pct".split(),
    "memory": "bars_since_rsi_ob bars_since_rsi_os bars_since_rsi_mid_cross bars_in_current_rsi_episode last_rsi_extreme_depth bars_since_stoch_ob bars_since_stoch_os bars_since_wt_ob bars_since_wt_os bars_since_adx_trend_start bars_since_adx_weak_start bars_since_squeeze_fire bars_since_squeeze_entry squeeze_direction_at_fire bars_since_volume_spike bars_since_last_hh bars_since_last_ll bars_since_pivot_touch_daily bars_since_pivot_touch_weekly bars_since_ema21_cross bars_since_macd_zero_cross bars_since_macd_signal_cross".split(),
    "cross_asset": "lead_corr_20bar lead_return_1bar lead_return_3bar lead_return_12bar lead_vs_asset_atr_norm_diff lead_funding_rate lead_above_ema200_daily".split(),
}
#: Families that hold still while a bar is open; of the others these columns do.
STATIC_FAMILIES = ("coarse", "pivots", "calendar")
STATIC_COLUMNS = ("prev_bar_close_vs_close_pct", "prev_bar_high_vs_close_pct", "prev_bar_low_vs_close_pct", "prev_bar_volume_ratio", "lead_above_ema200_daily", *FAMILIES["structure"][2:])

NEEDS = {
    "momentum": ("scan", "squeeze"), "trend": ("scan",), "volatility": ("scan", "squeeze"), "vwap": ("scan", "levels"), "pivots": ("scan", "levels"), "mean_reversion": ("squeeze",),
    "regime": ("scan", "squeeze", "volatility"), "lagged": ("scan", "trend"), "divergences": ("scan", "squeeze", "momentum"), "more_momentum": ("scan",), "adaptive": ("scan",),
    "memory": ("scan", "squeeze", "momentum", "levels"), "cross_asset": ("scan",),
}


def with_levels(df: DataFrame) -> DataFrame:
    return levels.swing_points(levels.pivot_levels(levels.pivot_levels(df, "daily"), "weekly"))


STEPS = {
    "scan": oscillators.recurrences, "squeeze": oscillators.squeeze, "levels": with_levels, "momentum": oscillators.momentum, "trend": oscillators.trend, "coarse": timeframes.coarse_context, "volatility": oscillators.volatility,
    "volume": bar_shapes.volume, "vwap": levels.vwaps, "pivots": levels.pivots, "calendar": bar_shapes.calendar, "candles": bar_shapes.candles, "mean_reversion": oscillators.mean_reversion, "regime": oscillators.regime,
    "context": bar_shapes.context, "lagged": oscillators.lagged, "divergences": swings.divergences, "money_flow": bar_shapes.money_flow, "more_momentum": oscillators.more_momentum, "structure": swings.structure,
    "fractal_stats": oscillators.fractal_stats, "adaptive": oscillators.adaptive, "ichimoku": oscillators.ichimoku, "memory": lambda df: swings.memory(df, {p: levels.names(p) for p in ("daily", "weekly")}),
    "cross_asset": lambda df: timeframes.cross_asset(df, LEAD),
}
LEAD = "purchase"
BASE = ["symbol", "ts", "open", "high", "low", "close", "volume", "rn"]


#: The matrix is made in these groups: each works on what the ones before left, so scans, levels and windows are computed once.
GROUPS = (
    ("momentum", "trend", "volatility", "lagged", "adaptive"),
    ("coarse", "vwap", "pivots", "memory"),
    ("volume", "calendar", "candles", "mean_reversion", "regime", "context", "divergences", "money_flow"),
    ("more_momentum", "structure", "fractal_stats", "ichimoku", "cross_asset"),
)


def added(df: DataFrame, families: Iterable[str], done: set[str]) -> DataFrame:
    """df with the families' columns and what they need; done: the steps that df has been through, which grows."""
    for step in families:
        if step not in done:
            df = added(df, NEEDS.get(step, ()), done)
            done.add(step)
            df = STEPS[step](df)
    return df


def build(bars: DataFrame, families: list[str]) -> DataFrame:
    """bars with the columns of the given families."""
    df = added(bars, families, set())
    return df.select(*[c for c in BASE if c in df.columns], *[c for f in families for c in FAMILIES[f]])


#: Columns of families that later ones read.
READ_LATER = ("macd_hist", "stoch_k", "squeeze_value", "ema21_dist_pct", "atr_percentile")


def packed(df: DataFrame, family: str, done: set[str]) -> DataFrame:
    """df with the family's new columns in one struct, _of_<family>, and none of its helper columns: what the windows of later
    families carry along stays narrow."""
    df = added(df, NEEDS.get(family, ()), done)
    before = {*df.columns, *READ_LATER}
    df = added(df, [family], done)
    own = [c for c in FAMILIES[family] if c not in before]
    kept = [c for c in df.columns if c in before]
    return df.select(*kept, F.struct(*own).alias(f"_of_{family}"))


def matrix(bars: DataFrame, lead: bool = True) -> DataFrame:
    """All families: 250 columns, or 243 without the lead symbol's. Lineage is cut between groups: plans stay small, and each group
    reads the rows of the one before, which keep their order by symbol and time."""
    done: set[str] = set()
    df = numbered(bars.drop("rn"))
    for i, names in enumerate(GROUPS):
        df = cut(df) if i else df
        for family in names:
            if lead or family != "cross_asset":
                df = packed(df, family, done)
    flat = {*df.columns}
    made = [F.col(c) if c in flat else F.col(f"_of_{f}")[c].alias(c) for f, names in FAMILIES.items() if lead or f != "cross_asset" for c in names]
    return df.select("symbol", "ts", *BASE[2:7], *made)


def catalog() -> list[tuple[str, str, str]]:
    """(feature, family, stability)."""
    return [(c, f, "static" if f in STATIC_FAMILIES or c in STATIC_COLUMNS else "dynamic") for f, names in FAMILIES.items() for c in names]


def finished(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """symbol, ts and columns: doubles rounded, no negative zero, times without a zone."""
    kinds = dict(df.dtypes)
    shown = [(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("int").alias(c) if kinds[c] in ("bigint", "int", "tinyint") else F.col(c) for c in columns]
    return df.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *shown)
