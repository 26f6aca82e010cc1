"""Setups of price at its exponential means and pivots: touches, what came of them, agreement of two timeframes, and candles there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import safe_div, true
from tidebars.operators import recurrence as S
from tidebars.operators.bar_shapes import candles
from tidebars.operators.levels import names, pivot_levels
from tidebars.operators.timeframes import join_closed
from tidebars.sources.bars import resample

C = F.col
#: How near, in mean ranges, counts as at a level; bars after a touch; bars of either slope; bars of the range. Fixed values.
NEAR, AFTER, FINE_SLOPE, COARSE_SLOPE, RANGE = 0.3, 5, 12, 4, 20
COLUMNS = [
    "bars_since_ema21_touch_5m", "ema21_bounce_5bar_5m", "bars_since_ema50_touch_5m", "ema50_bounce_5bar_5m", "bars_since_ema50_touch_1h", "bars_since_ema200_touch_1h", "mtf_trend_alignment",
    "ema21_pivot_confluence", "ema50_pivot_confluence", "pin_bar_at_ema", "pin_bar_at_pivot", "engulf_at_ema", "engulf_at_pivot", "pullback_depth_pct", "dist_from_range_high_20_pct", "dist_from_range_low_20_pct",
]


class Range(S.Atr):
    """The mean true range from the first bar on."""

    def __init__(self, n: int = 14):
        super().__init__(n)
        self.mean = S.Ewm(1 / n, 1)


def early(name: str, n: int) -> S.Scan:
    """An exponential mean from the first bar on."""
    return S.Scan((name,), lambda: S.Mean("close", S.Ewm(2 / (n + 1), 1)))


def at(level: Column) -> Column:
    return true(F.abs(C("close") - level) <= NEAR * C("_atr"))


def setups(fine: DataFrame, seconds: int = 3600) -> DataFrame:
    """fine with COLUMNS. The coarse frame has the bars of `seconds` that aren't empty; a fine bar sees the one before its own."""
    c = C("close")
    coarse = S.scan(resample(fine, seconds, fill=False), [early("_c50", 50), early("_c200", 200), S.Scan(("_atr",), Range)])
    coarse = coarse.withColumns({f"bars_since_ema{n}_touch_1h": R.bars_since(at(C(f"_c{n}"))) for n in (50, 200)} | {"_slope": R.change("_c50", COARSE_SLOPE)})
    df = join_closed(fine, coarse, seconds, ["bars_since_ema50_touch_1h", "bars_since_ema200_touch_1h", "_slope"])
    df = candles(pivot_levels(S.scan(df, [early("_e21", 21), early("_e50", 50), S.Scan(("_atr",), Range)]), "daily"))
    df = df.withColumns({f"_t{n}": at(C(f"_e{n}")) for n in (21, 50)} | {f"_away{n}": safe_div(c - C(f"_e{n}"), C("_atr")) for n in (21, 50)})
    near_mean, near_pivot = C("_t21") | C("_t50"), F.exists(F.array(*names("daily")), at)
    top, bottom = R.highest("close", RANGE), R.lowest("close", RANGE)
    sign = lambda x: F.coalesce(F.signum(x), F.lit(0.0))
    nearest = lambda n: F.least(*[F.abs(C(p) - C(f"_e{n}")) for p in names("daily")])
    where = lambda x, cond: F.when(cond, C(x).cast("double")).otherwise(0.0)
    made = {f"bars_since_ema{n}_touch_5m": R.bars_since(C(f"_t{n}")) for n in (21, 50)}
    made |= {f"ema{n}_bounce_5bar_5m": R.carried(F.when(true(R.prev(f"_t{n}", AFTER)), C(f"_away{n}"))) for n in (21, 50)}
    made |= {f"ema{n}_pivot_confluence": safe_div(nearest(n), C("_atr")) for n in (21, 50)}
    return df.withColumns(made | {
        "mtf_trend_alignment": sign(R.change("_e50", FINE_SLOPE)) * sign(C("_slope")), "pin_bar_at_ema": where("pin_bar_signal", near_mean), "pin_bar_at_pivot": where("pin_bar_signal", near_pivot),
        "engulf_at_ema": where("engulfing_signal", near_mean), "engulf_at_pivot": where("engulfing_signal", near_pivot), "pullback_depth_pct": safe_div(top - c, top - bottom),
        "dist_from_range_high_20_pct": safe_div(top - c, c) * 100, "dist_from_range_low_20_pct": safe_div(c - bottom, c) * 100,
    })
