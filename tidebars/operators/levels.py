"""Price levels: pivots of the period before, Fibonacci retracements of the last swing, and volume-weighted prices by anchor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import flag, pct, safe_div, true
from tidebars.sources.bars import bucket

C = F.col
DAY = 86400
#: Names, and shares of the previous range above the middle: fixed values.
PIVOTS = {"S3": -1.0, "S2": -0.618, "S1": -0.382, "P": 0.0, "R1": 0.382, "R2": 0.618, "R3": 1.0}
RETRACEMENTS = (0.382, 0.5, 0.618, 0.786)
ANCHORS = ("daily", "weekly", "swing_high", "swing_low", "htf_pivot")


def period_start(period: str) -> Column:
    """Start of the UTC day or of the week from Monday."""
    day = bucket("ts", DAY)
    return day if period == "daily" else (day - F.make_dt_interval(F.weekday("ts"))).cast("timestamp_ntz")


def pivot_levels(df: DataFrame, period: str) -> DataFrame:
    """_<period>_<level> of each bar, from the last period before its own that has bars: one aggregate, a lag over periods, and a
    join by period (a row for each symbol and period)."""
    key = f"_{period}"
    df = df.withColumn(key, period_start(period))
    before = Window.partitionBy("symbol").orderBy(key)
    ends = df.groupBy("symbol", key).agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"))
    ends = ends.select("symbol", key, *[F.lag(x).over(before).alias(x) for x in "hlc"])
    middle = (C("h") + C("l") + C("c")) / 3
    ends = ends.select("symbol", key, *[(middle + share * (C("h") - C("l"))).alias(f"_{period}_{n}") for n, share in PIVOTS.items()])
    return df.join(ends, ["symbol", key], "left")


def names(period: str) -> list[str]:
    return [f"_{period}_{n}" for n in PIVOTS]


def touching(period: str) -> Column:
    return F.exists(F.array(*names(period)), lambda p: true(safe_div(F.abs(p - C("close")), C("close")) <= 0.0005))


def least(columns: list[Column]) -> Column:
    return F.least(*columns)


def pivots(df: DataFrame) -> DataFrame:
    """Needs pivot_levels() of both periods and atr_14."""
    c = C("close")
    made = {}
    for period, prefix, tested in (("daily", "pivot", "pivot_times_tested_today"), ("weekly", "weekly_pivot", "weekly_pivot_times_tested_this_week")):
        at = {n: C(f"_{period}_{n}") for n in PIVOTS}
        so_far = Window.partitionBy("symbol", f"_{period}").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        rungs = list(at.values())
        band = F.when(c <= rungs[0], 0).when(c >= rungs[-1], 5)
        for i in range(6):
            band = band.when((c >= rungs[i]) & (c < rungs[i + 1]), i)
        made |= {f"{prefix}_{n}_dist_pct": pct(c - x, c) for n, x in at.items()}
        made |= {
            f"{prefix}_zone": F.when(at["P"].isNotNull(), band), tested: F.sum(touching(period).cast("int")).over(so_far),
            f"pivot_position_{period}_01": safe_div(c - at["S1"], at["R1"] - at["S1"]),
            "dist_to_nearest_pivot_atr" if period == "daily" else "dist_to_nearest_weekly_pivot_atr": safe_div(least([F.abs(x - c) for x in rungs]), C("atr_14")),
        }
    near = 0.25 * C("atr_14")
    made["daily_pivot_weekly_pivot_confluence"] = flag(F.exists(F.array(*[f"_daily_{n}" for n in ("S1", "P", "R1")]), lambda d: F.exists(F.array(*names("weekly")), lambda w: true(F.abs(d - w) <= near))))
    df = df.withColumns(made)
    df = df.withColumns({"_sh": R.carried(R_pivot("high")), "_sl": R.carried(R_pivot("low"))})
    df = df.withColumn("_range", F.when(C("_sh") != C("_sl"), C("_sh") - C("_sl")))
    line = {f: C("_sl") + f * C("_range") for f in RETRACEMENTS}
    hit = lambda f: flag(F.abs(c - line[f]) <= 0.001 * c)
    df = df.withColumns({
        "fib_retracement_pct": safe_div(c - C("_sl"), C("_range")), "nearest_fib_level_dist": safe_div(least([F.abs(x - c) for x in line.values()]), C("atr_14")),
        "_t382": hit(0.382), "_t618": hit(0.618), "extension_progress_1272": safe_div(c - C("_sl"), 1.272 * C("_range")),
        "_fib": F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("i"), x.alias("p")) for i, x in enumerate(line.values())])),
    })
    return df.withColumns({
        "in_golden_pocket": flag((C("fib_retracement_pct") >= 0.618) & (C("fib_retracement_pct") <= 0.65)), "fib_touches_382": R.total("_t382", 20), "fib_touches_618": R.total("_t618", 20),
        "swing_fib_pivot_confluence": flag(F.exists(F.array(*names("daily"), *names("weekly")), lambda p: true(F.abs(C("_fib")["p"] - p) <= near))),
    })


def R_pivot(x: str) -> Column:
    return C(f"_pivot_{x}")


def swing_points(df: DataFrame) -> DataFrame:
    return df.withColumns({"_pivot_high": R.pivot_high("high"), "_pivot_low": R.pivot_low("low")})


def vwaps(df: DataFrame) -> DataFrame:
    """Prices weighted by volume since five kinds of anchor, and how the close stands to them. Needs pivot_levels() of both
    periods, swing_points() and atr_14."""
    c, p = C("close"), C("_daily_P")
    broke = true((R.prev("close") <= p) & (c > p)) | true((R.prev("close") >= p) & (c < p))
    df = df.withColumns({"_broke": broke.cast("int"), "_tv": (C("high") + C("low") + c) / 3 * C("volume")})
    df = df.withColumns({
        "_a_daily": C("_daily"), "_a_weekly": C("_weekly"), "_a_swing_high": F.count("_pivot_high").over(R.so_far()), "_a_swing_low": F.count("_pivot_low").over(R.so_far()), "_a_htf_pivot": F.sum("_broke").over(R.so_far()),
    })
    by = {a: Window.partitionBy("symbol", f"_a_{a}").orderBy("ts") for a in ANCHORS}
    running = lambda a, x: F.sum(x).over(by[a].rowsBetween(Window.unboundedPreceding, 0))
    for a in ANCHORS:  # one sort each; rows stay where the symbol put them if the cluster allows a part of the key
        df = df.withColumn(f"_w_{a}", safe_div(running(a, "_tv"), running(a, "volume")))
    lines = {a: C(f"_w_{a}") for a in ANCHORS}
    sd = R.deviation("close", 20, by["daily"])
    df = df.withColumns({"_sd": sd, "daily_vwap": lines["daily"]})
    u, lo = lines["daily"] + C("_sd"), lines["daily"] - C("_sd")
    u2, lo2 = lines["daily"] + 2 * C("_sd"), lines["daily"] - 2 * C("_sd")
    over = reduce(lambda x, y: x + y, [flag(c > v) - flag(c < v) for v in lines.values()])
    known = reduce(lambda x, y: x + y, [v.isNotNull().cast("int") for v in lines.values()])
    crossed = reduce(lambda x, y: x | y, [true(R.crosses_above(c, v)) | true(R.crosses_below(c, v)) for v in lines.values()])
    df = df.withColumns({
        "daily_vwap_upper_band_1sig": u, "daily_vwap_lower_band_1sig": lo, "daily_vwap_dist_pct": pct(c - lines["daily"], c),
        "daily_vwap_zone": F.when(C("_sd").isNull(), None).when(c < lo2, 0).when(c < lo, 1).when(c > u2, 4).when(c > u, 3).otherwise(2),
        "swing_high_vwap_pos": pct(c - lines["swing_high"], c), "swing_low_vwap_pos": pct(c - lines["swing_low"], c), "htf_pivot_vwap_pos": pct(c - lines["htf_pivot"], c), "weekly_vwap_pos": pct(c - lines["weekly"], c),
        "multi_anchor_confluence_signed_count": over, "_vv": safe_div(reduce(lambda x, y: x + y, [F.coalesce(v, F.lit(0.0)) for v in lines.values()]), known),
        "dist_to_nearest_anchored_vwap_atr": safe_div(least([F.abs(c - v) for v in lines.values()]), C("atr_14")), "_cross": crossed.cast("int"),
        **{f"_n_{a}": flag(F.abs(c - v) <= 0.1 * C("atr_14")) for a, v in lines.items()},
    })
    df = df.withColumns({f"_n_{a}": F.coalesce(R.total(f"_n_{a}", 100), F.lit(0)) for a in ANCHORS} | {"_vvm": R.mean("_vv", 20), "vwap_cross_events_count_10": R.total("_cross", 10)})
    heavy = F.array_max(F.array(*[F.struct(C(f"_n_{a}").alias("n"), F.lit(-i).alias("i"), v.alias("v")) for i, (a, v) in enumerate(lines.items())]))
    return df.withColumn("_heavy", heavy).withColumns({
        "vwap_of_vwaps_mean_reversion_dist_pct": pct(c - C("_vvm"), c),
        "close_above_below_heavy_vwap_flag": F.when(C("_heavy")["n"] > 0, F.coalesce(F.signum(c - C("_heavy")["v"]), F.lit(0.0))).otherwise(0.0),
    })
