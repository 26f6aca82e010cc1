"""Position sizes, the rolling health of trades with its bands, kill switches, and bootstrap intervals of a list of trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.nulls import flag, safe_div

C = F.col
DAY = 86400


def position_size(bars: DataFrame, stop: Column, equity: float = 10_000.0, risk_pct: float = 1.0, cap_pct: float = 10.0) -> DataFrame:
    """size: units of which a stopped trade loses risk_pct of equity, worth cap_pct of it at most; capped: 1 where that limits it.
    All are NULL (capped 0) without a stop distance above zero."""
    df = bars.withColumns({"stop_share": F.when(stop > 0, safe_div(stop, C("close"))), "_most": safe_div(F.lit(equity * cap_pct / 100), C("close"))})
    df = df.withColumn("_free", safe_div(F.lit(equity * risk_pct / 100), C("stop_share") * C("close")))
    df = df.withColumn("size", F.when(C("_free").isNotNull(), F.least("_free", "_most")))
    return df.withColumns({"notional": C("size") * C("close"), "capped": flag(C("_free") > C("_most"))})


def health(made: DataFrame, days: int = 28, slack: float = 0.05, yellow: float = 0.2, red: float = 0.4) -> DataFrame:
    """For each trade: hit rate and net pnl of the last `days` days, and how far that pnl is from what the symbol's mean over all
    trades leads to expect. Bands: 0, 1 (yellow) or 2 (red)."""
    recent = Window.partitionBy("symbol").orderBy("_at").rangeBetween(-days * DAY, 0)
    ever = Window.partitionBy("symbol")
    df = made.withColumns({"_at": C("ts").cast("timestamp").cast("long"), "_win": (C("pnl") > 0).cast("double")})
    df = df.withColumns({"hit_rate": F.avg("_win").over(recent), "net": F.sum("pnl").over(recent), "_usual": F.avg("_win").over(ever), "_expected": F.count("*").over(recent) * F.avg("pnl").over(ever)})
    df = df.withColumn("change", safe_div(C("net") - C("_expected"), F.abs("_expected")))
    return df.withColumns({
        "hit_band": F.when(C("hit_rate") < 0.5, 2).when(C("hit_rate") < C("_usual") - slack, 1).otherwise(0), "pnl_band": F.when(C("change") <= -red, 2).when(C("change") <= -yellow, 1).otherwise(0),
    })


def kill_switches(made: DataFrame, days: int = 28, week_pct: float = 8.0, day_pct: float = 4.0, slip: float = 2.0, red_days: int = 3) -> DataFrame:
    """Per symbol and day with trades (their pnl and planned stop in percent of capital): its pnl, the fall from the height of
    seven days, losses beyond `slip` planned stops, days in a row that end red, and which of the four rules halt trading."""
    beyond = C("pnl") < -slip * C("planned")
    daily = health(made, days).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.sum("pnl").alias("day_pnl"), F.count_if(beyond).alias("slips"), F.max_by(F.greatest("hit_band", "pnl_band"), "ts").alias("band")
    )
    ordered = Window.partitionBy("symbol").orderBy("_day")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("_day", F.unix_date("day"))
    daily = daily.withColumns({"_sum": F.sum("day_pnl").over(so_far), "_n": F.row_number().over(ordered)})
    daily = daily.withColumns({
        "week_fall": F.max(F.greatest("_sum", C("_sum") - C("day_pnl"))).over(ordered.rangeBetween(-6, 0)) - C("_sum"), "red_run": C("_n") - F.coalesce(F.max(F.when(C("band") < 2, C("_n"))).over(so_far), F.lit(0)),
    })
    return daily.select(
        "symbol", "day", "day_pnl", "week_fall", "slips", "red_run",
        flag(C("week_fall") > week_pct).alias("halt_week"), flag(C("day_pnl") < -day_pct).alias("halt_day"), flag(C("slips") > 0).alias("halt_slip"), flag(C("red_run") >= red_days).alias("halt_red"),
    )


# --- bootstrap

#: Coefficients of the usual approximations to the normal distribution and its inverse: fixed values.
CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_STEP = 0.2316419
ABOVE = (2.515517, 0.802853, 0.010328)
BELOW = (1.0, 1.432788, 0.189269, 0.001308)
METRICS = ("sharpe", "hit_rate", "net")


def polynomial(x: Column, terms: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in reversed(terms):
        out = out * x + c
    return out


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal(x: Column) -> Column:
    """Share of the normal distribution up to x."""
    t = 1 / (1 + CDF_STEP * F.abs(x))
    tail = density(x) * t * polynomial(t, CDF)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def quantile(df: DataFrame, share: str, out: str) -> DataFrame:
    """out: where the normal distribution reaches the share (rational approximation and one step of Newton's)."""
    t = F.sqrt(-2 * F.ln(F.least(C(share), 1 - C(share))))
    far = t - polynomial(t, ABOVE) / polynomial(t, BELOW)
    df = df.withColumn(out, F.when(C(share) < 0.5, -far).otherwise(far))
    return df.withColumn(out, C(out) - (normal(C(out)) - C(share)) / density(C(out)))


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value, from sums n, s, q and w (trades, pnl, its squares, wins)."""
    m = C("s") / C("n")
    sharpe = safe_div(m, F.sqrt(F.greatest(C("q") / C("n") - m * m, F.lit(0.0))))
    each = [F.struct(F.lit(k).alias("metric"), F.round(x, 9).alias("value")) for k, x in zip(METRICS, (sharpe, C("w") / C("n"), C("s")), strict=True)]
    return df.select(*keys, F.explode(F.array(*each)).alias("_m")).select(*keys, "_m.*").where("value is not null")


def bootstrap(made: DataFrame, draws: int = 10_000, z: float = 1.959963984540054) -> DataFrame:
    """Per symbol and metric: the value, and its bias-corrected and accelerated interval over `draws` resamples of the symbol's
    trades, each as many as there are. What a resample draws is a digest of its number and place, so a run can be repeated.
    Metrics that aren't known (no spread) give no row."""
    by_time = Window.partitionBy("symbol").orderBy("ts")
    rows = made.select("symbol", "pnl", F.row_number().over(by_time).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"), (C("pnl") > 0).cast("double").alias("win"))
    sums = [F.count("*").cast("double").alias("n"), F.sum("pnl").alias("s"), F.sum(C("pnl") * C("pnl")).alias("q"), F.sum("win").alias("w")]

    word = F.conv(F.substring(F.md5(F.concat_ws(":", C("b").cast("string"), C("i").cast("string"))), 1, 8), 16, 10).cast("long")
    places = rows.select("symbol", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).select("symbol", "b", (word % C("n") + 1).alias("i"))
    drawn = long_form(places.join(rows.drop("n"), ["symbol", "i"]).groupBy("symbol", "b").agg(*sums), ["symbol", "b"])

    whole = rows.groupBy("symbol").agg(*sums)
    left_out = rows.select("symbol", "pnl", "win").join(whole, "symbol").where("n > 1").select(
        "symbol", (C("n") - 1).alias("n"), (C("s") - C("pnl")).alias("s"), (C("q") - C("pnl") * C("pnl")).alias("q"), (C("w") - C("win")).alias("w")
    )
    spread = long_form(left_out, ["symbol"]).withColumn("_d", F.avg("value").over(Window.partitionBy("symbol", "metric")) - C("value"))
    bent = spread.groupBy("symbol", "metric").agg(F.coalesce(safe_div(F.sum(F.pow("_d", F.lit(3))), 6 * F.pow(F.sum(C("_d") * C("_d")), F.lit(1.5))), F.lit(0.0)).alias("bend"))

    points = long_form(whole, ["symbol"]).withColumnRenamed("value", "point").join(bent, ["symbol", "metric"])
    group = Window.partitionBy("symbol", "metric")
    all_drawn = drawn.join(points, ["symbol", "metric"]).withColumns({
        "_n": F.count("*").over(group), "_below": F.count_if(C("value") < C("point")).over(group) + F.count_if(C("value") == C("point")).over(group) / 2, "_rank": F.row_number().over(group.orderBy("value", "b")),
    })
    all_drawn = all_drawn.withColumn("_share", F.least(F.greatest(C("_below") / C("_n"), 0.5 / C("_n")), 1 - 0.5 / C("_n")))
    all_drawn = quantile(all_drawn, "_share", "_bias")

    def rank(side: float) -> Column:
        at = C("_bias") + side
        return F.greatest(F.least(F.ceil(normal(C("_bias") + at / (1 - C("bend") * at)) * C("_n")), C("_n")), F.lit(1))

    return all_drawn.groupBy("symbol", "metric").agg(
        F.max("point").alias("point"), F.max(F.when(C("_rank") == rank(-z), C("value"))).alias("lower"), F.max(F.when(C("_rank") == rank(z), C("value"))).alias("upper"), F.count("*").alias("draws")
    )
