"""Bars by traded amount, trades that never overlap with their measures, drift and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.nulls import safe_div
from tidebars.functions.rolling import bar
from tidebars.operators.recurrence import Machine, Scan, Value, scan

C = F.col


def amount_bars(ticks: DataFrame, amount: str, threshold: float, order: list[str]) -> DataFrame:
    """ticks (symbol, price, amount and order columns) as bars of about `threshold` each: a tick belongs to the bar in which the
    amount before it falls. That is the amount of the blocks before (a block: equal first order columns; their totals are partial
    aggregates) and a running sum inside the block, so a task sorts blocks, never all of a symbol. Ticks that `order` doesn't tell
    apart come by amount, then price; those equal in both can be exchanged."""
    whole = [*order, amount, "price"]
    blocks = ticks.groupBy(C("symbol").alias("_symbol"), C(order[0]).alias("_block")).agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy("_symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_symbol", "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_earlier"))
    inside = F.sum(amount).over(Window.partitionBy("symbol", order[0]).orderBy(*whole).rowsBetween(Window.unboundedPreceding, -1))
    rows = ticks.withColumn("_inside", F.coalesce(inside, F.lit(0.0))).join(blocks, C("symbol").eqNullSafe(C("_symbol")) & C(order[0]).eqNullSafe(C("_block")))
    rows = rows.withColumn("bar", F.floor((C("_earlier") + C("_inside")) / threshold).cast("long"))
    at = F.struct(*whole)
    return rows.groupBy("symbol", "bar").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum(amount).alias("volume"), F.count("*").alias("ticks")
    )


class OnePosition(Machine):
    """1 where a signal is taken: while a trade is held, others are passed over."""

    inputs = ("signal", "holding_bars")

    def __init__(self):
        self.left = 0.0

    def step(self, signal: Value, held: Value) -> tuple[Value]:
        if self.left > 0:
            self.left -= 1
            return (0.0,)
        if not signal or not held:
            return (0.0,)
        self.left = held
        return (1.0,)


def trades(labelled: DataFrame, signal: Column, cost_pct: float = 0.09, keep: tuple[str, ...] = ()) -> DataFrame:
    """Taken signals of a frame with triple_barrier()'s columns: pnl, the move in percent after costs. signal: true to enter."""
    rows = labelled.withColumn("signal", F.coalesce(signal & C("pnl_pct").isNotNull(), F.lit(False)).cast("int"))
    taken = scan(rows.select("symbol", "ts", "rn", "signal", "holding_bars", "pnl_pct", *keep), [Scan(("taken",), OnePosition)])
    return taken.where("taken = 1").select("symbol", "ts", "rn", "holding_bars", (C("pnl_pct") - cost_pct).alias("pnl"), *keep)


def measures(made: DataFrame) -> DataFrame:
    """Per symbol: trades, win rate, mean and deviation of pnl, their ratio, the ratio to losing deviation, profit factor, bars in
    trades, and the deepest fall of summed pnl below its height (or below zero)."""
    rows = made.withColumn("_sum", F.sum("pnl").over(bar().rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_fall", F.greatest(F.max("_sum").over(bar().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - C("_sum"))
    worse = F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), F.lit(2))))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.avg((C("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("mean_pnl"), F.stddev_pop("pnl").alias("sd_pnl"),
        safe_div(F.avg("pnl"), F.stddev_pop("pnl")).alias("sharpe"), safe_div(F.avg("pnl"), worse).alias("sortino"),
        safe_div(F.sum(F.when(C("pnl") > 0, C("pnl"))), -F.sum(F.when(C("pnl") < 0, C("pnl")))).alias("profit_factor"), F.sum("holding_bars").alias("bars_held"), F.max("_fall").alias("max_drawdown"),
    )


def stability_index(df: DataFrame, x: str, later: Column, low: float, high: float, bins: int = 10) -> DataFrame:
    """Population stability index by symbol between earlier and later rows, over bins of equal width (values outside go to the
    outermost); half a row is added to every bin."""
    b = F.least(F.greatest(F.floor((C(x) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(C(x).isNotNull()).groupBy("symbol").agg(*[F.count_if((b == i) & (later if side else ~later)).alias(f"{'q' if side else 'p'}{i}") for i in range(bins) for side in (0, 1)])
    share = lambda s, i: (C(f"{s}{i}") + 0.5) / (sum((C(f"{s}{j}") for j in range(1, bins)), C(f"{s}0")) + 0.5 * bins)
    terms = [(share("q", i) - share("p", i)) * F.ln(share("q", i) / share("p", i)) for i in range(bins)]
    return counts.select("symbol", sum(terms[1:], terms[0]).alias("psi"))


def brier(df: DataFrame, by: list[str], chance: Column, came: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(chance - came.cast("double"), F.lit(2))).alias("brier"), F.count("*").alias("n"))
