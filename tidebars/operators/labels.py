"""Forward-looking labels, walk-forward folds and their measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.nulls import pct, safe_div, true
from tidebars.functions.rolling import bar

C = F.col
LONG, SHORT, NEUTRAL, NONE, QUIET = 0, 1, 2, -1, -2


def triple_barrier(df: DataFrame, up: float | Column = 2.4, down: float | Column = 2.4, bars: int = 12, least_pct: float | Column = 0.3, quiet_pct: float | Column = 0.0, atr: str = "atr_14") -> DataFrame:
    """label, holding_bars, exit_price and pnl_pct: which of two prices, `up` and `down` ranges off the close, is reached first in
    the next bars; the nearer one where a bar reaches both (the lower if they're as near), and the sign of a move of at least
    least_pct where none is. -1: too few bars follow; -2: ranges are under quiet_pct of the close."""
    ahead = bar().rowsBetween(1, bars)
    c, a = C("close"), C(atr)
    df = df.withColumns({"_next": F.collect_list(F.struct("high", "low")).over(ahead), "_left": F.count(F.lit(1)).over(bar().rowsBetween(0, Window.unboundedFollowing)), "_end": F.lead("close", bars).over(bar()), "_hi": c + up * a, "_lo": c - down * a})
    first = lambda f: F.array_position(F.transform("_next", f), True)
    df = df.withColumns({"_iu": first(lambda x: F.coalesce(x["high"] >= C("_hi"), F.lit(False))), "_id": first(lambda x: F.coalesce(x["low"] <= C("_lo"), F.lit(False)))})
    hit_up, hit_down = C("_iu") > 0, C("_id") > 0
    rises = hit_up & (~hit_down | (C("_iu") < C("_id")) | ((C("_iu") == C("_id")) & (F.lit(down) > F.lit(up))))
    falls = hit_down & ~rises
    ret = pct(C("_end") - c, c)
    tail, unknown, quiet = C("_left") <= bars, a.isNull() | (a <= 0), true((F.lit(quiet_pct) > 0) & (pct(a, c) < quiet_pct))
    out = F.when(tail, NONE).when(unknown, NEUTRAL).when(quiet, QUIET).when(rises, LONG).when(falls, SHORT).when(ret > least_pct, LONG).when(ret < -least_pct, SHORT).otherwise(NEUTRAL)
    skipped = tail | unknown | quiet
    price = F.when(~skipped, F.when(rises, C("_hi")).when(falls, C("_lo")).otherwise(C("_end")))
    held = F.when(skipped, bars).when(rises, C("_iu")).when(falls, C("_id")).otherwise(bars)
    return df.withColumns({"label": out, "holding_bars": held.cast("int"), "exit_price": price}).withColumn("pnl_pct", pct(C("exit_price") - c, c))


def trim(df: DataFrame, n: int = 150) -> DataFrame:
    """Without the first n bars of each symbol."""
    return df.withColumn("_n", F.row_number().over(bar())).where(C("_n") > n).drop("_n")


def class_shares(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", C("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))


def prior_entropy(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Log loss (nats) of guessing by class shares."""
    return class_shares(df, by, label).groupBy(*by).agg((-F.sum(C("share") * F.ln("share"))).alias("prior"), F.sum("n").alias("n"))


def log_loss(df: DataFrame, by: list[str], chance: Column, eps: float = 1e-15) -> DataFrame:
    """chance: the probability given to the class that came."""
    return df.groupBy(*by).agg((-F.avg(F.ln(F.least(F.greatest(chance, F.lit(eps)), F.lit(1 - eps))))).alias("log_loss"), F.count("*").alias("n"))


def folds(df: DataFrame, train_months: int = 9, val_months: int = 1, step_months: int = 1, end: str | None = None) -> DataFrame:
    """(symbol, fold, train_start, train_end, val_end) from the first month that begins with or after the data, while validation
    ends by the last bar and before `end`."""
    span = df.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    month = F.trunc(C("a").cast("date"), "MM").cast("timestamp_ntz")
    span = span.withColumn("base", F.when(C("a") == month, month).otherwise(F.add_months(month.cast("date"), 1).cast("timestamp_ntz")))
    count = F.floor(F.months_between(C("b").cast("date"), C("base").cast("date")) / step_months).cast("int") + 1
    made = span.select("symbol", "base", "b", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(0)))).alias("fold"))
    at = lambda m: F.add_months(C("base").cast("date"), C("fold") * step_months + m).cast("timestamp_ntz")
    made = made.select("symbol", "fold", at(0).alias("train_start"), at(train_months).alias("train_end"), at(train_months + val_months).alias("val_end"), "b")
    keep = C("val_end") <= C("b")
    if end is not None:
        keep = keep & (C("val_end") <= F.lit(end).cast("timestamp_ntz"))
    return made.where(keep).drop("b")


def fold_rows(df: DataFrame, made: DataFrame, purge: int = 12, embargo: int = 12) -> DataFrame:
    """Rows of every fold with part 'train' or 'val': folds are spread over their months, and a row meets those of its month only
    (as many as a fold has months); the last `purge` of training and the first `embargo` of validation are left out."""
    month = lambda x: F.trunc(x.cast("date"), "MM")
    spread = made.withColumn("_month", F.explode(F.sequence(month(C("train_start")), month(C("val_end")), F.expr("interval 1 month"))))
    rows = df.withColumn("_month", month(C("ts"))).join(spread, ["symbol", "_month"]).drop("_month").where((C("ts") >= C("train_start")) & (C("ts") < C("val_end")))
    rows = rows.withColumn("part", F.when(C("ts") < C("train_end"), "train").otherwise("val"))
    w = Window.partitionBy("symbol", "fold", "part")
    rows = rows.withColumns({"_up": F.row_number().over(w.orderBy("ts")), "_down": F.row_number().over(w.orderBy(C("ts").desc()))})
    return rows.where(F.when(C("part") == "train", C("_down") > purge).otherwise(C("_up") > embargo)).drop("_up", "_down")


def prior_gate(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per fold: the log loss of training class shares on validation rows (add-one smoothed), that of validation's own shares, and
    their ratio. The model is a plug: any column of probabilities can stand in its place."""
    known = rows.where(C(label).isin(LONG, SHORT, NEUTRAL))
    train = known.where("part = 'train'").groupBy("symbol", "fold").agg(*[(F.count_if(C(label) == k) + 1).alias(f"c{k}") for k in (LONG, SHORT, NEUTRAL)])
    val = known.where("part = 'val'").join(train, ["symbol", "fold"])
    total = C("c0") + C("c1") + C("c2")
    chance = safe_div(F.when(C(label) == 0, C("c0")).when(C(label) == 1, C("c1")).otherwise(C("c2")), total)
    loss = log_loss(val, ["symbol", "fold"], chance).withColumnRenamed("n", "n_val")
    prior = prior_entropy(known.where("part = 'val'"), ["symbol", "fold"], label).drop("n")
    return loss.join(prior, ["symbol", "fold"]).withColumn("ratio", safe_div(C("log_loss"), C("prior")))


def gate_summary(results: DataFrame, most: float = 0.98) -> DataFrame:
    """Means over folds, the ratio of means, the median of ratios, and the folds that pass."""
    return results.groupBy("symbol").agg(
        F.count("*").alias("folds"), F.avg("log_loss").alias("mean_log_loss"), F.avg("prior").alias("mean_prior"), safe_div(F.avg("log_loss"), F.avg("prior")).alias("mean_ratio"),
        F.median("ratio").alias("median_ratio"), F.count_if(C("ratio") <= most).alias("folds_passed"),
    )
