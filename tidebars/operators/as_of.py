"""Two grids of bars beside each other: the last coarse bar that had closed, and the finer bars inside a coarse one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import safe_div, true
from tidebars.sources.bars import bucket

C = F.col


def as_of(left: DataFrame, right: DataFrame, columns: list[str], known: Column) -> DataFrame:
    """left with columns of the last row of right (by symbol) whose time `known` isn't after left's ts, NULL before the first. Both are
    laid in one order and the last value is carried on: one exchange by symbol, and no pair is built. Of rows known at the same time the one
    with the largest values counts."""
    some = right.select("symbol", known.alias("_at"), F.struct(*columns).alias("_last")).groupBy("symbol", "_at").agg(F.max("_last").alias("_last"))
    mine = left.select("symbol", C("ts").alias("_at"), F.struct(*left.columns).alias("_row"))
    both = mine.unionByName(some, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("_at", C("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_last", ignorenulls=True).over(order)).where(C("_row").isNotNull())
    return both.select("_row.*", *[C(f"_last.{c}").alias(c) for c in columns])


def within(coarse: DataFrame, fine: DataFrame, seconds: int, columns: list[str], name: str = "finer") -> DataFrame:
    """coarse with an array of the finer bars inside each (ts and columns, in order); a bar without any has an empty one. An array has
    at most as many as fit into a bar."""
    packed = fine.groupBy("symbol", bucket("ts", seconds).alias("ts")).agg(F.array_sort(F.collect_list(F.struct("ts", *columns))).alias(name))
    out = coarse.join(packed, ["symbol", "ts"], "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(dict(packed.dtypes)[name])))


def triggers(fine: DataFrame, coarse: DataFrame, seconds: int, n: int = 20, apart: float = 0.5) -> DataFrame:
    """fine with the bias of the last closed coarse bar (its close `apart` deviations or more from its mean: 1 or -1, else 0), the levels of
    the last confirmed swing points, swept (through a level and closed back: 1 at a low, -1 at a high), confirmed (by volume, or by a
    close far along the bar) and entry (all agree: the side, else 0)."""
    score = safe_div(C("close") - R.mean("close", n), R.deviation("close", n))
    told = coarse.withColumns({"bias": F.when(score >= apart, 1).when(score <= -apart, -1).otherwise(0), "support": R.carried(R.pivot_low("low")), "resistance": R.carried(R.pivot_high("high"))})
    df = as_of(fine, told, ["bias", "support", "resistance"], C("ts") + F.expr(f"INTERVAL {seconds} SECONDS"))
    c, o = C("close"), C("open")
    swept = F.when(true((C("low") < C("support")) & (c > C("support"))), 1).when(true((C("high") > C("resistance")) & (c < C("resistance"))), -1).otherwise(0)
    df = df.withColumns({"swept": swept, "_loud": true(C("volume") > 1.5 * R.mean("volume", n)), "_along": safe_div(c - o, C("high") - C("low"))})
    df = df.withColumn("confirmed", ((C("swept") != 0) & (C("_loud") | true(C("_along") * C("swept") > 0.5))).cast("int"))
    return df.withColumn("entry", F.when((C("confirmed") == 1) & (C("swept") == C("bias")), C("swept")).otherwise(0))


def zone_volume(coarse: DataFrame, fine: DataFrame, seconds: int) -> DataFrame:
    """coarse with the volume of its finer bars that overlap the zone of the last confirmed swing high (from the higher end of its bar's body
    to its high), how many do, and the coarse bar's own volume if it overlaps."""
    top = F.when(R.pivot_high("high").isNotNull(), F.struct(R.pivot_high("high").alias("top"), R.prev(F.greatest("open", "close"), 2).alias("bottom")))
    df = within(coarse.withColumn("_zone", R.carried(top)), fine, seconds, ["high", "low", "volume"])
    df = df.withColumns({"zone_top": C("_zone.top"), "zone_bottom": C("_zone.bottom")})
    inside = F.filter("finer", lambda x: (x["low"] < C("zone_top")) & (x["high"] > C("zone_bottom")))
    return df.withColumns({
        "finer_volume": F.when(C("zone_top").isNotNull(), F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["volume"])), "finer_bars": F.when(C("zone_top").isNotNull(), F.size(inside)),
        "own_volume": F.when(C("zone_top").isNotNull(), F.when(true((C("low") < C("zone_top")) & (C("high") > C("zone_bottom"))), C("volume")).otherwise(0.0)),
    })
