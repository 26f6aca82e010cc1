"""Zones that live until they are met: order blocks and the breakers they turn into, fair value gaps, supply and demand, liquidity pools.

Each maker gives one row a zone: symbol, born (the number of the bar that makes it), ts, kind, side (1: support, -1: resistance),
origin (the bar it is drawn from), bottom, top. lives() adds when it is met, broken and gone, without a bound on the look-ahead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import true
from tidebars.operators import recurrence as S
from tidebars.operators.passages import lines_passed, passages
from tidebars.sources.store import cut

C = F.col
ZONE = ["symbol", "ts", "born", "kind", "side", "origin", "bottom", "top"]
#: What a bar is held against: its body's ends, and the rest as they are.
VALUES = ("high", "low", "close", "body_high", "body_low")


def with_bodies(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"body_high": F.greatest("open", "close"), "body_low": F.least("open", "close")})


def swings(df: DataFrame, n: int) -> DataFrame:
    """_top and _bottom: level and bar of the last swing, confirmed n bars later, when no bar since has gone beyond it; a swing starts
    where the side of such bars turns. _top_at and _bottom_at: the bar that confirmed it."""
    upper, lower = R.prev("high", n) > R.highest("high", n), R.prev("low", n) < R.lowest("low", n)
    df = df.withColumn("_leg", F.when(true(upper), -1).when(true(lower), 1))
    df = df.withColumn("_turns", C("_leg").isNotNull() & true(F.coalesce(R.previous(C("_leg")) != C("_leg"), F.lit(True))))
    swing = lambda leg, x: R.carried(F.when(C("_turns") & (C("_leg") == leg), F.struct(R.prev(x, n).alias("level"), C("rn").alias("at"))))
    return df.withColumns({"_top": swing(-1, "high"), "_bottom": swing(1, "low")})


def order_blocks(bars: DataFrame, n: int = 10) -> DataFrame:
    """Where the close first passes a swing, the bar against the move that reached furthest since the swing (of equal ones the first)
    is the block: it supports after a break upwards."""
    df = swings(bars, n)
    out = []
    for side, swing, past, edge, furthest in ((1, "_top", C("close") > C("_top.level"), C("low"), F.min), (-1, "_bottom", C("close") < C("_bottom.level"), -C("high"), F.min)):
        one = df.withColumn("_bar", F.struct(edge.alias("edge"), C("rn").alias("rn"), C("low").alias("low"), C("high").alias("high")))
        one = one.withColumn("_recent", F.min("_bar").over(R.last_n(n))).where(C(swing).isNotNull())
        since = Window.partitionBy("symbol", C(swing)["at"]).orderBy("ts")
        before = since.rowsBetween(Window.unboundedPreceding, -1)
        one = one.withColumns({"_head": F.first("_recent").over(since), "_past": true(past).cast("int")})
        one = one.withColumns({"_earlier": F.coalesce(F.sum("_past").over(before), F.lit(0)), "_since": furthest("_bar").over(before)})
        one = one.where((C("_past") == 1) & (C("_earlier") == 0) & (C("rn") > C(swing)["at"]))
        block = F.least("_head", F.coalesce("_since", "_head"))
        out.append(one.select("symbol", "ts", C("rn").alias("born"), F.lit("order").alias("kind"), F.lit(side).alias("side"), block["rn"].alias("origin"), block["low"].alias("bottom"), block["high"].alias("top")))
    return out[0].unionByName(out[1])


def value_gaps(bars: DataFrame, factor: float = 2.0) -> DataFrame:
    """Ranges that three bars leave out, with the middle one beyond them and its body larger than `factor` times the mean body so far
    (as shares of the open)."""
    share = F.when(R.prev("open") != 0, (R.prev("close") - R.prev("open")) / R.prev("open"))
    df = bars.withColumns({"_share": share, "_h2": R.prev("high", 2), "_l2": R.prev("low", 2), "_c1": R.prev("close")})
    df = df.withColumn("_least", factor * F.sum(F.abs("_share")).over(R.so_far()) / (C("rn") - 1))
    up = true((C("low") > C("_h2")) & (C("_c1") > C("_h2")) & (C("_share") > C("_least")))
    down = true((C("high") < C("_l2")) & (C("_c1") < C("_l2")) & (-C("_share") > C("_least")))
    side = F.when(up, 1).when(down, -1)
    return df.withColumn("side", side).where("side IS NOT NULL").select(
        "symbol", "ts", C("rn").alias("born"), F.lit("gap").alias("kind"), "side", (C("rn") - 1).alias("origin"), F.when(C("side") == 1, C("_h2")).otherwise(C("high")).alias("bottom"), F.when(C("side") == 1, C("low")).otherwise(C("_l2")).alias("top")
    )


def quest(name: str, after: Column, level: Column, value: Column, below: Column, touch: bool) -> Column:
    return F.struct(F.lit(name).alias("name"), after.alias("after"), level.alias("level"), value.alias("value"), below.alias("below"), F.lit(touch).alias("touch"))


def asked(bars: DataFrame, zones: DataFrame, quests: list[Column], **more: int) -> DataFrame:
    """zones with a column for each quest: the bar that passes its level."""
    names = [c for c in zones.columns if c not in ("symbol", "born", "kind", "side")]
    rows = zones.withColumn("_q", F.explode(F.array(*quests))).select("*", "_q.*").drop("_q")
    found = passages(with_bodies(bars), rows, VALUES, **more)
    keys = ["symbol", "born", "kind", "side"]  # a bar makes one zone of a kind and side
    wanted = ["met", "broken", "gone"]
    return found.groupBy(*keys).agg(*[F.first(n).alias(n) for n in names], *[F.max(F.when(C("name") == w, C("at"))).alias(f"_{w}") for w in wanted])


def supply_demand(bars: DataFrame, n: int = 10, mean: int = 50, width: float = 0.25, apart: float = 2.0, history: int = 20, **more: int) -> DataFrame:
    """Zones of `width` mean ranges at confirmed pivots, unless one of the last `history` zones of the side that still holds has its
    middle within `apart` mean ranges."""
    df = S.scan(bars, [S.Scan(("_range",), lambda: S.Atr(mean))])
    df = df.withColumns({"_ph": R.pivot_high("high", n, n), "_pl": R.pivot_low("low", n, n)})
    deep = C("_range") * width
    sides = F.array(
        F.struct(F.lit(-1).alias("side"), (C("_ph") - deep).alias("bottom"), C("_ph").alias("top")),
        F.struct(F.lit(1).alias("side"), C("_pl").alias("bottom"), (C("_pl") + deep).alias("top")),
    )
    made = df.where(C("_range").isNotNull()).withColumn("_s", F.explode(sides)).where(C("_s.top").isNotNull() & C("_s.bottom").isNotNull())
    made = made.select("symbol", "ts", C("rn").alias("born"), F.lit("pivot").alias("kind"), C("_s.side").alias("side"), (C("rn") - n).alias("origin"), C("_s.bottom").alias("bottom"), C("_s.top").alias("top"), (C("_range") * apart).alias("near"))
    side = C("side") == 1
    broken = quest("broken", C("born") - 1, F.when(side, C("bottom")).otherwise(C("top")), F.lit("close"), side, True)
    made = asked(bars, made, [broken], **more).drop("_met", "_gone")
    rows = made.select(*ZONE, "near", "_broken").repartition("symbol", "side").sortWithinPartitions("symbol", "side", "born")

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []  # the last zones: middle, bar that breaks it
        for f in frames:
            taken = []
            for symbol, s, born, bottom, top, near, end in zip(f["symbol"], f["side"], f["born"], f["bottom"], f["top"], f["near"], f["_broken"], strict=True):
                if (symbol, s) != key:
                    key, held = (symbol, s), []
                middle = (bottom + top) / 2
                free = all(e < born or abs(middle - m) > near for m, e in held)
                if free:
                    held = [(middle, float("inf") if pd.isna(end) else end), *held][:history]
                taken.append(free)
            yield f[ZONE][taken]

    return rows.mapInPandas(greedy, ", ".join(f"`{c}` {t}" for c, t in rows.select(*ZONE).dtypes))


def lives(bars: DataFrame, zones: list[DataFrame], **more: int) -> DataFrame:
    """zones with met, broken and gone (bar numbers, NULL while not yet): met is the first bar after birth that reaches the zone;
    a gap or a pool is broken by a bar beyond its far edge, a pivot zone by a close at it, an order block by a whole body beyond it. An order
    block is a breaker from then on, and gone at the first later close beyond the other edge; the others are gone when broken."""
    every = reduce(DataFrame.unionByName, [z.select(*ZONE) for z in zones])
    up, order, pivot = C("side") == 1, C("kind") == "order", C("kind") == "pivot"
    near, far = F.when(up, C("top")).otherwise(C("bottom")), F.when(up, C("bottom")).otherwise(C("top"))
    by = F.when(order, F.when(up, F.lit("body_low")).otherwise(F.lit("body_high"))).when(pivot, F.lit("close")).otherwise(F.when(up, F.lit("low")).otherwise(F.lit("high")))
    first = [quest("met", C("born"), near, F.when(up, F.lit("low")).otherwise(F.lit("high")), up, True)]
    broken = quest("broken", F.when(C("kind").isin("gap", "pool"), C("born")).otherwise(C("born") - 1), far, by, up, False)
    first.append(broken.withField("touch", pivot))
    one = cut(asked(bars, every, first, **more).drop("_gone").withColumnsRenamed({"_met": "met", "_broken": "broken"}))
    breakers, rest = one.where(order & C("broken").isNotNull()), one.where(~(order & C("broken").isNotNull())).withColumn("gone", F.when(~order, C("broken")))
    two = asked(bars, breakers, [quest("gone", C("broken"), near, F.lit("close"), ~up, False)], **more).drop("_met", "_broken").withColumnRenamed("_gone", "gone")
    return rest.unionByName(two)


def zones(bars: DataFrame, **more: int) -> DataFrame:
    """All kinds of zones with their lives."""
    return lives(bars, [order_blocks(bars), value_gaps(bars), supply_demand(bars, **more)], **more)


class Pools(S.Machine):
    """Alternating swings (of pivots of one kind in a row the furthest), and pools where the last pivot lies within `wide` of at least two
    others of its kind with none beyond: side, first bar, bottom and top. The last `most` swings are looked at."""

    inputs = ("_ph", "_pl", "_wide", "rn")

    def __init__(self, most: int = 50, least: int = 3):
        self.most, self.least = most, least
        self.swings: list[tuple[int, float, float]] = []  # newest first: side, bar, price
        self.told: dict[int, float] = {}

    def found(self, side: int, price: float, wide: float) -> tuple[S.Value, ...] | None:
        inside = []
        for s, at, p in self.swings:
            if s == side:
                if side * (p - price) > wide:
                    break
                if abs(p - price) < wide:
                    inside.append((at, p))
        if len(inside) < self.least or self.told.get(side) == inside[-1][0]:
            return None
        self.told[side] = inside[-1][0]
        middle = (min(p for _, p in inside) + max(p for _, p in inside)) / 2
        return float(-side), inside[-1][0], middle - wide, middle + wide

    def step(self, high: S.Value, low: S.Value, wide: S.Value, rn: S.Value) -> tuple[S.Value, ...]:
        out = None
        for side, price in ((1, high), (-1, low)):
            if price is None or out is not None:  # a high goes before a low of the same bar
                continue
            swing = (side, rn - 1, price)
            if not self.swings or self.swings[0][0] != side:
                self.swings = [swing, *self.swings][: self.most]
            elif side * (price - self.swings[0][2]) > 0:
                self.swings[0] = swing
            out = (wide is not None and self.found(side, price, wide)) or (None,) * 4
        return out or (None,) * 4


def pools(bars: DataFrame, left: int = 7, mean: int = 10, share: float = 0.69) -> DataFrame:
    """Liquidity pools: where at least three swings of a kind lie within `share` mean ranges, with none beyond since. Highs make
    resistance, lows support; a pool that grows is told once."""
    df = S.scan(bars, [S.Scan(("_range",), lambda: S.Atr(mean))])
    df = df.withColumns({"_ph": R.pivot_high("high", left, 1), "_pl": R.pivot_low("low", left, 1), "_wide": C("_range") * share})
    df = S.scan(df, [S.Scan(("_side", "_from", "_low", "_high"), Pools)]).where(C("_side").isNotNull())
    return df.select("symbol", "ts", C("rn").alias("born"), F.lit("pool").alias("kind"), C("_side").cast("int").alias("side"), C("_from").cast("int").alias("origin"), C("_low").alias("bottom"), C("_high").alias("top"))


def trend_lines(bars: DataFrame, n: int = 10, back: int = 10, **more: int) -> DataFrame:
    """Lines of sight between pivots: rising ones (side 1) through two lows with no close below since the older, falling ones (-1) through
    two highs with none above; for each newer pivot the one to the furthest of the `back` pivots that it sees. A row a line: born (the
    bar that confirms the newer pivot), origin (the older pivot's bar), newer (the newer one's), slope, level (at birth), broken."""
    df = bars.withColumns({"_ph": R.pivot_high("high", n, n), "_pl": R.pivot_low("low", n, n)})
    order = Window.partitionBy("symbol").orderBy("rn")
    points = []
    for side, x in ((1, "_pl"), (-1, "_ph")):
        some = df.where(C(x).isNotNull()).select("symbol", "ts", C("rn").alias("born"), (C("rn") - n).alias("rn"), C(x).alias("v"))
        points.append(some.withColumns({"side": F.lit(side), "_before": F.collect_list(F.struct(C("rn").alias("rn"), C("v").alias("v"))).over(order.rowsBetween(1 - back, -1))}))
    pairs = points[0].unionByName(points[1]).withColumn("p", F.explode("_before")).where(C("side") * (C("v") - C("p.v")) > 0)
    slope = (C("v") - C("p.v")) / (C("rn") - C("p.rn"))
    # a line through a bar's own close must not be passed by the rounding of its slope
    quests = pairs.select(
        "symbol", "ts", "born", "side", C("rn").alias("newer"), C("p.rn").alias("after"), (C("p.v") - C("side") * F.abs(C("p.v")) * 1e-9).alias("level"), slope.alias("slope"), (C("side") == 1).alias("below"),
        F.lit("close").alias("value"), F.lit(False).alias("touch"), C("p.v").alias("start"),
    )
    seen = lines_passed(bars, quests, "close", **more).where(C("at").isNull() | (C("at") > C("born")))
    first = Window.partitionBy("symbol", "side", "born").orderBy("after")
    seen = seen.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    level = C("start") + C("slope") * (C("born") - C("after"))
    return seen.select("symbol", "ts", "born", "side", C("after").alias("origin"), "newer", "slope", level.alias("level"), C("at").alias("broken"))
