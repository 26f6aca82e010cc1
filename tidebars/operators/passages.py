"""First passages: the first later bar whose value passes a level, however far ahead it is.

A symbol's bars are cut into chunks of `size` by their number, so that one long series spreads over many tasks. A quest is
answered in its own chunk if the passage is there; else the chunks' extremes tell in which later chunk it is (a row a chunk, met
by quests dealt out by their hash), and that chunk answers it. Within either, a table of minima over powers of two is descended
for all quests at once.

Quests: symbol, after (bars with a larger number count), level, value (which column of bars), below (passed by falling), touch
(reaching the level is enough). A NULL level or value is never passed.

lines_passed() answers quests whose level has a slope from the bar `after` on. A line passes below some value of a chunk exactly if it
passes below a corner of the values' lower hull, so a chunk is told by its two hulls, a few points each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.sources.store import cut as kept_once

C = F.col
SIZE = 4096


def first_after(x: np.ndarray, start: np.ndarray, level: np.ndarray, touch: np.ndarray) -> np.ndarray:
    """For each start the first place from there on at which x is below level (or at it, with touch); len(x) if there is none."""
    n = len(x)
    tables, width = [np.where(np.isnan(x), np.inf, x)], 1
    while 2 * width <= n:
        t = tables[-1]
        tables.append(np.minimum(t[: n - 2 * width + 1], t[width : n - width + 1]))
        width *= 2
    at = np.minimum(start, n)
    for k in range(len(tables) - 1, -1, -1):
        inside = np.flatnonzero(at + (1 << k) <= n)
        low = tables[k][at[inside]]
        free = np.where(touch[inside], low > level[inside], low >= level[inside]) | np.isnan(level[inside])
        at[inside[free]] += 1 << k
    last = np.flatnonzero(at < n)  # a rest that no table covers
    miss = np.where(touch[last], tables[0][at[last]] > level[last], tables[0][at[last]] >= level[last]) | np.isnan(level[last])
    at[last[miss]] = n
    return at


def answered(lows: dict[str, np.ndarray], highs: dict[str, np.ndarray], start: np.ndarray, quests: pd.DataFrame) -> np.ndarray:
    """Places for all quests over arrays of lows and highs by value."""
    n = len(next(iter(lows.values())))
    out = np.full(len(quests), n, np.int64)
    level, touch = quests["level"].to_numpy(np.float64, na_value=np.nan), quests["touch"].to_numpy(bool)
    kinds = quests.groupby([quests["value"], quests["below"]], sort=False).indices
    for (value, below), at in kinds.items():
        x = lows[value] if below else -highs[value]
        out[at] = first_after(x, start[at], level[at] if below else -level[at], touch[at])
    return out


def asked(bars: DataFrame, quests: DataFrame, values: tuple[str, ...], size: int) -> tuple[DataFrame, DataFrame]:
    """bars cut into chunks, and quests with the chunk in which they begin."""
    chunk = lambda x: F.floor(x / size).cast("int")
    cut = bars.select("symbol", "rn", *[C(v).cast("double").alias(v) for v in values], chunk(C("rn") - 1).alias("chunk"))
    return cut, quests.withColumn("chunk", chunk(C("after")))


def none_yet(q: pd.DataFrame) -> pd.Series:
    return pd.Series(np.nan, q.index, "float64").astype("Int64")


def settled(cut: DataFrame, quests: DataFrame, ends: DataFrame, within, ahead, deals: int) -> DataFrame:
    """quests with `at`. within(bars of a chunk, quests, places to start at): places; ahead(all chunks' ends, quests, own chunks): chunks,
    -1 for none."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quests.schema if f.name != "chunk")
    told = f"{kept}, at long, chunk int"

    def here(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        own = q["chunk"].to_numpy()
        q = q.drop(columns=["chunk", "at"], errors="ignore")
        if not len(b) or not len(q):
            return q.assign(at=none_yet(q), chunk=own)
        b = b.sort_values("rn")
        first = int(b["rn"].iloc[0])
        got = within(b, q, np.maximum(q["after"].to_numpy(np.int64) + 1 - first, 0))
        return q.assign(at=pd.Series(got + first, q.index, "Int64").mask(got >= len(b)), chunk=own)

    def further(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        own = q["chunk"].to_numpy()
        q = q.drop(columns=["chunk", "at", "deal"])
        got = ahead(c.sort_values("chunk"), q, own) if len(c) and len(q) else np.full(len(q), -1)
        return q.assign(at=none_yet(q), chunk=got.astype(np.int32))

    def met(q: DataFrame) -> DataFrame:
        return cut.groupBy("symbol", "chunk").cogroup(q.groupBy("symbol", "chunk")).applyInPandas(lambda b, x: here(b, x), told)

    near = kept_once(met(quests))
    deal: Column = F.pmod(F.xxhash64("symbol", "after", "level", "value"), F.lit(deals)).cast("int")
    spread = ends.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    open_ = near.where(C("at").isNull()).withColumn("deal", deal)
    sent = kept_once(spread.groupBy("symbol", "deal").cogroup(open_.groupBy("symbol", "deal")).applyInPandas(lambda c, q: further(c, q), told))
    far = met(sent.where(C("chunk") >= 0).drop("at"))
    never = sent.where(C("chunk") < 0)
    return near.where(C("at").isNotNull()).unionByName(far).unionByName(never).drop("chunk")


def passages(bars: DataFrame, quests: DataFrame, values: tuple[str, ...], size: int = SIZE, deals: int = 16) -> DataFrame:
    """quests with `at`: the number rn of the bar, NULL if there is none. bars have symbol, rn (1, 2, 3 ... by symbol) and the values."""
    cut, quests = asked(bars, quests, values, size)
    ends = cut.groupBy("symbol", "chunk").agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("low", F.min), ("high", F.max))])

    def within(b: pd.DataFrame, q: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        x = {v: b[v].to_numpy(np.float64) for v in values}
        return answered(x, x, start, q)

    def ahead(c: pd.DataFrame, q: pd.DataFrame, own: np.ndarray) -> np.ndarray:
        n = int(c["chunk"].iloc[-1]) + 1
        lows, highs = ({v: np.full(n, np.nan) for v in values} for _ in range(2))
        for v in values:
            lows[v][c["chunk"]], highs[v][c["chunk"]] = c[f"low_{v}"], c[f"high_{v}"]
        got = answered(lows, highs, own + 1, q)
        return np.where(got < n, got, -1)

    return settled(cut, quests, ends, within, ahead, deals)


def hull(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Corners of the lower hull of points in the order of x; those without y aren't there."""
    out: list[int] = []
    for i in np.flatnonzero(~np.isnan(y)).tolist():
        while len(out) > 1 and (y[i] - y[out[-2]]) * (x[out[-1]] - x[out[-2]]) <= (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]):
            out.pop()
        out.append(i)
    return out


def lines_passed(bars: DataFrame, quests: DataFrame, value: str, size: int = SIZE, deals: int = 16) -> DataFrame:
    """quests (with slope) with `at`: the first bar after `after` whose value is below (or above) level + slope * (rn - after)."""
    cut, quests = asked(bars, quests, (value,), size)

    def corners(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rn")
        x, y = b["rn"].to_numpy(np.float64), b[value].to_numpy(np.float64)
        low, high = hull(x, y), hull(x, -y)
        head = {"symbol": [b["symbol"].iloc[0]], "chunk": [int(b["chunk"].iloc[0])]}
        return pd.DataFrame(head | {"low_x": [x[low].tolist()], "low_y": [y[low].tolist()], "high_x": [x[high].tolist()], "high_y": [y[high].tolist()]})

    ends = cut.groupBy("symbol", "chunk").applyInPandas(corners, "symbol string, chunk int, low_x array<double>, low_y array<double>, high_x array<double>, high_y array<double>")

    def beyond(r, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        line = r.level + r.slope * (x - r.after)
        return y < line if r.below else y > line

    def within(b: pd.DataFrame, q: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        x, y = b["rn"].to_numpy(np.float64), b[value].to_numpy(np.float64)
        out = []
        for r, s in zip(q.itertuples(), start.tolist(), strict=True):
            hit = beyond(r, x[s:], y[s:])
            out.append(s + int(hit.argmax()) if hit.any() else len(x))
        return np.array(out, np.int64)

    def ahead(c: pd.DataFrame, q: pd.DataFrame, own: np.ndarray) -> np.ndarray:
        sides = {}
        for name in ("low", "high"):
            x, y = (np.concatenate([np.asarray(v, np.float64) for v in c[f"{name}_{k}"]]) for k in "xy")
            sides[name] = np.repeat(c["chunk"].to_numpy(), [len(v) for v in c[f"{name}_x"]]), x, y
        out = []
        for r, mine in zip(q.itertuples(), own.tolist(), strict=True):
            chunk, x, y = sides["low" if r.below else "high"]
            hit = beyond(r, x, y) & (chunk > mine)
            out.append(int(chunk[hit.argmax()]) if hit.any() else -1)
        return np.array(out, np.int64)

    return settled(cut, quests, ends, within, ahead, deals)
