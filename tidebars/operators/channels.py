"""Support and resistance channels: pivots clustered greedily into intervals of bounded width, ranked by strength, overlaps removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions import rolling as R

C = F.col


def grown(pivots: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pivot the interval that takes in, in their order, all pivots that leave it at most `width` wide: low, high and how
    many. All intervals grow at once, a pivot a step."""
    low, high, n = pivots.copy(), pivots.copy(), np.zeros(len(pivots), np.int64)
    for p in pivots:
        under = p <= high
        fits = np.where(under, high - p, p - low) <= width
        low = np.where(fits & under, np.minimum(low, p), low)
        high = np.where(fits & ~under, np.maximum(high, p), high)
        n += fits
    return low, high, n


def strongest(low: np.ndarray, high: np.ndarray, strength: np.ndarray, least: float, most: int) -> list[int]:
    """Intervals by strength (of equal ones the first), without those that have an edge inside one already taken."""
    left, out = strength.astype(np.float64), []
    while len(out) < most and len(left):
        at = int(left.argmax())
        if left[at] < least:
            break
        out.append(at)
        inside = lambda x, a=low[at], b=high[at]: (x >= a) & (x <= b)
        left[inside(high) | inside(low)] = -1
    return out


def channels(bars: DataFrame, n: int = 10, back: int = 290, span: int = 300, share: float = 5.0, weight: int = 20, least: int = 1, most: int = 10) -> DataFrame:
    """At each bar that confirms a pivot (a high before a low), the channels of the pivots of the last `back` bars: place (1: strongest), low,
    high, strength. A channel is at most `share` hundredths of the last `span` bars' range wide; a pivot in it counts `weight`, a bar
    of the last `back` with its high or low in it 1. Bars before `span` have none. What an event reads is bounded by `back`."""
    df = bars.withColumns({"_ph": R.pivot_high("high", n, n), "_pl": R.pivot_low("low", n, n)})
    df = df.withColumns({"_p": F.coalesce("_ph", "_pl"), "_width": (R.highest("high", span) - R.lowest("low", span)) * (share / 100)})
    last = R.last_n(back + 1)
    df = df.withColumns({"_pivots": F.collect_list("_p").over(last), "_highs": F.collect_list("high").over(last), "_lows": F.collect_list("low").over(last)})
    rows = df.where(C("_p").isNotNull() & C("_width").isNotNull()).select("symbol", "ts", "_pivots", "_highs", "_lows", "_width")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                symbol, ts, pivots, highs, lows, width = r
                low, high, count = grown(np.asarray(pivots, np.float64)[::-1], width)
                touched = lambda x, low=low, high=high: (np.asarray(x)[:, None] <= high) & (np.asarray(x)[:, None] >= low)
                strength = weight * count + (touched(highs) | touched(lows)).sum(axis=0)
                out += [(symbol, ts, k + 1, low[i], high[i], int(strength[i])) for k, i in enumerate(strongest(low, high, strength, least * weight, most))]
            yield pd.DataFrame(out, columns=["symbol", "ts", "place", "low", "high", "strength"])

    return rows.mapInPandas(run, f"symbol string, ts {dict(rows.dtypes)['ts']}, place int, low double, high double, strength int")
