"""Clusters of volatility in windows: the last values are split by one-dimensional three-means to convergence, and a trend line uses the
centre next to the current value as its range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.operators import recurrence as S
from tidebars.operators.recurrence import Machine, SuperTrend, Value

C = F.col
#: Where the centres start between a window's least and largest value: high, middle, low.
STARTS = (0.75, 0.5, 0.25)


def centres(windows: np.ndarray, most: int = 1000) -> np.ndarray:
    """(rows, 3): the centres of each window after three-means has settled, all windows at once. A value as near to two centres belongs to
    neither, and a centre without values stays where it is."""
    low, high = windows.min(axis=1), windows.max(axis=1)
    at = np.stack([low + (high - low) * s for s in STARTS], axis=1)
    going = np.arange(len(windows))
    for _ in range(most):
        if not len(going):
            break
        x = windows[going]
        far = np.abs(x[:, :, None] - at[going][:, None, :])
        mine = np.stack([(far[:, :, k] < far[:, :, i]) & (far[:, :, k] < far[:, :, j]) for k, i, j in ((0, 1, 2), (1, 0, 2), (2, 0, 1))], axis=2)
        n = mine.sum(axis=1)
        new = np.where(n > 0, (x[:, :, None] * mine).sum(axis=1) / np.maximum(n, 1), at[going])
        moved = (np.abs(new - at[going]) > 1e-12 * np.abs(at[going])).any(axis=1)
        at[going] = new
        going = going[moved]
    return at


def volatility_clusters(bars: DataFrame, n: int = 10, window: int = 100) -> DataFrame:
    """bars with cluster (0 high, 1 middle, 2 low) and centre: that of the last `window` mean true ranges next to the current one (the
    first of equally near ones); NULL until there are as many. What a bar reads is bounded by the window."""
    df = S.scan(bars, [S.Scan(("_range",), lambda: S.Atr(n))])
    df = df.withColumn("_last", R.values("_range", window))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_last")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            whole = f["_last"].notna().to_numpy()
            cluster, centre = np.full(len(f), -1), np.full(len(f), np.nan)
            if whole.any():
                at = centres(np.stack(f["_last"][whole].to_list()).astype(np.float64))
                near = np.abs(at - f["_range"].to_numpy(np.float64)[whole][:, None]).argmin(axis=1)
                cluster[whole], centre[whole] = near, at[np.arange(len(at)), near]
            yield f.drop(columns="_last").assign(cluster=pd.Series(cluster, f.index, "Int32").mask(cluster < 0), centre=centre)

    return df.mapInPandas(run, f"{kept}, cluster int, centre double")


class Given:
    """A range that is told rather than made of the bars."""

    value: Value = None

    def step(self, *_: Value) -> tuple[Value]:
        return (self.value,)


class AdaptiveTrend(Machine):
    inputs = ("high", "low", "close", "centre")

    def __init__(self, k: float = 3.0):
        self.line, self.range = SuperTrend(k=k), Given()
        self.line.atr = self.range

    def step(self, h: Value, low: Value, c: Value, centre: Value) -> tuple[Value, ...]:
        self.range.value = centre
        return self.line.step(h, low, c)


def adaptive_trend(bars: DataFrame, **more: int) -> DataFrame:
    """bars with cluster, centre, trend_line and trend_side: the trailing trend whose range is the centre."""
    made = volatility_clusters(bars, **more)
    return S.scan(made, [S.Scan(("trend_line", "trend_side"), AdaptiveTrend)])
