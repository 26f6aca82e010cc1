"""Nearest neighbours in time order: of the bars before, those that are further away than the last one taken, at least a little apart
in time, the latest few of which vote. Distances are sums of logarithms of one plus the differences of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def voters(distance: np.ndarray, number: np.ndarray, k: int, spacing: int) -> list[int]:
    """Places of the last k bars taken. A bar is taken if it is at least as far away as the mark and its number isn't a multiple of
    spacing; the mark is the last taken bar's distance, or once more than k are held, that of the one three quarters through them."""
    able = np.flatnonzero(number % spacing != 0)
    distance, mark, held, at = distance[able], -1.0, [], 0
    while at < len(distance):
        beyond = distance[at:] >= mark
        if not beyond.any():
            break
        at += int(beyond.argmax())
        held.append(at)
        mark = distance[at]
        if len(held) > k:
            mark = distance[held[round(k * 3 / 4)]]
            held.pop(0)
        at += 1
    return able[held].tolist()


def predicted(bars: DataFrame, features: list[str], label: str, k: int = 8, spacing: int = 4, back: int = 2000) -> DataFrame:
    """bars with votes (of the label) and neighbours (how many): over the `back` bars before with all features and a label. One ordered pass
    a symbol that carries as many rows from batch to batch; a bar without all features has none."""
    rows = bars.repartition("symbol").sortWithinPartitions("symbol", "ts")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, x, y, n = None, np.zeros((0, len(features))), np.zeros(0), np.zeros(0, np.int64)
        for f in frames:
            votes, counts = [], []
            made, labels, numbers = f[features].to_numpy(np.float64), f[label].to_numpy(np.float64), f["rn"].to_numpy(np.int64)
            names = f["symbol"].to_numpy()
            ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(f)] if len(f) else []
            for start, end in zip([0, *ends], ends, strict=False):
                if names[start] != symbol:
                    symbol, x, y, n = names[start], x[:0], y[:0], n[:0]
                x, y, n = np.concatenate((x, made[start:end])), np.concatenate((y, labels[start:end])), np.concatenate((n, numbers[start:end]))
                old = len(x) - (end - start)
                for i in range(old, len(x)):
                    lo = max(0, i - back)
                    if np.isnan(x[i]).any():
                        votes.append(np.nan)
                        counts.append(0)
                        continue
                    whole = lo + np.flatnonzero(~np.isnan(x[lo:i]).any(axis=1) & ~np.isnan(y[lo:i]))
                    distance = np.log1p(np.abs(x[whole] - x[i])).round(9).sum(axis=1).round(9)
                    took = voters(distance, n[whole], k, spacing)
                    votes.append(y[whole[took]].sum() if took else np.nan)
                    counts.append(len(took))
                x, y, n = x[-back:], y[-back:], n[-back:]
            yield f.assign(votes=pd.Series(votes, f.index, "float64"), neighbours=pd.Series(counts, f.index, "int32"))

    return rows.mapInPandas(run, f"{kept}, votes double, neighbours int")
