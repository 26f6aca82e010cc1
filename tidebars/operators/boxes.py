"""Box counting, for windows of prices (runs in pandas UDFs)."""

from __future__ import annotations

import numpy as np
import pandas as pd


def box_dimension(prices: pd.Series) -> pd.Series:
    """Box-counting dimension of each window's path on the unit square: dyadic grids, vertical steps filled."""

    def one(window) -> float | None:
        if window is None or len(window) < 10:
            return None
        p = np.asarray(window, float)
        n, height = len(p), float(np.ptp(p))
        if height == 0:
            return None
        x, y = np.arange(n) / (n - 1), (p - p.min()) / height
        levels = range(1, n.bit_length())
        counts = []
        for k in levels:
            bx, by = np.floor(x * 2**k).astype(int), np.floor(y * 2**k).astype(int)
            step = np.flatnonzero(np.diff(bx))
            spans = [np.arange(min(by[i], by[i + 1]), max(by[i], by[i + 1]) + 1) + (int(bx[i + 1]) << 32) for i in step]
            counts.append(len(np.unique(np.concatenate([by + (bx.astype(np.int64) << 32), *spans]))))
        return float(np.polyfit(np.log(2.0) * np.array(levels), np.log(counts), 1)[0]) if len(counts) >= 3 else None

    return prices.map(one)
