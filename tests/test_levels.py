"""Channels, neighbours in time and machines with feedback against loops, and rows without values."""

import datetime as dt
import random

import numpy as np
import pytest

from tidebars.operators import channels as H
from tidebars.operators import clusters as C
from tidebars.operators import feedback as K
from tidebars.operators import neighbours as N
from tidebars.operators import recurrence as S
from tidebars.operators import setups as U
from tidebars.sources import bars as B


def loop_voters(distance, number, k, spacing):
    mark, held = -1.0, []
    for i, (d, m) in enumerate(zip(distance, number, strict=True)):
        if m % spacing and d >= mark:
            mark = d
            held.append(i)
            if len(held) > k:
                mark = distance[held[round(k * 3 / 4)]]
                held = held[1:]
    return held


def test_voters_by_a_loop():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        d, m = rng.integers(0, 12, n).astype(float), np.arange(1, n + 1)
        for k in (1, 3, 8):
            assert N.voters(d, m, k, 4) == loop_voters(d, m, k, 4)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_neighbours_over_batches(spark, batch):
    rng = random.Random(2)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i + 1, None if rng.random() < 0.1 else rng.random(), rng.random(), None if i % 9 == 0 else float(rng.choice([-1, 1]))) for s in "ab" for i in range(40)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rn int, p double, q double, label double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.symbol, r.rn): (r.votes, r.neighbours) for r in N.predicted(frame, ["p", "q"], "label", k=3, back=15).collect()}
        assert N.predicted(frame.limit(0), ["p", "q"], "label").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for s in "ab":
        mine = [r for r in rows if r[0] == s]
        for r in mine:
            before = [o for o in mine if r[2] - 15 <= o[2] < r[2] and None not in o[3:]] if r[3] is not None else []
            d = [round(sum(round(float(np.log1p(abs(o[c] - r[c]))), 9) for c in (3, 4)), 9) for o in before]
            took = loop_voters(d, [o[2] for o in before], 3, 4)
            assert got[s, r[2]] == ((sum(before[i][5] for i in took), len(took)) if took else (None, 0))


def test_channels_by_loops():
    rng = random.Random(3)
    for _ in range(20):
        pivots = [float(rng.randrange(40)) for _ in range(rng.randrange(1, 12))]
        low, high, n = H.grown(np.array(pivots), 6.0)
        for i, p in enumerate(pivots):
            a = b = p
            count = 0
            for q in pivots:
                if (b - q if q <= b else q - a) <= 6.0:
                    a, b, count = (min(a, q), b, count + 1) if q <= b else (a, max(b, q), count + 1)
            assert (low[i], high[i], n[i]) == (a, b, count)
        took = H.strongest(low, high, n, 1, 3)
        assert took[0] == int(n.argmax()) and len(took) <= 3
        for i, k in enumerate(took):
            assert all(not (low[j] <= e <= high[j]) for j in took[:i] for e in (low[k], high[k]))


def made(spark, closes, symbol="a"):
    start = dt.datetime(2024, 1, 1)
    out = [(symbol, start + dt.timedelta(minutes=30 * i), *((None,) * 4 if c is None else (c, c + 1, c - 1, c)), 10.0) for i, c in enumerate(closes)]
    return B.numbered(spark.createDataFrame(out, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))


def test_channels_of_few_bars(spark):
    assert H.channels(made(spark, [1.0, 2.0, None])).count() == 0
    wave = [100 + 10 * (1 - abs((i % 40) - 20) / 20) for i in range(400)]
    top = H.channels(made(spark, wave)).where("place = 1").orderBy("ts").collect()
    assert top and all(r.high - r.low <= (12.0) * 0.05 + 1e-9 and r.strength >= 20 for r in top)


def test_machines_skip_bars_without_values(spark):
    rng = random.Random(5)
    closes = [100 + rng.randrange(-9, 10) for _ in range(60)]
    scans = lambda: [S.Scan(("a", "b", "c"), K.Qqe), S.Scan(("d", "e"), K.HalfTrend), S.Scan(("f", "g"), lambda: K.RangeFilter(5, 1.0))]
    whole = [tuple(r)[8:] for r in S.scan(made(spark, [float(c) for c in closes]), scans()).orderBy("ts").collect()]
    holes = [float(c) for c in closes[:30]] + [None, None] + [float(c) for c in closes[30:]]
    some = [tuple(r)[8:] for r in S.scan(made(spark, holes), scans()).orderBy("ts").collect()]
    assert some[:30] + some[32:] == whole
    assert {r[2] for r in whole} <= {1.0, -1.0} and {r[4] for r in whole} <= {0.0, 1.0} and any(r[6] < 0 for r in whole) and any(r[6] > 0 for r in whole)


def loop_centres(x):
    low, high = min(x), max(x)
    at = [low + (high - low) * s for s in C.STARTS]
    for _ in range(200):
        new = []
        for k in range(3):
            mine = [v for v in x if all(abs(v - at[k]) < abs(v - at[o]) for o in range(3) if o != k)]
            new.append(sum(mine) / len(mine) if mine else at[k])
        if max(abs(a - b) for a, b in zip(new, at, strict=True)) <= 1e-12:
            break
        at = new
    return at


def test_centres_by_a_loop():
    rng = np.random.default_rng(7)
    windows = np.concatenate((rng.integers(0, 9, (30, 12)), rng.gamma(1.0, 2.0, (30, 12)), np.full((1, 12), 4.0)))
    for x, got in zip(windows, C.centres(windows), strict=True):
        assert got == pytest.approx(loop_centres(x.tolist()))
    assert C.centres(np.zeros((0, 12))).shape == (0, 3)


def test_the_trend_over_clusters_needs_a_window(spark):
    rng = random.Random(9)
    rows = C.adaptive_trend(made(spark, [100 + 3 * rng.random() * (1 + i // 30) for i in range(90)] + [None]), n=5, window=40).orderBy("ts").collect()
    assert [r.centre is None for r in rows[:43]] == [True] * 43 and all(r.centre and r.cluster in (0, 1, 2) and r.trend_side in (1.0, -1.0) for r in rows[44:90])
    assert len(rows) == 91


def test_setups_of_odd_bars(spark):
    """A bar without values, bars on top of each other, and a symbol of one bar."""
    rows = U.setups(made(spark, [10.0, 10.0, None, 10.0, 11.0] * 8).unionByName(made(spark, [5.0], "b"))).orderBy("symbol", "ts").collect()
    assert len(rows) == 41 and rows[0].bars_since_ema21_touch_5m == 0 and rows[-1].mtf_trend_alignment == 0.0
    assert all(r.pullback_depth_pct is None or 0 <= r.pullback_depth_pct <= 1 for r in rows)
