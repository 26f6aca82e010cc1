"""First passages and zones: chunks don't show in results, and small cases by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import passages as P
from tidebars.operators import zones as Z
from tidebars.sources import bars as B


def series(spark, rows):
    """(open, high, low, close) by symbol."""
    start = dt.datetime(2024, 1, 1)
    out = [(s, start + dt.timedelta(minutes=30 * i), *r, 1.0) for s, some in rows.items() for i, r in enumerate(some)]
    return B.numbered(spark.createDataFrame(out, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"))


def walk(seed, n):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = price
        c = o + rng.choice([-2, -1, -1, 0, 1, 1, 2])
        out.append((o, max(o, c) + rng.choice([0, 1]), min(o, c) - rng.choice([0, 1]), c))
        price = c + rng.choice([-3, 0, 0, 0, 3])
    return out


def test_first_after_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 33):
        x = rng.integers(0, 6, n).astype(float)
        x[rng.random(n) < 0.2] = np.nan
        start, level, touch = rng.integers(0, n + 2, 50), rng.integers(0, 6, 50).astype(float), rng.random(50) < 0.5
        level[:5] = np.nan
        got = P.first_after(x, start, level, touch)
        for s, v, t, g in zip(start, level, touch, got, strict=True):
            assert g == next((i for i in range(s, n) if x[i] < v or (t and x[i] == v)), n)


@pytest.mark.parametrize(("size", "deals"), [(4096, 16), (3, 2), (1, 1)])
def test_passages_by_brute_force(spark, size, deals):
    rows = {"a": walk(1, 60), "b": walk(2, 7), "c": [(None,) * 4, (1.0, 2.0, 0.0, 1.0)]}
    rng = random.Random(3)
    quests = [(s, rng.randrange(0, len(some) + 2), rng.choice([None, 90.0, 95.0, 99.0, 101.0, 104.0, 1.0]), v, v == "low", rng.random() < 0.5, i) for i in range(80) for s, some in rows.items() for v in ("low", "high")]
    frame = spark.createDataFrame(quests, "symbol string, after int, level double, value string, below boolean, touch boolean, id int")
    got = P.passages(series(spark, rows), frame, ("low", "high"), size, deals).collect()
    assert len(got) == len(quests)
    for r in got:
        x = [b[2] if r.value == "low" else b[1] for b in rows[r.symbol]]
        hit = lambda v: v is not None and r.level is not None and ((v < r.level if r.below else v > r.level) or (r.touch and v == r.level))  # noqa: B023, E731
        assert r["at"] == next((i + 1 for i, v in enumerate(x) if i + 1 > r.after and hit(v)), None)


def test_passages_of_nothing(spark):
    none = spark.createDataFrame([], "symbol string, after int, level double, value string, below boolean, touch boolean")
    some = spark.createDataFrame([("zz", 1, 2.0, "low", True, True)], none.schema)
    assert P.passages(series(spark, {"a": walk(1, 5)}), none, ("low",)).count() == 0
    assert [r["at"] for r in P.passages(series(spark, {"a": walk(1, 5)}), some, ("low",)).collect()] == [None]


def test_zones_are_the_same_in_any_chunks(spark):
    df = series(spark, {"a": walk(5, 300), "b": walk(6, 120)})
    told = lambda z: sorted(map(tuple, z.select(*Z.ZONE, "met", "broken", "gone").collect()), key=repr)
    whole, small = told(Z.zones(df)), told(Z.zones(df, size=7, deals=3))
    assert whole == small and {r[3] for r in whole} == {"order", "gap", "pivot"}
    for *_, born, _, side, _, bottom, top, met, broken, gone in whole:
        assert bottom <= top and (met is None or met > born) and (broken is None or broken >= born) and (gone is None or gone >= broken)


def test_a_block_becomes_a_breaker_and_goes(spark):
    flat = [(10.0, 10.5, 9.5, 10.0)] * 12
    up = [(10.0, 12.0, 9.9, 11.0), *[(10.0, 10.4, 9.6, 10.1)] * 10, (10.0, 10.2, 8.0, 9.0), (9.0, 13.5, 9.0, 13.0)]  # a swing high, its pull-back, the break
    then = [(13.0, 13.0, 10.0, 12.0), (12.0, 12.0, 7.0, 7.5), (7.5, 7.9, 7.0, 7.2), (7.2, 10.6, 7.0, 10.5)]  # met, broken, still under, gone
    df = series(spark, {"a": flat + up + then})
    zone = Z.lives(df, [Z.order_blocks(df)]).where("side = 1").collect()
    assert len(zone) == 1
    z = zone[0]
    block = len(flat) + 12
    assert (z.origin, z.bottom, z.top, z.born) == (block, 8.0, 10.2, block + 1)
    assert (z.met, z.broken, z.gone) == (block + 2, block + 3, block + 5)


def test_pivot_zones_near_one_that_holds_are_left_out(spark):
    wave = [100 + 10 * (1 - abs((i % 40) - 20) / 20) for i in range(400)]
    df = series(spark, {"a": [(v, v + 0.5, v - 0.5, v) for v in wave]})
    tops = Z.supply_demand(df).where("side = -1").collect()
    assert len(tops) == 1  # all tops are alike, and none is passed
    falling = series(spark, {"a": [(v, v + 0.5, v - 0.5, v) for v in (x - i / 4 for i, x in enumerate(wave))]})
    assert Z.supply_demand(falling).where("side = -1").agg(F.count("*")).first()[0] > 3


@pytest.mark.parametrize(("size", "deals"), [(4096, 4), (5, 2)])
def test_lines_passed_by_brute_force(spark, size, deals):
    rows = {"a": walk(1, 60), "b": walk(2, 9), "c": [(None,) * 4, (1.0, 2.0, 0.0, 1.0)]}
    rng = random.Random(4)
    quests = [(s, rng.randrange(0, len(some) + 2), rng.choice([None, 95.0, 100.0, 110.0]), rng.choice([-0.5, 0.0, 0.125, 1.0]), rng.random() < 0.5, "close", i) for i in range(60) for s, some in rows.items()]
    frame = spark.createDataFrame(quests, "symbol string, after int, level double, slope double, below boolean, value string, id int")
    got = P.lines_passed(series(spark, rows), frame, "close", size, deals).collect()
    assert len(got) == len(quests)
    for r in got:
        for i, b in enumerate(rows[r.symbol]):
            line = None if r.level is None else r.level + r.slope * (i + 1 - r.after)
            if i + 1 > r.after and line is not None and b[3] is not None and (b[3] < line if r.below else b[3] > line):
                assert r["at"] == i + 1
                break
        else:
            assert r["at"] is None


def test_hull_has_the_lowest_point_in_any_direction():
    rng = np.random.default_rng(2)
    x, y = np.arange(40.0), rng.integers(0, 9, 40).astype(float)
    y[::7] = np.nan
    corners = P.hull(x, y)
    for slope in (-3.0, -0.5, 0.0, 0.3, 2.0):
        assert np.nanmin(y - slope * x) == np.min(y[corners] - slope * x[corners])


def test_trend_lines_in_any_chunks(spark):
    df = series(spark, {"a": walk(8, 240), "b": walk(9, 100)})
    told = lambda f: sorted(map(tuple, f.drop("ts").collect()))
    assert told(Z.trend_lines(df, 3)) == told(Z.trend_lines(df, 3, size=11, deals=2)) != []


def test_pools_need_three_swings_and_none_beyond():
    m = Z.Pools()
    told = [m.step(h, low, 1.0, float(i)) for i, (h, low) in enumerate([(10.0, None), (None, 5.0), (10.4, None), (None, 5.2), (None, 4.0), (9.8, None), (None, 4.5), (10.1, 4.4)])]
    assert told[5] == (-1.0, -1.0, (9.8 + 10.4) / 2 - 1.0, (9.8 + 10.4) / 2 + 1.0)  # from the first swing's bar
    assert all(t == (None,) * 4 for i, t in enumerate(told) if i not in (5, 6))
    assert m.step(12.0, None, 1.0, 9.0) == (None,) * 4 and m.swings[0] == (1, 8.0, 12.0)
    assert m.step(None, None, None, None) == (None,) * 4


def test_a_pool_is_broken_beyond_its_far_edge(spark):
    up = [100 + 10 * (1 - abs((i % 24) - 12) / 12) for i in range(120)] + [100.0 + i for i in range(30)]
    df = series(spark, {"a": [(v, v + 0.2, v - 0.2, v) for v in up]})
    rows = Z.lives(df, [Z.pools(df)]).where("side = -1").collect()
    assert len(rows) == 1 and rows[0].origin == 13 and rows[0].broken is not None
    assert up[rows[0].broken - 1] + 0.2 > rows[0].top >= up[rows[0].broken - 2] + 0.2
