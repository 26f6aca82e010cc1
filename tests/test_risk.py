"""Sizes, kill switches, bootstrap intervals and bars by amount on small frames."""

import datetime as dt
import hashlib
import statistics

import numpy as np
from pyspark.sql import functions as F

from tidebars.operators import evaluation, risk

START = dt.datetime(2024, 1, 1)


def trades_of(spark, rows):
    return spark.createDataFrame([(s, START + dt.timedelta(hours=h), float(p), float(q)) for s, h, p, q in rows], "symbol string, ts timestamp_ntz, pnl double, planned double")


def test_sizes_risk_one_percent_and_are_capped(spark):
    df = spark.createDataFrame([(100.0, 20.0), (100.0, 2.0), (100.0, 0.0), (100.0, None), (0.0, 1.0)], "close double, stop double")
    got = [(r["size"], r["capped"]) for r in risk.position_size(df, F.col("stop")).collect()]
    assert got == [(5.0, 0), (10.0, 1), (None, 0), (None, 0), (None, 0)]


def test_kill_switches(spark):
    rows = [("a", 1, 3, 1), ("a", 24, -5, 1), ("a", 48, -4, 9), ("a", 24 * 9, -1, 9), ("b", 1, 1, 1)]
    got = {(r["symbol"], r["day"].day): (round(r["week_fall"], 6), r["slips"], r["halt_week"], r["halt_day"], r["halt_slip"]) for r in risk.kill_switches(trades_of(spark, rows)).collect()}
    assert got == {("a", 1): (0, 0, 0, 0, 0), ("a", 2): (5, 1, 0, 1, 1), ("a", 3): (9, 0, 1, 0, 0), ("a", 10): (1, 0, 0, 0, 0), ("b", 1): (0, 0, 0, 0, 0)}
    assert risk.kill_switches(trades_of(spark, [])).count() == 0


def test_red_days_in_a_row(spark):
    rows = [("a", 24 * i, 1 if i < 3 else -1, 5) for i in range(9)]
    got = [r["red_run"] for r in risk.kill_switches(trades_of(spark, rows), days=1).orderBy("day").collect()]
    assert got[:3] == [0, 0, 0] and got[-3:] == [got[-1] - 2, got[-1] - 1, got[-1]] and got[-1] >= 4


def test_bootstrap_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0.4, 1.0, 23).round(3)
    rows = [("a", h, p, 1) for h, p in enumerate(x)]
    got = {r["metric"]: r for r in risk.bootstrap(trades_of(spark, rows), draws=400).collect()}
    n, normal = len(x), statistics.NormalDist()
    metrics = {"sharpe": lambda v: v.mean() / v.std(), "hit_rate": lambda v: (v > 0).mean(), "net": lambda v: v.sum()}
    drawn = [x[[int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(1, n + 1)]] for b in range(1, 401)]
    for name, f in metrics.items():
        values, point = np.sort([round(f(v), 9) for v in drawn]), round(f(x), 9)
        bias = normal.inv_cdf(((values < point).sum() + (values == point).sum() / 2) / 400)
        left = np.array([f(np.delete(x, i)) for i in range(n)])
        d = left.mean() - left
        bend = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        at = [normal.cdf(bias + (bias + z) / (1 - bend * (bias + z))) for z in (-1.959964, 1.959964)]
        lower, upper = (values[min(max(int(np.ceil(a * 400)), 1), 400) - 1] for a in at)
        assert abs(got[name]["point"] - point) < 1e-8 and got[name]["draws"] == 400
        assert abs(got[name]["lower"] - lower) < 1e-8 and abs(got[name]["upper"] - upper) < 1e-8
    assert risk.bootstrap(trades_of(spark, []), draws=5).count() == 0
    assert risk.bootstrap(trades_of(spark, [("a", 1, 2, 1)]), draws=5).count() == 0  # nothing can be left out


def test_amount_bars_are_those_of_one_running_sum(spark):
    rng = np.random.default_rng(2)
    rows = [(s, float(rng.integers(1, 100)), float(rng.integers(1, 50)), None if i % 31 == 0 else int(i // 7), i) for s in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, price double, amount double, day int, at int")
    got = {(r["symbol"], r["bar"]): (r["volume"], r["ticks"], r["high"]) for r in evaluation.amount_bars(df, "amount", 100.0, ["day", "at"]).collect()}
    want: dict = {}
    for s in "ab":
        total = 0.0
        for _, p, a, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: (-1 if r[3] is None else r[3], r[4])):
            v, k, h = want.get((s, int(total // 100)), (0.0, 0, 0.0))
            want[s, int(total // 100)] = (v + a, k + 1, max(h, p))
            total += a
    assert got == want


def test_amount_bars_do_not_hang_on_the_order_of_rows(spark):
    ticks = [("a", 5.0, 60.0, 1, 1), ("a", 9.0, 70.0, 1, 1), ("a", 9.0, 60.0, 1, 1), ("a", 7.0, 10.0, 1, 2)]
    for rows in (ticks, ticks[::-1]):
        df = spark.createDataFrame(rows, "symbol string, price double, amount double, day int, at int").coalesce(1)
        got = sorted(tuple(r) for r in evaluation.amount_bars(df, "amount", 100.0, ["day", "at"]).collect())
        assert got == [("a", 0, 5.0, 9.0, 5.0, 9.0, 120.0, 2), ("a", 1, 9.0, 9.0, 7.0, 7.0, 80.0, 2)]
