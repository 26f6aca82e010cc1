"""Scaling, Platt's logistic and thresholds by fold, by loops."""

import datetime as dt
import math
import random

from tidebars.operators import calibration as K


def scored(spark, folds=3, n=80):
    rng, out = random.Random(1), []
    for f in range(folds):
        for i in range(n):
            s = rng.gauss(0, 3)
            out.append(("a", f, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), int(rng.random() < 1 / (1 + math.exp(-0.4 * s + 0.5))) if f < 2 else 1, s))
    return spark.createDataFrame(out, "symbol string, fold int, ts timestamp_ntz, rose int, score double"), out


def test_platt_reaches_the_best_fit(spark):
    frame, rows = scored(spark)
    halves = K.halves(frame)
    got = {r.fold: (r.a, r.b, r.n) for r in K.platt(halves).collect()}
    for f in range(3):
        early = [r for r in rows if r[1] == f][:40]
        ones = sum(r[3] for r in early)
        t = [(ones + 1) / (ones + 2) if r[3] else 1 / (len(early) - ones + 2) for r in early]
        a, b, n = got[f]
        assert n == 40

        def loss(a, b):
            p = [1 / (1 + math.exp(-(a * r[4] + b))) for r in early]
            return -sum(x * math.log(q) + (1 - x) * math.log(1 - q) for x, q in zip(t, p, strict=True))

        for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
            assert loss(a, b) <= loss(a + da, b + db) + 1e-6  # a fold of one class too
    out = {r.fold: r for r in K.calibrated(halves).collect()}
    assert all(out[f].n == 40 and out[f].hits <= out[f].signals <= 40 for f in out)
    assert out[0].loss < out[0].raw_loss and out[0].threshold in K.GRID


def test_thresholds_by_trying(spark):
    rng = random.Random(4)
    rows = [("a", 0, True, rng.randrange(2), rng.random()) for _ in range(30)] + [("a", 0, False, 1, 0.9), ("b", 0, True, 0, 0.1)]
    got = {r.symbol: r.threshold for r in K.threshold(spark.createDataFrame(rows, "symbol string, fold int, early boolean, rose int, p double")).collect()}

    def f1(t):
        some = [(r[3], r[4] >= t) for r in rows if r[0] == "a" and r[2]]
        return 2 * sum(y and s for y, s in some) / (sum(y for y, _ in some) + sum(s for _, s in some))

    assert got["a"] == max(K.GRID, key=lambda t: (round(f1(t), 12), -t)) and got["b"] == K.GRID[0]


def test_scaling_by_training_rows(spark):
    rows = [("a", 0, "train", 1.0, 5.0), ("a", 0, "train", 3.0, 5.0), ("a", 0, "val", 4.0, 5.0), ("a", 1, "val", 4.0, 5.0), ("a", 0, "train", None, None)]
    got = K.scaled(spark.createDataFrame(rows, "symbol string, fold int, part string, x double, y double"), ["x", "y"]).collect()
    assert sorted((r.fold, r.part, r.x) for r in got if r.x is not None) == [(0, "train", -1.0), (0, "train", 1.0), (0, "val", 2.0)]
    assert all(r.y is None for r in got) and len(got) == 5


def test_nothing_to_calibrate(spark):
    none = spark.createDataFrame([], "symbol string, fold int, ts timestamp_ntz, rose int, score double")
    assert K.calibrated(K.halves(none)).count() == 0
    one = spark.createDataFrame([("a", 0, dt.datetime(2024, 1, 1), 1, 0.5)], none.schema)
    assert K.calibrated(K.halves(one)).count() == 0
