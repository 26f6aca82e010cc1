"""Boosted trees over folds: the two ways to sum agree, stopping, and what trees learn."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.operators import boosting as B
from tidebars.plans import gates


def fold_rows(spark, folds=2, n=120, seed=1, null=False):
    rng, out = random.Random(seed), []
    for fold in range(folds):
        for i in range(n):
            x, y = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0])
            label = 0 if x + 0.3 * rng.gauss(0, 1) > 0.4 else 1 if y > 1 else 2
            out.append(("a", fold, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "train" if i < n * 2 // 3 else "val", label, x, y))
    if null:
        out += [("a", 0, dt.datetime(2025, 1, 1), "train", 1, None, 1.0), ("a", 0, dt.datetime(2025, 1, 2), "train", -1, 1.0, 1.0), ("a", 9, dt.datetime(2025, 1, 1), "train", 1, 1.0, 1.0), ("b", 0, dt.datetime(2025, 1, 1), "val", 1, 1.0, 1.0)]
    return spark.createDataFrame(out, "symbol string, fold int, ts timestamp_ntz, part string, label int, x double, y double")


def test_chunks_of_a_fold_sum_to_the_same_trees(spark):
    rows = fold_rows(spark, null=True)
    few = {"rounds": 2, "depth": 2, "bins": 8, "least_rows": 5, "rate": 0.3, "renew": 1}
    told = lambda plan: sorted((r.fold, r.best, r.losses, r.splits, r.leaves, r.gains) for r in B.boosted(rows, ["x", "y"], plan=plan).collect())
    one, many = told(B.Plan(**few)), told(B.Plan(**few, chunk=30))
    assert one == many and [r[0] for r in one] == [0, 1]


def test_trees_beat_class_shares_and_stop(spark):
    rows = fold_rows(spark, n=600)
    plan = B.Plan(rounds=60, patience=5, rate=0.2, depth=3, bins=32, least_rows=10)
    made = B.boosted(rows, ["x", "y"], plan=plan).collect()
    for r in made:
        assert r.best == int(np.argmin(r.losses[1:])) + 1 and (r.round == 60 or r.round - r.best == 5) and len(r.losses) == r.round + 1
    gate = B.boosted_gate(rows, ["x", "y"], plan=plan).collect()
    assert all(r.ratio < 0.6 for r in gate)
    top = B.gain(B.boosted(rows, ["x", "y"], plan=plan), ["x", "y"]).collect()
    assert [r.place for r in sorted(top, key=lambda r: -r.gain)] == [1, 2]


def test_leaves_by_brute_force(spark):
    """One tree of depth one: the cut and its values found by trying all."""
    rows = fold_rows(spark, folds=1)
    got = B.boosted(rows, ["x", "y"], plan=B.Plan(rounds=1, depth=1, bins=256, least_rows=5, rate=1.0)).first()
    held = [(r.x, r.y, r.label) for r in rows.where("part = 'train'").collect()]
    share = [sum(r[2] == k for r in held) / len(held) for k in range(3)]
    for k in range(3):
        g = [round((share[k] - (r[2] == k)) * B.UNIT) for r in held]
        h = [round(1.5 * share[k] * (1 - share[k]) * B.UNIT)] * len(held)
        best = None
        for f in range(2):
            values = sorted({r[f] for r in held})
            for e, edge in enumerate(values[:-1]):
                at = [r[f] <= edge for r in held]
                gl, hl, nl = (sum(v for v, a in zip(x, at, strict=True) if a) for x in (g, h, [1] * len(held)))
                gr, hr = sum(g) - gl, sum(h) - hl
                if min(nl, len(held) - nl) >= 5 and (best is None or gl * gl / hl + gr * gr / hr > best[0] + 1e-6):
                    best = (gl * gl / hl + gr * gr / hr, f, e, -gl / hl, -gr / hr)
        assert got.splits[2 * k : 2 * k + 2] == list(best[1:3])
        assert got.leaves[2 * k : 2 * k + 2] == pytest.approx(best[3:])


def test_the_gate_learns_on_real_bars(spark):
    rows = gates.five_rows(spark, "/root/testdata/sf0.01")
    made = B.boosted_gate(rows, gates.FIVE, plan=B.Plan(rounds=30)).groupBy("symbol").agg(F.avg("log_loss").alias("l"), F.avg("prior").alias("p")).collect()
    assert made and all(r.l / r.p < 1.1 for r in made)
