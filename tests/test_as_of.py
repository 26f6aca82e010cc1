"""As-of values and finer bars inside coarser ones, by loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidebars.operators import as_of as A

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_as_of_by_a_loop(spark):
    rng = random.Random(1)
    left = [(rng.choice("ab"), at(rng.randrange(200)), i) for i in range(60)] + [("c", at(5), 99), ("a", at(0), -1)]
    right = [(rng.choice("ab"), at(rng.randrange(200)), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(30)] + [("a", at(50), 9.0), ("a", at(50), 8.0)]
    made = A.as_of(spark.createDataFrame(left, "symbol string, ts timestamp_ntz, _at int"), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, v double"), ["v"], F.col("ts"))
    got = {(r.symbol, r["_at"]): r.v for r in made.collect()}
    assert len(got) == len(left)
    for s, ts, i in left:
        before = [(r[1], -1.0 if r[2] is None else r[2]) for r in right if r[0] == s and r[1] <= ts]
        want = max(before)[1] if before else None
        assert got[s, i] == (None if want == -1.0 else want)


def test_finer_bars_inside(spark):
    fine = [("a", at(m), float(m)) for m in (0, 5, 29, 30, 61)] + [("b", at(1), 1.0)]
    coarse = [("a", at(0), 1), ("a", at(30), 2), ("a", at(90), 3)]
    made = A.within(spark.createDataFrame(coarse, "symbol string, ts timestamp_ntz, k int"), spark.createDataFrame(fine, "symbol string, ts timestamp_ntz, volume double"), 1800, ["volume"])
    assert {r.k: [x.volume for x in r.finer] for r in made.collect()} == {1: [0.0, 5.0, 29.0], 2: [30.0], 3: []}


def test_as_of_nothing(spark):
    left = spark.createDataFrame([("a", at(0), 1)], "symbol string, ts timestamp_ntz, k int")
    none = spark.createDataFrame([], "symbol string, ts timestamp_ntz, v double")
    assert [tuple(r)[2:] for r in A.as_of(left, none, ["v"], F.col("ts")).collect()] == [(1, None)]
    assert A.as_of(left.limit(0), none, ["v"], F.col("ts")).count() == 0
