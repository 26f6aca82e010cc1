"""The learned gate and studies on small frames."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tidebars.operators import gate, studies
from tidebars.sources import bars as B


def fold(spark, rows):
    return spark.createDataFrame(rows, "symbol string, fold int, part string, ts int, label int, a double, b double")


def test_model_beats_shares_where_a_feature_tells_the_class(spark):
    rows = [("s", 0, p, i, i % 3, float(i % 3) + 0.01 * (i % 7), 0.1 * (i % 5)) for p in ("train", "val") for i in range(90)]
    got = gate.model_gate(fold(spark, rows), ["a", "b"]).collect()
    assert len(got) == 1 and got[0]["n_val"] == 90 and got[0]["ratio"] < 0.05 and math.isclose(got[0]["prior"], math.log(3), rel_tol=1e-9)
    assert [(r["feature"], r["place"]) for r in gate.importance(fold(spark, rows), ["a", "b"], top=1).collect()] == [("a", 1)]


def test_gate_leaves_out_rows_without_a_class_or_a_feature_and_unseen_classes_cost_the_most(spark):
    rows = [("s", 0, "train", i, 0, float(i), 1.0) for i in range(5)] + [("s", 0, "val", 1, 1, 1.0, 1.0), ("s", 0, "val", 2, -1, 1.0, 1.0), ("s", 0, "val", 3, 0, None, 1.0)]
    (got,) = gate.model_gate(fold(spark, rows), ["a", "b"]).collect()
    assert got["n_val"] == 1 and math.isclose(got["log_loss"], -math.log(1e-15), rel_tol=1e-9) and got["ratio"] is None
    assert gate.model_gate(fold(spark, []), ["a", "b"]).collect() == []


def test_decision_has_four_tiers(spark):
    def tier(*ratios):
        return gate.decision(spark.createDataFrame(list(zip("xyz", ratios, strict=True)), "symbol string, mean_ratio double"), "x").collect()[0]["tier"]

    assert [tier(0.9, 0.9, 0.9), tier(1.0, 0.9, 1.0), tier(1.0, 1.0, None), tier(0.9, 0.9, 1.0)] == ["a", "b", "c", "d"]


def test_signals_expire_and_alternate(spark):
    start = dt.datetime(2024, 1, 1)
    sides = [1, 1, 1, 1, 0, 1, -1, -1, 0, -1, 1]
    df = B.numbered(spark.createDataFrame([("s", start + dt.timedelta(hours=i), s) for i, s in enumerate(sides)], "symbol string, ts timestamp_ntz, side int"))
    yes = F.lit(True)
    got = [r["signal"] for r in studies.composed(df, F.col("side") == 1, F.col("side") == -1, yes, yes).orderBy("ts").collect()]
    assert got == [1, 0, 0, 0, 0, 0, -1, 0, 0, 0, 1]
    late = [r["signal"] for r in studies.composed(df, F.col("side") == 1, F.col("side") == -1, F.col("rn") == 4, yes).orderBy("ts").collect()]
    assert late == [0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0]  # the fourth leading bar is past its expiry
