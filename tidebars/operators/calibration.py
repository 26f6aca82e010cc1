"""Scaling, calibration and thresholds in all folds at once: each is a grouped aggregate by symbol and fold, and Newton's steps are a
few of them one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.nulls import safe_div
from tidebars.operators import gate
from tidebars.operators.gate import FOLD
from tidebars.operators.labels import LONG
from tidebars.sources.store import cut

C = F.col
#: Thresholds that are tried.
GRID = [k / 20 for k in range(4, 17)]
RIDGE, LONGEST = 1e-6, 1.0


def scaled(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with features laid between -1 and 1 by the least and largest of their fold's training rows (validation rows may leave that
    range); NULL for a feature without variance there."""
    ends = rows.where("part = 'train'").groupBy(*FOLD).agg(*[F.struct(F.min(f).alias("a"), F.max(f).alias("b")).alias(f"_{f}") for f in features])
    at = {f: safe_div(2 * (C(f) - C(f"_{f}.a")), C(f"_{f}.b") - C(f"_{f}.a")) - 1 for f in features}
    return rows.join(ends, FOLD, "left").withColumns(at).drop(*[f"_{f}" for f in features])


def odds(rows: DataFrame, features: list[str], label: str = "label", most: float = 10.0) -> DataFrame:
    """Validation rows with the gate model's log odds of a rise (score, within +-most) and whether it came (rose)."""
    known = gate.known(rows, features, label).withColumn("rose", (C(label) == LONG).cast("int"))
    asked = known.withColumn(label, F.when(C("part") == "val", LONG).otherwise(C(label)))
    p = C("chance")
    score = F.ln(F.greatest(p, F.lit(1e-15)) / F.greatest(1 - p, F.lit(1e-15)))
    return gate.chances(asked, features, label).select(*FOLD, "ts", "rose", F.greatest(F.lit(-most), F.least(F.lit(most), score)).alias("score"))


def halves(rows: DataFrame) -> DataFrame:
    """rows with early: whether they are of the earlier half of their fold (the smaller one)."""
    w = Window.partitionBy(*FOLD)
    return rows.withColumn("early", F.row_number().over(w.orderBy("ts")) * 2 <= F.count("*").over(w))


def chance(a: Column, b: Column, score: Column) -> Column:
    return 1 / (1 + F.exp(-(a * score + b)))


def platt(rows: DataFrame, steps: int = 12) -> DataFrame:
    """symbol, fold, a, b and n: the logistic of score that fits rose on early rows, with targets drawn in as by one more row of either
    class; Newton's steps from (0, the log odds of the classes), none longer than LONGEST."""
    early = rows.where("early")
    n = early.groupBy(*FOLD).agg(F.sum("rose").alias("ones"), F.count("*").alias("n"))
    early = cut(early.join(n, FOLD).withColumn("_t", F.when(C("rose") == 1, (C("ones") + 1) / (C("ones") + 2)).otherwise(1 / (C("n") - C("ones") + 2))))
    at = n.select(*FOLD, F.lit(0.0).alias("a"), F.ln((C("ones") + 1) / (C("n") - C("ones") + 1)).alias("b"), "n")
    s = C("score")
    for _ in range(steps):
        p = chance(C("a"), C("b"), s)
        w = p * (1 - p)
        sums = early.drop("n").join(at, FOLD).groupBy(*FOLD, "a", "b", "n").agg(*[F.sum(x).alias(k) for k, x in (("g", (C("_t") - p) * s), ("h", C("_t") - p), ("ss", w * s * s), ("s", w * s), ("w", w))])
        ss, ww = C("ss") + RIDGE, C("w") + RIDGE
        det = ss * ww - C("s") * C("s")
        sums = sums.withColumns({"da": (ww * C("g") - C("s") * C("h")) / det, "db": (ss * C("h") - C("s") * C("g")) / det})
        part = F.least(F.lit(1.0), LONGEST / F.greatest(F.abs("da"), F.abs("db"), F.lit(1e-300)))
        at = cut(sums.select(*FOLD, (C("a") + part * C("da")).alias("a"), (C("b") + part * C("db")).alias("b"), "n"))
    return at


def threshold(rows: DataFrame) -> DataFrame:
    """symbol, fold and threshold: of GRID the one with the best F1 on early rows (needs p), the lowest of equal ones."""
    tried = rows.where("early").select(*FOLD, "rose", "p", F.explode(F.array(*[F.lit(t) for t in GRID])).alias("t"))
    over = C("p") >= C("t")
    counts = tried.groupBy(*FOLD, "t").agg(F.count_if(over & (C("rose") == 1)).alias("hit"), F.count_if(over | (C("rose") == 1)).alias("any"))
    f1 = F.when(C("any") > 0, 2 * C("hit") / (C("hit") + C("any"))).otherwise(0.0)  # hit + any: what was told and what came
    return counts.groupBy(*FOLD).agg(F.max_by("t", F.struct(F.round(f1, 12), -C("t"))).alias("threshold"))


def calibrated(rows: DataFrame) -> DataFrame:
    """Per fold: a, b, the log loss on later rows before and after calibration, the threshold, and the later rows at or beyond it with how
    many of them rose. Folds of a single row have none."""
    fit = platt(rows)
    told = rows.join(fit.drop("n"), FOLD).withColumn("p", chance(C("a"), C("b"), C("score")))
    told = told.join(threshold(told), FOLD)
    loss = lambda p: -F.avg(F.ln(F.least(F.greatest(F.when(C("rose") == 1, p).otherwise(1 - p), F.lit(1e-15)), F.lit(1 - 1e-15))))
    late, signal = told.where(~C("early")), C("p") >= C("threshold")
    return late.groupBy(*FOLD, "a", "b", "threshold").agg(
        loss(chance(F.lit(1.0), F.lit(0.0), C("score"))).alias("raw_loss"), loss(C("p")).alias("loss"), F.count("*").alias("n"), F.count_if(signal).alias("signals"), F.count_if(signal & (C("rose") == 1)).alias("hits")
    )
