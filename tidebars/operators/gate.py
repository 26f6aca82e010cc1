"""A learned model for the walk-forward gate: Gaussian class densities of the features (naive Bayes), fitted in every fold at once by
one grouped aggregate, so folds and symbols spread and nothing is fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.nulls import safe_div
from tidebars.operators.labels import LONG, NEUTRAL, SHORT, log_loss, prior_entropy

C = F.col
FOLD = ["symbol", "fold"]
#: Variances are at least this.
LEAST = 1e-12


def known(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Rows with one of the three classes and every feature."""
    return rows.where(C(label).isin(LONG, SHORT, NEUTRAL)).na.drop(subset=features)


def fitted(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """A row for each symbol and fold: classes (at most three) with their counts, means and variances in training rows."""
    parts = rows.where("part = 'train'").groupBy(*FOLD, label).agg(
        F.count("*").alias("n"), F.array(*[F.avg(f) for f in features]).alias("means"), F.array(*[F.greatest(F.var_pop(f), F.lit(LEAST)) for f in features]).alias("variances")
    )
    return parts.groupBy(*FOLD).agg(F.collect_list(F.struct(C(label).alias("k"), "n", "means", "variances")).alias("classes"))


def chances(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Validation rows with the probability that their fold's model gives to the class that came."""
    x = F.array(*features)

    def height(c: Column) -> Column:
        terms = F.zip_with(F.zip_with(x, c["means"], lambda a, m: (a - m) * (a - m)), c["variances"], lambda d, v: d / v + F.ln(v))
        return F.ln(c["n"]) - F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2

    val = rows.where("part = 'val'").join(fitted(rows, features, label), FOLD)
    val = val.withColumn("_at", F.transform("classes", lambda c: F.struct(c["k"].alias("k"), height(c).alias("l"))))
    val = val.withColumn("_top", F.array_max(F.transform("_at", lambda a: a["l"])))
    mass = lambda keep: F.aggregate("_at", F.lit(0.0), lambda s, a: s + F.when(keep(a), F.exp(a["l"] - C("_top"))).otherwise(0.0))
    return val.withColumn("chance", mass(lambda a: a["k"] == C(label)) / mass(lambda a: F.lit(True))).drop("classes", "_at", "_top")


def model_gate(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per fold: the model's log loss on validation rows, that of validation's own class shares, and their ratio."""
    rows = known(rows, features, label)
    loss = log_loss(chances(rows, features, label), FOLD, C("chance")).withColumnRenamed("n", "n_val")
    prior = prior_entropy(rows.where("part = 'val'"), FOLD, label).drop("n")
    return loss.join(prior, FOLD).withColumn("ratio", safe_div(C("log_loss"), C("prior")))


def importance(rows: DataFrame, features: list[str], label: str = "label", top: int = 20) -> DataFrame:
    """The `top` features of each symbol by the share of their training variance that lies between classes, averaged over folds."""
    train = known(rows, features, label).where("part = 'train'")
    long = train.select(*FOLD, label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), C(f).cast("double").alias("x")) for f in features])).alias("_f")).select(*FOLD, label, "_f.*")
    parts = long.groupBy(*FOLD, "feature", label).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy(*FOLD, "feature")
    parts = parts.withColumn("_mean", F.sum(C("n") * C("m")).over(w) / F.sum("n").over(w))
    between, within = F.sum(C("n") * (C("m") - C("_mean")) * (C("m") - C("_mean"))), F.sum(C("n") * C("v"))
    shares = parts.groupBy(*FOLD, "feature").agg(safe_div(between, between + within).alias("share")).groupBy("symbol", "feature").agg(F.avg("share").alias("gain"))
    ranks = Window.partitionBy("symbol").orderBy(C("gain").desc_nulls_last(), "feature")
    return shares.withColumn("place", F.row_number().over(ranks)).where(C("place") <= top)


def decision(summary: DataFrame, anchor: str, most: float = 0.98) -> DataFrame:
    """One row: tier a (all symbols pass), b (the anchor fails, others pass), c (all fail) or d (the anchor passes, another fails);
    a symbol passes by its ratio of means."""
    ok = F.coalesce(C("mean_ratio") <= most, F.lit(False))
    counted = summary.agg(F.count_if(ok & (C("symbol") == anchor)).alias("_anchor"), F.count_if(ok & (C("symbol") != anchor)).alias("others_passed"), F.count_if(C("symbol") != anchor).alias("others"))
    tier = F.when(C("_anchor") > 0, F.when(C("others_passed") == C("others"), "a").otherwise("d")).when(C("others_passed") > 0, "b").otherwise("c")
    return counted.select(tier.alias("tier"), (C("_anchor") > 0).cast("int").alias("anchor_passed"), "others_passed", "others")
