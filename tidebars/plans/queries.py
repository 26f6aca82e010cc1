"""Queries of the bar engine over the driver's tables, by name, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.operators import evaluation, labels, oscillators
from tidebars.operators import recurrence as S
from tidebars.plans import feedback_studies, gates, level_studies, oracles, risks, studies, tick_studies, zone_studies
from tidebars.plans.matrix import FAMILIES, build, catalog, finished, matrix
from tidebars.plans.sql import OHLCV, RECURSIVE, plain_sql
from tidebars.sources import bars as B

Query = Callable[[SparkSession, str], DataFrame]
C = F.col


def naive(df: DataFrame, *names: str) -> DataFrame:
    """Times without a zone, as the SQL has them."""
    return df.withColumns({n: C(n).cast("timestamp_ntz") for n in names})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(n, digits) + F.lit(0.0)).alias(n) if t == "double" else C(n) for n, t in df.dtypes])


# --- bars


def bars_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(B.event_bars(spark, sf_dir), OHLCV)


def bars_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(B.order_bars(spark, sf_dir), OHLCV, 4)


def bars_daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(B.line_bars(spark, sf_dir), OHLCV, 4)


def resample_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(B.resample(B.event_bars(spark, sf_dir), 14400), OHLCV)


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol between two times, both included."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    ts = C("ts").cast("timestamp_ntz")
    lower, upper = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-10 00:00:00"))
    return rounded(naive(events.where((C("event_type") == "purchase") & (ts >= lower) & (ts <= upper)), "ts"))


def latest_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(B.event_bars(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.count("*").alias("bars")), "last_ts")


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer and day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rounded(naive(B.keep_last(orders, ["o_custkey", "o_orderdate"], [C("o_orderkey")]), "o_orderdate"))


# --- features


def family(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(build(B.event_bars(spark, sf_dir), [name]), FAMILIES[name])

    run.__name__ = f"features_{name}"
    return run


def exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means, RSI, MACD and true range means."""
    scans = [S.ema(n, k) for n, k in RECURSIVE.items()] + [S.Scan(("rsi_14",), S.Rsi), S.Scan(("macd_line", "macd_signal"), S.Macd), S.Scan(("atr_14",), S.Atr)]
    return finished(S.scan(B.event_bars(spark, sf_dir), scans), [*RECURSIVE, "rsi_14", "macd_line", "macd_signal", "atr_14"])


def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(oscillators.squeeze(B.event_bars(spark, sf_dir)), ["bb_basis", "bb_upper", "bb_lower", "kc_upper", "kc_lower", "bb_width_pct", "bb_position", "squeeze_state"])


def window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean, deviation, skewness, kurtosis, regression value, rank and lagged correlation."""
    df = B.event_bars(spark, sf_dir).withColumn("_p", R.prev("close"))
    df = df.withColumns({
        "mean_10": R.mean("close", 10), "sd_10": R.deviation("close", 10), "skew_20": R.skew("close", 20), "kurt_20": R.kurtosis("close", 20), "line_20": R.regression("close", 20, "rn"),
        "rank_20": R.percentile("close", 20), "corr_20": R.correlation("close", "_p", 20),
    })
    return finished(df, ["mean_10", "sd_10", "skew_20", "kurt_20", "line_20", "rank_20", "corr_20"], 5)


def event_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars since an event, lengths of runs, values carried forward, crosses and confirmed pivots."""
    df = B.event_bars(spark, sf_dir).withColumn("_m", R.mean("close", 10))
    over = C("close") > C("_m")
    df = df.withColumns({"_h": R.pivot_high("high"), "_l": R.pivot_low("low"), "crossed": R.crosses_above(C("close"), C("_m")).cast("int")})
    df = df.withColumns({"since_cross": R.bars_since(C("crossed") == 1), "run_above": R.run_length(over), "last_high": R.carried(C("_h")), "last_low": R.carried(C("_l")), "high_before": R.previous(C("_h"))})
    return finished(df, ["crossed", "since_cross", "run_above", "last_high", "last_low", "high_before"])


def machine(name: str, outputs: tuple[str, ...], make: Callable[[], S.Machine]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(S.scan(B.event_bars(spark, sf_dir), [S.Scan(outputs, make)]), list(outputs))

    run.__name__ = name
    return run


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(matrix(B.event_bars(spark, sf_dir)), [c for names in FAMILIES.values() for c in names])


def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of the matrix with its family and stability, how many features are as stable, and the bars that have it."""
    made = matrix(B.event_bars(spark, sf_dir))
    names = spark.createDataFrame(catalog(), "feature string, family string, stability string").withColumn("alike", F.count("*").over(Window.partitionBy("stability")))
    counts = made.agg(F.count("*").alias("_bars"), *[F.count(c).alias(c) for c, _, _ in catalog()])
    known = counts.unpivot("_bars", [c for c, _, _ in catalog()], "feature", "known").withColumnRenamed("_bars", "bars")
    return names.join(known, "feature").select("feature", "family", "stability", "alike", "bars", "known")


# --- labels and evaluation


def labelled(bars: DataFrame) -> DataFrame:
    return labels.triple_barrier(oscillators.squeeze(bars), atr="_tr20", quiet_pct=0.5)


def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(labelled(B.event_bars(spark, sf_dir)), ["label", "holding_bars", "exit_price", "pnl_pct"])


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.class_shares(labelled(B.event_bars(spark, sf_dir)), ["symbol"]))


def prior_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.prior_entropy(spark.read.parquet(f"{sf_dir}/labels.parquet"), ["toxic"], "quality"))


def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(labels.folds(B.order_bars(spark, sf_dir)), "train_start", "train_end", "val_end")


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each fold's two parts after purge and embargo."""
    bars = B.order_bars(spark, sf_dir)
    return naive(labels.fold_rows(bars, labels.folds(bars)).groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "first_ts", "last_ts")


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = labelled(B.order_bars(spark, sf_dir))
    return labels.prior_gate(labels.fold_rows(bars, labels.folds(bars)))


def prior_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate(spark, sf_dir))


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.gate_summary(gate(spark, sf_dir)))


def volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 500 units, by return flag."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(C("l_returnflag").alias("symbol"), C("l_extendedprice").alias("price"), "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber")
    return rounded(evaluation.amount_bars(lines, "l_quantity", 500.0, ["l_shipdate", "l_orderkey", "l_linenumber"]), 4)


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades entered where the close passes above its mean of 20 bars."""
    return evaluation.trades(labelled(B.event_bars(spark, sf_dir)), R.crosses_above(C("close"), C("bb_basis")))


def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(crossings(spark, sf_dir), ["holding_bars", "pnl"])


def backtest_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.measures(crossings(spark, sf_dir)), 5)


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = C("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return rounded(evaluation.stability_index(B.event_bars(spark, sf_dir), "close", later, 0.0, 200.0))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score of always giving the label's overall share, by quality."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = rows.agg(F.avg(C("toxic").cast("double")).alias("share"))  # one row
    return rounded(evaluation.brier(rows.crossJoin(F.broadcast(share)), ["quality"], C("share"), C("toxic")))


PLAIN = [
    volume_bars, backtest_trades, backtest_measures, drift, calibration,
    bars_30m, bars_daily_orders, bars_daily_lines, resample_4h, range_scan, latest_bar, keep_last, exponential, bollinger, window_statistics, event_distance, triple_barrier, label_shares, prior_entropy,
    walk_forward_folds, fold_sizes, prior_gate, gate_summary, feature_catalog, feature_matrix,
]
MACHINES = [
    machine("trail_psar", ("psar", "psar_trend"), S.Psar), machine("trail_supertrend", ("supertrend", "direction"), S.SuperTrend), machine("trail_chandelier", ("long_stop", "short_stop", "direction"), S.Chandelier),
    machine("trail_stop", ("stop", "signal"), S.TrailingStop), machine("heikin_ashi", ("ha_open", "ha_high", "ha_low", "ha_close"), S.HeikinAshi), machine("mcginley", ("mcginley",), S.McGinley),
    machine("cusum_events", ("event",), lambda: S.Cusum(50.0)), machine("kama", ("kama",), S.Kama), machine("tsi", ("tsi", "tsi_signal"), S.Tsi),
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (*PLAIN, *map(family, FAMILIES), *MACHINES)} | studies.queries() | zone_studies.queries() | tick_studies.queries() | feedback_studies.queries() | level_studies.queries() | gates.queries() | risks.queries()


def oracle_sql() -> dict[str, str]:
    return plain_sql() | oracles.oracle_sql() | studies.oracle_sql() | zone_studies.oracle_sql() | tick_studies.oracle_sql() | feedback_studies.oracle_sql() | level_studies.oracle_sql() | gates.oracle_sql() | risks.oracle_sql()
