"""Queries of sizes, health, kill switches and bootstrap intervals, and of tags and missing values, with the SQL for each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.operators import evaluation, labels, oscillators, risk
from tidebars.plans.matrix import catalog, finished
from tidebars.plans.sql import BANDS, BAND_COLUMNS, EVENT_BARS, TAKEN, barriers, shown, steps
from tidebars.sources import bars as B

C = F.col
#: Days of the rolling frames, resamples, and true ranges to the stop.
DAYS = 7
DRAWS = 10_000
REACH = 2.4
BAND_NAMES = ["bb_basis", "bb_upper", "bb_lower", "kc_upper", "kc_lower", "bb_width_pct", "bb_position"]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(n, 5) + F.lit(0.0)).alias(n) if t == "double" else C(n) for n, t in df.dtypes])


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades entered where the close passes above its mean of 20 bars, with their planned stop in percent."""
    df = oscillators.squeeze(B.event_bars(spark, sf_dir))
    df = labels.triple_barrier(df, atr="_tr20", quiet_pct=0.5).withColumn("planned", REACH * C("_tr20") / C("close") * 100)
    return evaluation.trades(df, R.crosses_above(C("close"), C("bb_basis")), keep=("planned",))


def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(risk.position_size(oscillators.squeeze(B.event_bars(spark, sf_dir)), REACH * C("_tr20")), ["stop_share", "size", "notional", "capped"], 5)


def trade_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(risk.health(made(spark, sf_dir), DAYS), ["hit_rate", "net", "change", "hit_band", "pnl_band"], 5)


def kill_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.kill_switches(made(spark, sf_dir), DAYS).withColumn("day", C("day").cast("timestamp_ntz")))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.bootstrap(made(spark, sf_dir), DRAWS))


def feature_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by how stable they are, with those whose family is seen in the bars of each symbol: the bars, and the values due."""
    tags = spark.createDataFrame(catalog(), "feature string, family string, stability string").groupBy("stability").agg(F.count("*").alias("features"))  # two rows
    bars = B.event_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"))
    return bars.join(F.broadcast(tags), F.lit(True)).select("symbol", "stability", "features", "bars", (C("features") * C("bars")).alias("due"))


def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars without a value, by column, and their percentage."""
    counts = oscillators.squeeze(B.event_bars(spark, sf_dir)).agg(F.count("*").alias("_n"), *[F.count_if(C(n).isNull()).alias(n) for n in BAND_NAMES])
    long = counts.unpivot("_n", BAND_NAMES, "feature", "missing")
    return rounded(long.select("feature", "missing", F.try_divide(C("missing") * 100.0, C("_n")).alias("percent")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (position_sizes, trade_health, kill_switches, bootstrap_intervals, feature_tags, missing_values)}


# --- SQL

TRADES = f"{barriers(EVENT_BARS)}, {TAKEN}, mt AS (SELECT tr.symbol, tr.ts, tr.pnl, {REACH} * b3.tr20 / b3.close * 100 AS planned FROM tr JOIN b3 ON b3.symbol = tr.symbol AND b3.rn = tr.rn)"
HEALTH = (
    f"hl AS (SELECT *, avg((pnl > 0)::INT) OVER v AS hit_rate, sum(pnl) OVER v AS net, avg((pnl > 0)::INT) OVER u AS usual, count(*) OVER v * avg(pnl) OVER u AS due FROM mt WINDOW v AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL {DAYS} DAYS PRECEDING AND CURRENT ROW), u AS (PARTITION BY symbol)), "
    "hc AS (SELECT *, (net - due) / nullif(abs(due), 0) AS change FROM hl), hh AS (SELECT *, CASE WHEN hit_rate < 0.5 THEN 2 WHEN hit_rate < usual - 0.05 THEN 1 ELSE 0 END AS hit_band, CASE WHEN change <= -0.4 THEN 2 WHEN change <= -0.2 THEN 1 ELSE 0 END AS pnl_band FROM hc)"
)


def told(*names: str) -> str:
    return ", ".join(f"round({n}, 5) + 0.0 AS {n}" for n in names)


KILL = (
    "d0 AS (SELECT symbol, ts::DATE AS day, sum(pnl) AS day_pnl, count(*) FILTER (pnl < -2 * planned) AS slips, arg_max(greatest(hit_band, pnl_band), ts) AS band FROM hh GROUP BY 1, 2), "
    "d1 AS (SELECT *, sum(day_pnl) OVER (PARTITION BY symbol ORDER BY day) AS total, row_number() OVER (PARTITION BY symbol ORDER BY day) AS n FROM d0), "
    "d2 AS (SELECT *, max(greatest(total, total - day_pnl)) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) - total AS week_fall, (n - coalesce(max(CASE WHEN band < 2 THEN n END) OVER (PARTITION BY symbol ORDER BY day), 0))::INT AS red_run FROM d1)"
)


def powers(x: str, terms: tuple[float, ...]) -> str:
    out = "0.0::DOUBLE"
    for c in reversed(terms):
        out = f"({out} * ({x}) + {c!r}::DOUBLE)"
    return out


def normal_sql(x: str) -> str:
    t = f"(1 / (1 + {risk.CDF_STEP} * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)!r} * {t} * {powers(t, risk.CDF)})"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def metrics_sql(table: str, keys: str) -> str:
    values = {"sharpe": "s / n / nullif(sqrt(greatest(q / n - s / n * (s / n), 0)), 0)", "hit_rate": "w / n", "net": "s"}
    return " UNION ALL ".join(f"SELECT {keys}, '{k}' AS metric, round(({x})::DOUBLE, 9) AS value FROM {table} WHERE ({x}) IS NOT NULL" for k, x in values.items())


def bootstrap_sql() -> str:
    sums = "count(*)::DOUBLE AS n, sum(pnl) AS s, sum(pnl * pnl) AS q, sum(win) AS w"
    far = f"(tt - {powers('tt', risk.ABOVE)} / {powers('tt', risk.BELOW)})"
    rank = lambda z: f"greatest(least(ceil(({normal_sql(f'(bias + (bias + {z}) / (1 - bend * (bias + {z})))')}) * n), n), 1)"
    z = 1.959963984540054
    return (
        f"{TRADES}, t0 AS (SELECT symbol, pnl, (pnl > 0)::INT::DOUBLE AS win, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM mt), "
        f"pl AS (SELECT symbol, b, ('0x' || substr(md5(b || ':' || i), 1, 8))::BIGINT % n + 1 AS i FROM t0, range(1, {DRAWS + 1}) r(b)), ds AS (SELECT pl.symbol, b, {sums} FROM pl JOIN t0 ON t0.symbol = pl.symbol AND t0.i = pl.i GROUP BY 1, 2), dr AS ({metrics_sql('ds', 'symbol, b')}), "
        f"wh AS (SELECT symbol, {sums} FROM t0 GROUP BY 1), lo AS (SELECT t0.symbol, wh.n - 1 AS n, s - pnl AS s, q - pnl * pnl AS q, w - win AS w FROM t0 JOIN wh ON wh.symbol = t0.symbol WHERE wh.n > 1), lv AS ({metrics_sql('lo', 'symbol')}), "
        "ld AS (SELECT *, avg(value) OVER (PARTITION BY symbol, metric) - value AS d FROM lv), be AS (SELECT symbol, metric, coalesce(sum(d ** 3) / nullif(6 * sum(d * d) ** 1.5, 0), 0) AS bend FROM ld GROUP BY 1, 2), "
        f"po AS (SELECT p.symbol, p.metric, p.value AS point, bend FROM ({metrics_sql('wh', 'symbol')}) p JOIN be ON be.symbol = p.symbol AND be.metric = p.metric), "
        "al AS (SELECT dr.*, point, bend, count(*) OVER g AS n, count(*) FILTER (value < point) OVER g + count(*) FILTER (value = point) OVER g / 2 AS below, row_number() OVER (PARTITION BY dr.symbol, dr.metric ORDER BY value, b) AS place FROM dr JOIN po ON po.symbol = dr.symbol AND po.metric = dr.metric WINDOW g AS (PARTITION BY dr.symbol, dr.metric)), "
        "sh AS (SELECT *, least(greatest(below / n, 0.5 / n), 1 - 0.5 / n) AS share FROM al), ft AS (SELECT *, sqrt(-2 * ln(least(share, 1 - share))) AS tt FROM sh), b8 AS (SELECT *, CASE WHEN share < 0.5 THEN -{0} ELSE {0} END AS x FROM ft), ".replace("{0}", far)
        + f"b9 AS (SELECT *, x - (({normal_sql('x')}) - share) / (exp(-x * x / 2) / {math.sqrt(2 * math.pi)!r}) AS bias FROM b8), br AS (SELECT *, {rank(-z)} AS first, {rank(z)} AS last FROM b9) "
        "SELECT symbol, metric, round(max(point), 5) + 0.0 AS point, round(max(CASE WHEN place = first THEN value END), 5) + 0.0 AS lower, round(max(CASE WHEN place = last THEN value END), 5) + 0.0 AS upper, count(*) AS draws FROM br GROUP BY 1, 2"
    )


def oracle_sql() -> dict[str, str]:
    sizes = {"stop_share": "stop / nullif(close, 0)", "size": "size", "notional": "size * close", "capped": "coalesce(free > most, false)"}
    missing = " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER (({BAND_COLUMNS[n]}) IS NULL) AS missing, round(100.0 * count(*) FILTER (({BAND_COLUMNS[n]}) IS NULL) / count(*), 5) AS percent FROM b2" for n in BAND_NAMES)
    tags = f"SELECT symbol, stability, features, count(*) AS bars, features * count(*) AS due FROM ({EVENT_BARS}), (VALUES ('dynamic', 180::BIGINT), ('static', 70::BIGINT)) t(stability, features) GROUP BY 1, 2, 3"
    return {
        "feature_tags": tags,
        "position_sizes": steps(EVENT_BARS, *BANDS[:2], f"CASE WHEN tr20 > 0 THEN {REACH} * tr20 END AS stop, 1000.0 / nullif(close, 0) AS most", "100.0 / nullif(stop, 0) AS free", "CASE WHEN free IS NOT NULL THEN least(free, most) END AS size") + shown(sizes, 5, ("capped",), 5),
        "trade_health": f"{TRADES}, {HEALTH} SELECT symbol, ts, {told('hit_rate', 'net', 'change')}, hit_band, pnl_band FROM hh",
        "kill_switches": f"{TRADES}, {HEALTH}, {KILL} SELECT symbol, day::TIMESTAMP AS day, {told('day_pnl', 'week_fall')}, slips, red_run, coalesce(week_fall > 8, false)::INT AS halt_week, (day_pnl < -4)::INT AS halt_day, (slips > 0)::INT AS halt_slip, (red_run >= 3)::INT AS halt_red FROM d2",
        "bootstrap_intervals": bootstrap_sql(), "missing_values": steps(EVENT_BARS, *BANDS[:2]) + f" {missing}",
    }
