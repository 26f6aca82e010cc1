"""Queries of channels, of neighbours in time and of two grids of bars, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import safe_div
from tidebars.operators import as_of as A
from tidebars.operators import channels as H
from tidebars.operators import neighbours as N
from tidebars.operators import setups as U
from tidebars.operators.levels import PIVOTS
from tidebars.plans.matrix import finished
from tidebars.plans.oracles import atr, ewm, merged, span, walk
from tidebars.plans.sql import EVENT_BARS
from tidebars.plans.studies import SO_FAR, lag, roll
from tidebars.plans.zone_studies import pivot_sql
from tidebars.sources import bars as B

C = F.col
FEATURES = ["place_20", "score_20", "move_5", "ratio_20", "reach"]


def study_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(H.channels(B.event_bars(spark, sf_dir)), ["place", "low", "high", "strength"], 5)


def featured(bars: DataFrame) -> DataFrame:
    c, top, bottom = C("close"), R.highest("high", 20), R.lowest("low", 20)
    df = bars.withColumns({
        "place_20": safe_div(c - bottom, top - bottom), "score_20": safe_div(c - R.mean("close", 20), R.deviation("close", 20)), "move_5": safe_div(R.change("close", 5), R.prev("close", 5)),
        "ratio_20": safe_div(C("volume"), R.mean("volume", 20)), "reach": safe_div(C("high") - C("low"), c), "label": F.signum(R.prev("close", 4) - c),
    })
    return df.withColumns({f: F.round(f, 9) for f in FEATURES})


def study_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of bars alike; a bar's label is -1 if it closed above the one four before, 1 if below."""
    return finished(N.predicted(featured(B.event_bars(spark, sf_dir)), FEATURES, "label"), ["votes", "neighbours"])


def study_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars against the half hour closed before."""
    made = A.triggers(B.event_bars(spark, sf_dir, 300), B.event_bars(spark, sf_dir), 1800)
    return finished(made, ["bias", "support", "resistance", "swept", "confirmed", "entry"], 5)


def study_zone_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.zone_volume(B.event_bars(spark, sf_dir), B.event_bars(spark, sf_dir, 300), 1800)
    return finished(made, ["zone_top", "zone_bottom", "finer_volume", "finer_bars", "own_volume"], 5)


def study_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars at their means and pivots, with the hour before."""
    return finished(U.setups(B.event_bars(spark, sf_dir, 300)), U.COLUMNS, 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (study_channels, study_neighbours, study_triggers, study_zone_volume, study_setups)}


def channels_sql(n: int = 10, back: int = 290, span: int = 300) -> str:
    b = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"
    s = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW)"
    step = "CASE WHEN x[1] <= a[2] THEN CASE WHEN a[2] - x[1] <= width THEN [least(a[1], x[1]), a[2], a[3] + 1] ELSE a END ELSE CASE WHEN x[1] - a[1] <= width THEN [a[1], greatest(a[2], x[1]), a[3] + 1] ELSE a END END"
    return (
        f"WITH RECURSIVE b0 AS ({EVENT_BARS}), b1 AS (SELECT *, coalesce({pivot_sql('high', 'max', n)}, {pivot_sql('low', 'min', n)}) AS p, CASE WHEN count(high) OVER {s} = {span} THEN (max(high) OVER {s} - min(low) OVER {s}) * 0.05::DOUBLE END AS width FROM b0), "
        f"b2 AS (SELECT *, list_reverse(list(p) FILTER (p IS NOT NULL) OVER {b}) AS ps, list(high) OVER {b} AS hs, list(low) OVER {b} AS ls FROM b1), ev AS (SELECT symbol, ts, ps, hs, ls, width FROM b2 WHERE p IS NOT NULL AND width IS NOT NULL), "
        f"c0 AS (SELECT *, list_transform(ps, lambda q: list_reduce(list_transform(ps, lambda v: [v, 0.0::DOUBLE, 0.0::DOUBLE]), lambda a, x: {step}, [q, q, 0.0::DOUBLE])) AS cs FROM ev), "
        "c1 AS (SELECT symbol, ts, list_transform(cs, lambda c: [20 * c[3] + len(list_filter(list_zip(hs, ls), lambda z: (z[1] <= c[2] AND z[1] >= c[1]) OR (z[2] <= c[2] AND z[2] >= c[1]))), c[1], c[2]]) AS cs FROM c0), "
        "se AS (SELECT symbol, ts, 0 AS place, cs AS remain, NULL::DOUBLE[] AS took FROM c1 UNION ALL "
        "SELECT symbol, ts, place + 1, list_transform(remain, lambda c: CASE WHEN (c[3] <= best[3] AND c[3] >= best[2]) OR (c[2] <= best[3] AND c[2] >= best[2]) THEN [-1.0::DOUBLE, c[2], c[3]] ELSE c END), best "
        "FROM (SELECT *, remain[list_position(list_transform(remain, lambda c: c[1]), list_max(list_transform(remain, lambda c: c[1])))] AS best FROM se WHERE place < 10) WHERE best[1] >= 20) "
        "SELECT symbol, ts, place::INT AS place, round(took[2], 5) + 0.0 AS low, round(took[3], 5) + 0.0 AS high, took[1]::INT AS strength FROM se WHERE place > 0"
    )


def neighbours_sql(k: int = 8, spacing: int = 4, back: int = 2000) -> str:
    made = (
        f"round((close - ({roll('min', 'low', 20)})) / nullif(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}), 0), 9) AS place_20, round((close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_pop', 'close', 20)}, 0), 9) AS score_20, "
        f"round((close - {lag('close', 5)}) / nullif({lag('close', 5)}, 0), 9) AS move_5, round(volume / nullif({roll('avg', 'volume', 20)}, 0), 9) AS ratio_20, round((high - low) / nullif(close, 0), 9) AS reach, sign({lag('close', 4)} - close) AS label"
    )
    far = " + ".join(f"round(ln(1 + abs(a.{f} - b.{f})), 9)" for f in FEATURES)
    known = lambda t: " AND ".join(f"{t}.{f} IS NOT NULL" for f in FEATURES)
    mark = round(k * 3 / 4)
    push = f"CASE WHEN x[1] >= s[1] THEN CASE WHEN len(s) + 1 > {2 * k} THEN [(s[2:] || x)[{2 * mark + 1}]] || (s[2:] || x)[3:] ELSE [x[1]] || s[2:] || x END ELSE s END"
    return (
        f"WITH b0 AS ({EVENT_BARS}), b1 AS MATERIALIZED (SELECT symbol, ts, rn, {made} FROM b0), "
        f"d AS (SELECT a.symbol, a.ts, list([round({far}, 9), b.label::DOUBLE] ORDER BY b.rn) AS xs FROM b1 a JOIN b1 b ON b.symbol = a.symbol AND b.rn < a.rn AND b.rn >= a.rn - {back} WHERE {known('a')} AND {known('b')} AND b.label IS NOT NULL AND b.rn % {spacing} <> 0 GROUP BY 1, 2), "
        f"h AS (SELECT symbol, ts, list_reduce(xs, lambda s, x: {push}, [-1.0::DOUBLE]) AS s FROM d) "
        f"SELECT b1.symbol, b1.ts, CASE WHEN len(s) > 1 THEN list_sum(list_transform(range(1, len(s) // 2 + 1), lambda i: s[2 * i + 1])) END + 0.0 AS votes, coalesce(len(s) // 2, 0)::INT AS neighbours FROM b1 LEFT JOIN h ON h.symbol = b1.symbol AND h.ts = b1.ts"
    )


FINE = EVENT_BARS.replace("30 minutes", "5 minutes")


def triggers_sql() -> str:
    last = lambda x: f"last_value({x} IGNORE NULLS) OVER {SO_FAR}"
    return (
        f"WITH b0 AS ({EVENT_BARS}), c1 AS (SELECT *, (close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_pop', 'close', 20)}, 0) AS score, {pivot_sql('low', 'min', 2)} AS pl, {pivot_sql('high', 'max', 2)} AS ph FROM b0), "
        f"c2 AS (SELECT symbol, ts + INTERVAL 30 MINUTE AS known, CASE WHEN score >= 0.5 THEN 1 WHEN score <= -0.5 THEN -1 ELSE 0 END AS bias, {last('pl')} AS support, {last('ph')} AS resistance FROM c1), "
        f"f0 AS ({FINE}), f1 AS (SELECT f0.*, bias, support, resistance FROM f0 ASOF LEFT JOIN c2 ON c2.symbol = f0.symbol AND c2.known <= f0.ts), "
        f"f2 AS (SELECT *, CASE WHEN low < support AND close > support THEN 1 WHEN high > resistance AND close < resistance THEN -1 ELSE 0 END AS swept, coalesce(volume > 1.5 * ({roll('avg', 'volume', 20)}), false) AS loud, (close - open) / nullif(high - low, 0) AS along FROM f1), "
        "f3 AS (SELECT *, swept <> 0 AND (loud OR coalesce(along * swept > 0.5, false)) AS confirmed FROM f2) "
        "SELECT symbol, ts, bias, round(support, 5) AS support, round(resistance, 5) AS resistance, swept, confirmed::INT AS confirmed, CASE WHEN confirmed AND swept = bias THEN swept ELSE 0 END AS entry FROM f3"
    )


def zone_volume_sql() -> str:
    zone = f"last_value(CASE WHEN ph IS NOT NULL THEN {{'top': ph, 'bottom': body}} END IGNORE NULLS) OVER {SO_FAR}"
    over = "low < zone_top AND high > zone_bottom"
    return (
        f"WITH b0 AS ({EVENT_BARS}), c1 AS (SELECT *, {pivot_sql('high', 'max', 2)} AS ph, {lag('greatest(open, close)', 2)} AS body FROM b0), c2 AS (SELECT *, {zone} AS z FROM c1), c3 AS (SELECT *, z.top AS zone_top, z.bottom AS zone_bottom FROM c2), f0 AS ({FINE}), "
        f"v AS (SELECT c.symbol, c.ts, sum(f.volume) AS volume, count(*) AS n FROM c3 c JOIN f0 f ON f.symbol = c.symbol AND time_bucket(INTERVAL '30 minutes', f.ts) = c.ts WHERE f.low < zone_top AND f.high > zone_bottom GROUP BY 1, 2) "
        f"SELECT c.symbol, c.ts, round(zone_top, 5) AS zone_top, round(zone_bottom, 5) AS zone_bottom, CASE WHEN zone_top IS NOT NULL THEN round(coalesce(v.volume, 0), 5) + 0.0 END AS finer_volume, CASE WHEN zone_top IS NOT NULL THEN coalesce(n, 0)::INT END AS finer_bars, "
        f"CASE WHEN zone_top IS NOT NULL THEN CASE WHEN {over} THEN round(c.volume, 5) ELSE 0.0 END END AS own_volume FROM c3 c LEFT JOIN v ON v.symbol = c.symbol AND v.ts = c.ts"
    )


def setups_sql() -> str:
    hours = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({FINE}) GROUP BY 1, 2)"
    mean = lambda name, n: ewm(name, "close", span(n), "close")
    fine = walk([merged(mean("e21", 21), mean("e50", 50), atr("a", 14))], {"e21": "e21", "e50": "e50", "a": "a"}, FINE)
    coarse = walk([merged(mean("c50", 50), mean("c200", 200), atr("a", 14))], {"c50": "c50", "c200": "c200", "a": "a"}, hours)
    since = lambda cond: f"rn - last_value(CASE WHEN {cond} THEN rn END IGNORE NULLS) OVER {SO_FAR}"
    near = lambda x: f"coalesce(abs(close - {x}) <= 0.3 * a, false)"
    levels = ", ".join(f"(h + l + c) / 3 + {share!r} * (h - l) AS p{i}" for i, share in enumerate(PIVOTS.values()))
    every = [f"p{i}" for i in range(len(PIVOTS))]
    body, up, down = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"
    pin = f"(({down} > 2 * {body} AND {up} < {body})::INT - ({up} > 2 * {body} AND {down} < {body})::INT)"
    engulf = "(coalesce(close > open AND pc < po AND close >= po AND open <= pc, false)::INT - coalesce(close < open AND pc > po AND close <= po AND open >= pc, false)::INT)"
    top, bottom = roll("max", "close", 20), roll("min", "close", 20)
    told = {f"bars_since_ema{n}_touch_5m": since(f"t{n}") for n in (21, 50)}
    told |= {f"ema{n}_bounce_5bar_5m": f"last_value(CASE WHEN u{n} THEN (close - e{n}) / nullif(a, 0) END IGNORE NULLS) OVER {SO_FAR}" for n in (21, 50)}
    told |= {"bars_since_ema50_touch_1h": "s50", "bars_since_ema200_touch_1h": "s200", "mtf_trend_alignment": f"coalesce(sign(e50 - {lag('e50', 12)}), 0) * coalesce(sign(slope), 0)"}
    told |= {f"ema{n}_pivot_confluence": f"least({', '.join(f'abs({p} - e{n})' for p in every)}) / nullif(a, 0)" for n in (21, 50)}
    told |= {f"{k}_at_{w}": f"CASE WHEN {cond} THEN {x} ELSE 0 END" for k, x in (("pin_bar", pin), ("engulf", engulf)) for w, cond in (("ema", "t21 OR t50"), ("pivot", " OR ".join(near(p) for p in every)))}
    told |= {"pullback_depth_pct": f"(({top}) - close) / nullif(({top}) - ({bottom}), 0)", "dist_from_range_high_20_pct": f"(({top}) - close) / nullif(close, 0) * 100", "dist_from_range_low_20_pct": f"(close - ({bottom})) / nullif(close, 0) * 100"}
    whole = {n for n in told if n.startswith("bars_since")}
    cols = ", ".join(f"({told[n]})::INT AS {n}" if n in whole else f"round(({told[n]})::DOUBLE, 5) + 0.0 AS {n}" for n in U.COLUMNS)
    return (
        f"WITH f AS ({fine} SELECT * FROM b1), h0 AS ({coarse} SELECT * FROM b1), h1 AS (SELECT *, {since(near('c50'))} AS s50, {since(near('c200'))} AS s200, c50 - {lag('c50', 4)} AS slope FROM h0), "
        f"h2 AS (SELECT symbol, ts, {', '.join(f'{lag(x)} AS {x}' for x in ('s50', 's200', 'slope'))} FROM h1), "
        "d0 AS (SELECT symbol, ts::DATE AS day, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM f GROUP BY 1, 2), d1 AS (SELECT symbol, day, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM d0 WINDOW w AS (PARTITION BY symbol ORDER BY day)), "
        f"d2 AS (SELECT symbol, day, {levels} FROM d1), j0 AS (SELECT f.*, s50, s200, slope, {', '.join(every)}, {lag('f.close').replace('symbol', 'f.symbol').replace('BY ts', 'BY f.ts')} AS pc, {lag('f.open').replace('symbol', 'f.symbol').replace('BY ts', 'BY f.ts')} AS po "
        "FROM f LEFT JOIN h2 ON h2.symbol = f.symbol AND h2.ts = time_bucket(INTERVAL '1 hour', f.ts) LEFT JOIN d2 ON d2.symbol = f.symbol AND d2.day = f.ts::DATE), "
        f"j1 AS (SELECT *, {near('e21')} AS t21, {near('e50')} AS t50 FROM j0), j2 AS (SELECT *, {', '.join(f'coalesce({lag(f"t{n}", 5)}, false) AS u{n}' for n in (21, 50))} FROM j1) SELECT symbol, ts, {cols} FROM j2"
    )


def oracle_sql() -> dict[str, str]:
    return {"study_channels": channels_sql(), "study_neighbours": neighbours_sql(), "study_triggers": triggers_sql(), "study_zone_volume": zone_volume_sql(), "study_setups": setups_sql()}
