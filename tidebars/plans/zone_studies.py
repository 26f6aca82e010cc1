"""Queries of zones and levels that live until they are met, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebars.operators import zones as Z
from tidebars.plans.matrix import finished
from tidebars.plans.sql import EVENT_BARS
from tidebars.plans.studies import SO_FAR, lag, roll
from tidebars.sources import bars as B


def study_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(Z.zones(B.event_bars(spark, sf_dir)), ["kind", "side", "born", "origin", "bottom", "top", "met", "broken", "gone"], 5)


def study_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.event_bars(spark, sf_dir)
    return finished(Z.lives(bars, [Z.pools(bars)]), ["side", "born", "origin", "bottom", "top", "met", "broken"], 5)


def study_trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(Z.trend_lines(B.event_bars(spark, sf_dir)), ["side", "born", "origin", "newer", "slope", "level", "broken"], 9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (study_zones, study_trend_lines, study_pools)}


# --- SQL


def mean_range(n: int, name: str = "walk") -> str:
    """Wilder's mean of true ranges, by recursion over b0; NULL before the n-th bar."""
    tr = "greatest(b.high - b.low, abs(b.high - r.pc), abs(b.low - r.pc))"
    return (
        f"{name} AS (SELECT symbol, rn, high - low AS mr, close AS pc FROM b0 WHERE rn = 1 UNION ALL "
        f"SELECT b.symbol, b.rn, {tr} / {n}.0 + r.mr * {n - 1}.0 / {n}.0, b.close FROM {name} r JOIN b0 b ON b.symbol = r.symbol AND b.rn = r.rn + 1)"
    )


def passed(after: str, cond: str) -> str:
    return f"(SELECT min(x.rn) FROM b0 x WHERE x.symbol = z.symbol AND x.rn > {after} AND ({cond}))"


def zones_sql(n: int = 10) -> str:
    last = lambda x, until="CURRENT ROW": f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND {until})"
    pivot = lambda x, agg: f"CASE WHEN count({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {2 * n} PRECEDING AND CURRENT ROW) = {2 * n + 1} AND {lag(x, n)} = {agg}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {2 * n} PRECEDING AND CURRENT ROW) THEN {lag(x, n)} END"

    def block(name: str, side: int, at: str, past: str, edge: str) -> str:
        level = f"(SELECT {'high' if side == 1 else 'low'} FROM b0 y WHERE y.symbol = b3.symbol AND y.rn = b3.{at} - {n})"
        return (
            f"{name}0 AS (SELECT symbol, {at} AS conf, rn, close, {level} AS level FROM b3 WHERE {at} IS NOT NULL), {name}1 AS (SELECT symbol, conf, min(rn) AS born FROM {name}0 WHERE rn > conf AND {past} GROUP BY ALL), "
            f"{name} AS (SELECT z.symbol, z.born, 'order' AS kind, {side} AS side, (SELECT arg_min(x.rn, {edge} || [x.rn::DOUBLE]) FROM b0 x WHERE x.symbol = z.symbol AND x.rn > z.conf - {n} AND x.rn < z.born) AS origin FROM {name}1 z)"
        )

    share = f"CASE WHEN {lag('open')} <> 0 THEN ({lag('close')} - {lag('open')}) / {lag('open')} END"
    head = [
        f"b0 AS MATERIALIZED ({EVENT_BARS})",
        mean_range(50),
        f"b1 AS (SELECT *, CASE WHEN {lag('high', n)} > ({roll('max', 'high', n)}) THEN -1 WHEN {lag('low', n)} < ({roll('min', 'low', n)}) THEN 1 END AS leg, {share} AS share, {pivot('high', 'max')} AS ph, {pivot('low', 'min')} AS pl FROM b0)",
        f"b2 AS (SELECT *, leg IS NOT NULL AND coalesce({last('leg', '1 PRECEDING')} <> leg, true) AS turns, 2.0 * sum(abs(share)) OVER {SO_FAR} / nullif(rn - 1, 0) AS least FROM b1)",
        f"b3 AS (SELECT *, {last('CASE WHEN turns AND leg = -1 THEN rn END')} AS top_at, {last('CASE WHEN turns AND leg = 1 THEN rn END')} AS bottom_at FROM b2)",
        block("ou", 1, "top_at", "close > level", "[x.low]"),
        block("od", -1, "bottom_at", "close < level", "[-x.high]"),
        "orders AS (SELECT o.*, b.low AS bottom, b.high AS top FROM (SELECT * FROM ou UNION ALL SELECT * FROM od) o JOIN b0 b ON b.symbol = o.symbol AND b.rn = o.origin)",
        f"g0 AS (SELECT *, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2, {lag('close')} AS c1 FROM b2)",
        "g1 AS (SELECT *, CASE WHEN low > h2 AND c1 > h2 AND share > least THEN 1 WHEN high < l2 AND c1 < l2 AND -share > least THEN -1 END AS side FROM g0)",
        "gaps AS (SELECT symbol, rn AS born, 'gap' AS kind, side, rn - 1 AS origin, CASE side WHEN 1 THEN h2 ELSE high END AS bottom, CASE side WHEN 1 THEN low ELSE l2 END AS top FROM g1 WHERE side IS NOT NULL)",
        "p0 AS (SELECT b.symbol, b.rn AS born, ph, pl, mr FROM b1 b JOIN walk USING (symbol, rn) WHERE rn >= 50)",
        f"p1 AS (SELECT symbol, born, 'pivot' AS kind, -1 AS side, born - {n} AS origin, ph - 0.25 * mr AS bottom, ph AS top, mr FROM p0 WHERE ph IS NOT NULL UNION ALL SELECT symbol, born, 'pivot', 1, born - {n}, pl, pl + 0.25 * mr, mr FROM p0 WHERE pl IS NOT NULL)",
        f"p2 AS (SELECT z.*, (bottom + top) / 2 AS middle, {passed('z.born - 1', 'CASE z.side WHEN 1 THEN x.close <= z.bottom ELSE x.close >= z.top END')} AS ended, row_number() OVER (PARTITION BY symbol, side ORDER BY born) AS k FROM p1 z)",
        "p3 AS (SELECT symbol, side, 0::BIGINT AS k, false AS taken, []::DOUBLE[][] AS held FROM p2 WHERE k = 1 UNION ALL "
        "SELECT r.symbol, r.side, p.k, f.free, CASE WHEN f.free THEN ([[p.middle, coalesce(p.ended, 9e15)::DOUBLE]] || r.held)[1:20] ELSE r.held END FROM p3 r JOIN p2 p ON p.symbol = r.symbol AND p.side = r.side AND p.k = r.k + 1, "
        "LATERAL (SELECT len(list_filter(r.held, lambda h: h[2] >= p.born AND abs(h[1] - p.middle) <= 2.0 * p.mr)) = 0 AS free) f)",
        "pivots AS (SELECT p2.symbol, born, kind, p2.side, origin, bottom, top FROM p2 JOIN p3 ON p3.symbol = p2.symbol AND p3.side = p2.side AND p3.k = p2.k WHERE taken)",
        f"z0 AS (SELECT z.*, {passed('z.born', 'CASE z.side WHEN 1 THEN x.low <= z.top ELSE x.high >= z.bottom END')} AS met FROM (SELECT symbol, born, kind, side, origin, bottom, top FROM orders UNION ALL SELECT * FROM gaps UNION ALL SELECT * FROM pivots) z)",
        "z1 AS (SELECT z.*, CASE kind "
        f"WHEN 'gap' THEN {passed('z.born', 'CASE z.side WHEN 1 THEN x.low < z.bottom ELSE x.high > z.top END')} "
        f"WHEN 'pivot' THEN {passed('z.born - 1', 'CASE z.side WHEN 1 THEN x.close <= z.bottom ELSE x.close >= z.top END')} "
        f"ELSE {passed('z.born - 1', 'CASE z.side WHEN 1 THEN least(x.open, x.close) < z.bottom ELSE greatest(x.open, x.close) > z.top END')} END AS broken FROM z0 z)",
        f"z2 AS (SELECT z.*, CASE WHEN kind <> 'order' THEN broken WHEN broken IS NOT NULL THEN {passed('z.broken', 'CASE z.side WHEN 1 THEN x.close > z.top ELSE x.close < z.bottom END')} END AS gone FROM z1 z)",
    ]
    return "WITH RECURSIVE " + ", ".join(head) + (
        " SELECT z.symbol, b.ts, kind, side::INT AS side, born::INT AS born, origin::INT AS origin, round(bottom, 5) + 0.0 AS bottom, round(top, 5) + 0.0 AS top, met::INT AS met, broken::INT AS broken, gone::INT AS gone "
        "FROM z2 z JOIN b0 b ON b.symbol = z.symbol AND b.rn = z.born"
    )


def span(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {2 * n} PRECEDING AND CURRENT ROW)"


def pivot_sql(x: str, agg: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {span(n)} = {2 * n + 1} AND {lag(x, n)} = {agg}({x}) OVER {span(n)} THEN {lag(x, n)} END"


def trend_lines_sql(n: int = 10, back: int = 10) -> str:
    points = " UNION ALL ".join(f"SELECT symbol, ts, rn AS born, rn - {n} AS rn, {x} AS v, {side} AS side FROM b1 WHERE {x} IS NOT NULL" for side, x in ((1, "pl"), (-1, "ph")))
    return (
        f"WITH b0 AS MATERIALIZED ({EVENT_BARS}), b1 AS (SELECT *, {pivot_sql('high', 'max', n)} AS ph, {pivot_sql('low', 'min', n)} AS pl FROM b0), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY rn) AS k FROM ({points})), "
        f"pr AS (SELECT z.symbol, z.ts, z.born, z.side, z.rn AS newer, o.rn AS origin, o.v AS start, (z.v - o.v) / (z.rn - o.rn) AS slope FROM p z JOIN p o ON o.symbol = z.symbol AND o.side = z.side AND o.k < z.k AND o.k > z.k - {back} WHERE z.side * (z.v - o.v) > 0), "
        f"q AS (SELECT z.*, {passed('z.origin', 'CASE z.side WHEN 1 THEN x.close < z.start - z.side * abs(z.start) * 1e-9 + z.slope * (x.rn - z.origin) ELSE x.close > z.start - z.side * abs(z.start) * 1e-9 + z.slope * (x.rn - z.origin) END')} AS broken FROM pr z) "
        "SELECT symbol, ts, side::INT AS side, born::INT AS born, origin::INT AS origin, newer::INT AS newer, round(slope, 9) + 0.0 AS slope, round(start + slope * (born - origin), 9) + 0.0 AS level, broken::INT AS broken "
        "FROM q WHERE broken IS NULL OR broken > born QUALIFY row_number() OVER (PARTITION BY symbol, side, born ORDER BY origin) = 1"
    )


def one_sided(x: str, agg: str, left: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {left + 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {left + 2} AND {lag(x, 1)} = {agg}({x}) OVER {w} THEN {lag(x, 1)} END"


def pools_sql(left: int = 7, share: float = 0.69, most: int = 50) -> str:
    """Recursion over pivots with the list of swings."""
    state = (
        "CASE WHEN len(r.zz) = 0 OR r.zz[1][1] <> e.side THEN ([[e.side, e.rn - 1, e.price]] || r.zz)[1:" + str(most) + "] WHEN e.side * (e.price - r.zz[1][3]) > 0 THEN [[e.side, e.rn - 1, e.price]] || r.zz[2:] ELSE r.zz END"
    )
    own = "list_filter(zz, lambda s: s[1] = side)"
    stop = f"list_position(list_transform({own}, lambda s: side * (s[3] - price) > wide), true)"
    near = f"list_filter(CASE WHEN {stop} > 0 THEN ({own})[1:{stop} - 1] ELSE {own} END, lambda s: abs(s[3] - price) < wide)"
    return (
        f"WITH RECURSIVE b0 AS MATERIALIZED ({EVENT_BARS}), {mean_range(10)}, b1 AS (SELECT b0.*, CASE WHEN rn >= 10 THEN mr * {share!r}::DOUBLE END AS wide, {one_sided('high', 'max', left)} AS ph, {one_sided('low', 'min', left)} AS pl FROM b0 JOIN walk USING (symbol, rn)), "
        "e AS MATERIALIZED (SELECT symbol, ts, rn, wide, CASE WHEN ph IS NOT NULL THEN 1.0 ELSE -1.0 END::DOUBLE AS side, coalesce(ph, pl)::DOUBLE AS price, row_number() OVER (PARTITION BY symbol ORDER BY rn) AS k FROM b1 WHERE ph IS NOT NULL OR pl IS NOT NULL), "
        "r AS (SELECT symbol, 0 AS k, []::DOUBLE[][] AS zz, NULL::DOUBLE AS tu, NULL::DOUBLE AS td, NULL::DOUBLE AS first, NULL::DOUBLE AS low, NULL::DOUBLE AS high, false AS told FROM e WHERE k = 1 UNION ALL "
        "SELECT symbol, k, zz, CASE WHEN told AND side > 0 THEN ns[-1][2] ELSE tu END, CASE WHEN told AND side < 0 THEN ns[-1][2] ELSE td END, ns[-1][2], (list_min(ps) + list_max(ps)) / 2 - wide, (list_min(ps) + list_max(ps)) / 2 + wide, told FROM ("
        "SELECT *, list_transform(ns, lambda s: s[3]) AS ps, coalesce(len(ns) >= 3 AND ns[-1][2] IS DISTINCT FROM CASE WHEN side > 0 THEN tu ELSE td END, false) AS told FROM ("
        f"SELECT *, CASE WHEN wide IS NOT NULL THEN {near} END AS ns FROM (SELECT e.symbol, e.k::INT AS k, {state} AS zz, tu, td, e.side, e.price, e.wide FROM r JOIN e ON e.symbol = r.symbol AND e.k = r.k + 1)))), "
        "z AS (SELECT r.symbol, e.ts, e.rn AS born, -e.side AS side, first AS origin, low AS bottom, high AS top FROM r JOIN e ON e.symbol = r.symbol AND e.k = r.k WHERE told) "
        f"SELECT symbol, ts, side::INT AS side, born::INT AS born, origin::INT AS origin, round(bottom, 5) + 0.0 AS bottom, round(top, 5) + 0.0 AS top, {passed('z.born', 'CASE WHEN z.side > 0 THEN x.low <= z.top ELSE x.high >= z.bottom END')}::INT AS met, "
        f"{passed('z.born', 'CASE WHEN z.side > 0 THEN x.low < z.bottom ELSE x.high > z.top END')}::INT AS broken FROM z"
    )


def oracle_sql() -> dict[str, str]:
    return {"study_zones": zones_sql(), "study_trend_lines": trend_lines_sql(), "study_pools": pools_sql()}
