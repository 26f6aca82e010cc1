"""Queries of the machines that feed back on themselves and of the trend over clusters, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebars.operators import clusters
from tidebars.operators import feedback as K
from tidebars.operators import recurrence as S
from tidebars.plans.matrix import finished
from tidebars.plans.oracles import DOWN, NONE, UP, ewm, merged, span, walk
from tidebars.plans.sql import EVENT_BARS, shown
from tidebars.plans.zone_studies import mean_range
from tidebars.sources import bars as B

MACHINES: dict[str, tuple[tuple[str, ...], Callable[[], S.Machine]]] = {
    "study_qqe": (("qqe_rsi", "qqe_line", "qqe_trend"), K.Qqe),
    "study_half_trend": (("half_line", "half_trend"), K.HalfTrend),
    "study_range_filter": (("filter", "filter_run"), K.RangeFilter),
}


def machine(name: str) -> Callable[[SparkSession, str], DataFrame]:
    outputs, make = MACHINES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(S.scan(B.event_bars(spark, sf_dir), [S.Scan(outputs, make)]), list(outputs), 5)

    run.__name__ = name
    return run


def study_adaptive_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(clusters.adaptive_trend(B.event_bars(spark, sf_dir)), ["cluster", "centre", "trend_line", "trend_side"], 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: machine(n) for n in MACHINES} | {"study_adaptive_trend": study_adaptive_trend}


# --- SQL: states of the bar before are o_<name>


def either(now: str, line: str, before: str, line_before: str) -> str:
    return f"coalesce(({now} > {line} AND {before} <= {line_before}) OR ({now} < {line} AND {before} >= {line_before}), false)"


QQE = [
    merged(ewm("up", UP, 1 / 6), ewm("dn", DOWN, 1 / 6)),
    ewm("rm", "CASE WHEN dn <> 0 THEN 100 - 100 / (1 + up / dn) END", span(5)),
    ewm("m1", "abs(rm - o_rm)", span(11)),
    ewm("m2", "m1", span(11)),
    {"lo": (NONE, "CASE WHEN m2 IS NULL THEN NULL WHEN o_rm > o_lo AND rm > o_lo THEN greatest(o_lo, rm - m2 * 1.61::DOUBLE) ELSE rm - m2 * 1.61::DOUBLE END"), "hi": (NONE, "CASE WHEN m2 IS NULL THEN NULL WHEN o_rm < o_hi AND rm < o_hi THEN least(o_hi, rm + m2 * 1.61::DOUBLE) ELSE rm + m2 * 1.61::DOUBLE END"), "lo2": (NONE, "o_lo"), "hi2": (NONE, "o_hi")},
    {"tr": ("1", f"CASE WHEN {either('rm', 'o_hi', 'o_rm', 'o_hi2')} THEN 1 WHEN {either('rm', 'o_lo', 'o_rm', 'o_lo2')} THEN -1 ELSE o_tr END")},
]
HALF = [
    {"mo0": ("low", "CASE WHEN o_aw = 1 THEN greatest(least(low, pl1), o_mo) ELSE o_mo END"), "le0": ("high", "CASE WHEN o_aw = 1 THEN o_le ELSE least(greatest(high, ph1), o_le) END")},
    {"fall": ("0", "CASE WHEN o_aw = 1 AND (high + ph1) / 2 < mo0 AND close < pl1 THEN 1 ELSE 0 END"), "rise": ("0", "CASE WHEN o_aw = 0 AND (low + pl1) / 2 > le0 AND close > ph1 THEN 1 ELSE 0 END")},
    {
        "aw": ("0", "CASE WHEN fall = 1 THEN 0 WHEN rise = 1 THEN 1 ELSE o_aw END"), "tr": ("0", "CASE WHEN fall = 1 THEN 1 WHEN rise = 1 THEN 0 ELSE o_tr END"),
        "mo": ("low", "CASE WHEN rise = 1 THEN least(low, pl1) ELSE mo0 END"), "le": ("high", "CASE WHEN fall = 1 THEN greatest(high, ph1) ELSE le0 END"),
    },
    {
        "u": (NONE, "CASE WHEN tr <> 0 THEN o_u WHEN o_tr <> 0 THEN o_d WHEN o_u IS NULL THEN mo ELSE greatest(mo, o_u) END"),
        "d": (NONE, "CASE WHEN tr = 0 THEN o_d WHEN o_tr = 0 THEN o_u WHEN o_d IS NULL THEN le ELSE least(le, o_d) END"),
    },
]
RANGE = [
    ewm("m1", "abs(close - pc)", span(100)),
    ewm("m2", "m1", span(199)),
    {"y": (NONE, "CASE WHEN m2 IS NULL THEN NULL WHEN o_y IS NULL THEN close WHEN close > o_y THEN greatest(o_y, close - m2 * 3.0::DOUBLE) ELSE least(o_y, close + m2 * 3.0::DOUBLE) END")},
    {"run": ("0", "CASE WHEN y > o_y THEN greatest(o_run, 0) + 1 WHEN y < o_y THEN least(o_run, 0) - 1 ELSE o_run END")},
]


def clusters_sql(n: int = 10, window: int = 100) -> str:
    """Bars with the centre next to their mean range, by recursion until centres stay."""
    w = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    far = lambda k: f"abs(v - {'abc'[k]})"
    mine = lambda k: f"list_avg(list_filter(vs, lambda v: {' AND '.join(f'{far(k)} < {far(o)}' for o in range(3) if o != k)}))"
    moved = " OR ".join(f"abs(n{x} - {x}) > 1e-12 * abs({x})" for x in "abc")
    return (
        f"(WITH RECURSIVE b0 AS MATERIALIZED ({EVENT_BARS}), {mean_range(n)}, m0 AS (SELECT b0.*, CASE WHEN rn >= {n} THEN mr END AS mr FROM b0 JOIN walk USING (symbol, rn)), m1 AS (SELECT *, CASE WHEN count(mr) OVER {w} = {window} THEN list(mr) OVER {w} END AS vs FROM m0), "
        "km AS (SELECT symbol, rn, vs, lo + (hi - lo) * 0.75 AS a, lo + (hi - lo) * 0.5 AS b, lo + (hi - lo) * 0.25 AS c, true AS going FROM (SELECT symbol, rn, vs, list_min(vs) AS lo, list_max(vs) AS hi FROM m1 WHERE vs IS NOT NULL) UNION ALL "
        f"SELECT symbol, rn, vs, na, nb, nc, {moved} FROM (SELECT *, {', '.join(f'coalesce({mine(k)}, {x}) AS n{x}' for k, x in enumerate('abc'))} FROM km WHERE going)), "
        "fin AS (SELECT * FROM km WHERE NOT going) "
        "SELECT m0.*, list_position(ds, list_min(ds)) - 1 AS cluster, cs[list_position(ds, list_min(ds))] AS centre FROM m0 LEFT JOIN (SELECT symbol, rn, [a, b, c] AS cs FROM fin) f USING (symbol, rn), LATERAL (SELECT list_transform(cs, lambda x: abs(m0.mr - x)) AS ds) d)"
    )


ADAPTIVE = [
    {
        "sup": (NONE, "CASE WHEN centre IS NOT NULL THEN CASE WHEN o_sup IS NOT NULL AND pc > o_sup THEN greatest((high + low) / 2 - 3 * centre, o_sup) ELSE (high + low) / 2 - 3 * centre END END"),
        "sdown": (NONE, "CASE WHEN centre IS NOT NULL THEN CASE WHEN o_sdown IS NOT NULL AND pc < o_sdown THEN least((high + low) / 2 + 3 * centre, o_sdown) ELSE (high + low) / 2 + 3 * centre END END"),
        "dir": ("1", "CASE WHEN o_sup IS NULL THEN o_dir WHEN o_dir < 0 AND close > o_sdown THEN 1 WHEN o_dir > 0 AND close < o_sup THEN -1 ELSE o_dir END"),
    },
]


def oracle_sql() -> dict[str, str]:
    told = lambda levels, out: walk(levels, out) + shown({n: n for n in out}, 1, digits=5)
    adaptive = walk(ADAPTIVE, {"cluster": "b.cluster", "centre": "b.centre", "trend_line": "CASE WHEN dir > 0 THEN sup ELSE sdown END", "trend_side": "CASE WHEN b.centre IS NOT NULL THEN dir END"}, clusters_sql())
    return {
        "study_adaptive_trend": adaptive + shown({n: n for n in ("cluster", "centre", "trend_line", "trend_side")}, 1, ("cluster",), digits=5),
        "study_qqe": told(QQE, {"qqe_rsi": "rm", "qqe_line": "CASE WHEN tr = 1 THEN lo ELSE hi END", "qqe_trend": "tr"}),
        "study_half_trend": told(HALF, {"half_line": "CASE WHEN tr = 0 THEN u ELSE d END", "half_trend": "tr"}),
        "study_range_filter": told(RANGE, {"filter": "y", "filter_run": "run"}),
    }
