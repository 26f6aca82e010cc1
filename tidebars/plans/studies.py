"""Queries of the chart studies, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import studies as T
from tidebars.plans.matrix import finished
from tidebars.plans.sql import EVENT_BARS
from tidebars.sources import bars as B

C = F.col


def agreed(df: DataFrame) -> DataFrame:
    """Vortex leads; the awesome oscillator and the trend of the SSL lines confirm."""
    up: Column = C("vortex_plus") > C("vortex_minus")
    down: Column = C("vortex_plus") < C("vortex_minus")
    return T.composed(T.channels(T.oscillators(df)), up, down, (C("ao") > 0) & (C("ssl_trend") > 0), (C("ao") < 0) & (C("ssl_trend") < 0))


OSCILLATORS = "vortex_plus vortex_minus choppiness dpo ao ac body_spike vix_fix vix_extreme".split()
BANDS = [f"band_{s}_{round(k * 1000)}" for s in ("up", "down") for k in T.SHARES]
#: Name: (what makes the columns, the columns).
STUDIES: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
    "means": (T.means, "wma vwma swma kernel hull".split()),
    "oscillators": (T.oscillators, OSCILLATORS),
    "channels": (T.channels, ["ssl_trend", "ssl_up", "ssl_down", "donchian_trend", "band_basis", *BANDS]),
    "patterns": (T.patterns, T.PATTERNS),
    "gaps": (T.gaps, "gap gap_low gap_high gap_middle bars_to_fill".split()),
    "breakout_odds": (T.breakout_odds, [f"odds_{s}_{k}" for k in range(3) for s in ("up", "down")]),
    "sessions": (T.sessions, "session session_high session_low session_mean session_vwap session_bars".split()),
    "composed": (agreed, ["signal"]),
    "breaks": (T.breaks, "break_side turned trend block_low block_high sweep".split()),
}


def study(name: str) -> Callable[[SparkSession, str], DataFrame]:
    make, columns = STUDIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(make(B.event_bars(spark, sf_dir)), columns, 5)

    run.__name__ = f"study_{name}"
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"study_{n}": study(n) for n in STUDIES}


# --- SQL


def w(n: int | None = None) -> str:
    return "(PARTITION BY symbol ORDER BY ts" + (f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" if n else ")")


SO_FAR = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
BEFORE = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {agg}({x}) OVER {w(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {w()}"


def layers(*more: str, start: str = EVENT_BARS) -> str:
    out = [f"b0 AS ({start})"] + [f"b{i + 1} AS (SELECT *, {e} FROM b{i})" for i, e in enumerate(more)]
    return "WITH " + ", ".join(out)


def shown(last: int, columns: dict[str, str], whole: tuple[str, ...] = (), plain: tuple[str, ...] = ()) -> str:
    cols = [e if n in plain else f"({e})::INT AS {n}" if n in whole else f"round(({e})::DOUBLE, 5) + 0.0 AS {n}" for n, e in columns.items()]
    return f" SELECT symbol, ts, {', '.join(cols)} FROM b{last}"


def taps(x: str, weights: list[float]) -> str:
    """Weights from the oldest value on."""
    n = len(weights)
    return "(" + " + ".join(f"{v!r} * {lag(x, n - 1 - i) if i < n - 1 else x}" for i, v in enumerate(weights)) + f") / {sum(weights)!r}"


def line(n: int) -> list[float]:
    return [float(i) for i in range(1, n + 1)]


def means_sql() -> str:
    kernel = [(1 + i * i / 1024.0) ** -8 for i in range(24, -1, -1)]
    return layers(f"2 * ({taps('close', line(8))}) - {taps('close', line(16))} AS lead") + shown(
        1, {"wma": taps("close", line(20)), "vwma": f"({roll('sum', 'close * volume', 20)}) / ({roll('sum', 'volume', 20)})", "swma": taps("close", [1.0, 2.0, 2.0, 1.0]), "kernel": taps("close", kernel), "hull": taps("lead", line(4))}
    )


TRUE = f"greatest(high - low, coalesce(abs(high - {lag('close')}), 0), coalesce(abs(low - {lag('close')}), 0)) AS tr"
MOVES = f"{TRUE}, abs(high - {lag('low')}) AS vu, abs(low - {lag('high')}) AS vd, (high + low) / 2 AS mid, close - open AS body, {roll('max', 'close', 22)} AS peak, {roll('avg', 'close', 21)} AS m21"
VORTEX = {k: f"({roll('sum', x, 14)}) / nullif({roll('sum', 'tr', 14)}, 0)" for k, x in (("vortex_plus", "vu"), ("vortex_minus", "vd"))}
AO = f"({roll('avg', 'mid', 5)}) - ({roll('avg', 'mid', 34)})"


def oscillators_sql() -> str:
    return layers(MOVES, f"{AO} AS ao, (peak - low) / nullif(peak, 0) * 100 AS wvf, {roll('stddev_pop', 'body', 100)} AS sp") + shown(
        2, VORTEX | {
            "choppiness": f"log10(nullif({roll('sum', 'tr', 14)}, 0) / nullif(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}), 0)) * 100 / log10(14)", "dpo": f"close - {lag('m21', 11)}", "ao": "ao", "ac": f"ao - ({roll('avg', 'ao', 5)})",
            "body_spike": "CASE WHEN body > sp THEN 1 WHEN body < -sp THEN -1 ELSE 0 END", "vix_fix": "wvf",
            "vix_extreme": f"coalesce(wvf >= ({roll('avg', 'wvf', 20)}) + 2 * ({roll('stddev_pop', 'wvf', 20)}), false) OR coalesce(wvf >= 0.85 * ({roll('max', 'wvf', 50)}), false)",
        }, ("body_spike", "vix_extreme"),
    )


SSL = "coalesce(last_value(CASE WHEN close > sh THEN 1 WHEN close < sl THEN -1 END IGNORE NULLS) OVER " + SO_FAR + ", 0)"


def channels_sql() -> str:
    head = layers(
        f"{roll('avg', 'high', 10)} AS sh, {roll('avg', 'low', 10)} AS sl, {roll('max', 'high', 20)} AS dt, {roll('min', 'low', 20)} AS db, (high + low + close) / 3 AS tp",
        f"{lag('dt')} AS dt1, {lag('db')} AS db1, {SSL} AS st, ({roll('sum', 'tp * volume', 200)}) / ({roll('sum', 'volume', 200)}) AS basis, 3 * ({roll('stddev_pop', 'tp', 200)}) AS dev",
    )
    bands = {f"band_{s}_{round(k * 1000)}": f"basis {'+' if s == 'up' else '-'} {k} * dev" for s in ("up", "down") for k in T.SHARES}
    trend = f"coalesce(last_value(CASE WHEN close > dt1 THEN 1 WHEN close < db1 THEN -1 END IGNORE NULLS) OVER {SO_FAR}, 0)"
    return head + shown(2, {"ssl_trend": "st", "ssl_up": "CASE WHEN st < 0 THEN sl ELSE sh END", "ssl_down": "CASE WHEN st < 0 THEN sh ELSE sl END", "donchian_trend": trend, "band_basis": "basis"} | bands, ("ssl_trend", "donchian_trend"))


def patterns_sql() -> str:
    before = ", ".join(f"{lag(x, k)} AS {x[0]}{k}" for x, k in (("open", 1), ("close", 1), ("high", 1), ("low", 1), ("open", 2), ("close", 2), ("open", 5)))
    found = {
        "doji": "abs(open - close) <= 0.05 * (high - low)",
        "bearish_harami": "c1 > o1 AND open > close AND open <= c1 AND o1 <= close AND open - close < c1 - o1 AND o5 < open", "bullish_harami": "o1 > c1 AND close > open AND close <= o1 AND c1 <= open AND close - open < o1 - c1 AND o5 > open",
        "bearish_engulfing": "c1 > o1 AND open > close AND open >= c1 AND o1 >= close AND open - close > c1 - o1 AND o5 < open", "bullish_engulfing": "o1 > c1 AND close > open AND close >= o1 AND c1 >= open AND close - open > o1 - c1 AND o5 > open",
        "piercing": "c1 < o1 AND open < l1 AND close > c1 + (o1 - c1) / 2 AND close < o1 AND o5 > open", "bullish_belt": "low = open AND open < fl AND open < close AND close > (h1 + l1) / 2 AND o5 > open",
        "bullish_kicker": "o1 > c1 AND open >= o1 AND close > open AND o5 > open", "bearish_kicker": "o1 < c1 AND open <= o1 AND close <= open AND o5 < open",
        "evening_star": "c2 > o2 AND least(o1, c1) > c2 AND open < least(o1, c1) AND close < open", "morning_star": "c2 < o2 AND greatest(o1, c1) < c2 AND open > greatest(o1, c1) AND close > open",
        "shooting_star": "o1 < c1 AND open > c1 AND high - greatest(open, close) >= abs(open - close) * 3 AND least(open, close) - low <= abs(open - close)",
        "hammer": "high - low > 3 * abs(open - close) AND (close - low) / (0.001 + high - low) > 0.6 AND (open - low) / (0.001 + high - low) > 0.6",
    }
    return layers(f"{before}, {roll('min', 'low', 10)} AS l10", f"{lag('l10')} AS fl") + shown(2, {k: f"coalesce({e}, false)" for k, e in found.items()}, tuple(found))


def gaps_sql() -> str:
    rises, falls = f"low > {lag('high', 2)}", f"high < {lag('low', 2)}"
    head = layers(f"CASE WHEN {rises} THEN 1 WHEN {falls} THEN -1 ELSE 0 END AS gap, CASE WHEN {rises} THEN {lag('high', 2)} WHEN {falls} THEN high END AS lo, CASE WHEN {rises} THEN low WHEN {falls} THEN {lag('low', 2)} END AS hi")
    later = "(SELECT min(x.rn) - b.rn FROM b1 x WHERE x.symbol = b.symbol AND x.rn > b.rn AND CASE WHEN b.gap = 1 THEN x.low <= b.lo WHEN b.gap = -1 THEN x.high >= b.hi ELSE false END)"
    return head + f", b2 AS (SELECT b.*, {later} AS fill FROM b1 b)" + shown(2, {"gap": "gap", "gap_low": "lo", "gap_high": "hi", "gap_middle": "(lo + hi) / 2", "bars_to_fill": "fill"}, ("gap", "bars_to_fill"))


def breaks_sql() -> str:
    pivot = lambda x, agg: f"CASE WHEN count({x}) OVER {w(5)} = 5 AND {lag(x, 2)} = {agg}({x}) OVER {w(5)} THEN {lag(x, 2)} END"
    last = lambda x: f"last_value({x} IGNORE NULLS) OVER {SO_FAR}"
    return layers(
        f"{pivot('high', 'max')} AS ph, {pivot('low', 'min')} AS pl, " + ", ".join(f"CASE WHEN close {op} open THEN {x} END AS {k}{x}" for k, op in (("f", "<"), ("r", ">")) for x in ("low", "high")),
        f"{last('ph')} AS top, {last('pl')} AS bottom, " + ", ".join(f"{last(k + x)} AS l{k}{x}" for k in "fr" for x in ("low", "high")),
        f"CASE WHEN {lag('close')} <= {lag('top')} AND close > top THEN 1 WHEN {lag('close')} >= {lag('bottom')} AND close < bottom THEN -1 ELSE 0 END AS side",
        f"last_value(nullif(side, 0) IGNORE NULLS) OVER {BEFORE} AS before, coalesce({last('nullif(side, 0)')}, 0) AS trend",
    ) + shown(
        4, {
            "break_side": "side", "turned": "coalesce(side <> 0 AND before = -side, false)", "trend": "trend", "block_low": "CASE side WHEN 1 THEN lflow WHEN -1 THEN lrlow END", "block_high": "CASE side WHEN 1 THEN lfhigh WHEN -1 THEN lrhigh END",
            "sweep": "CASE WHEN high > top AND close < top THEN -1 WHEN low < bottom AND close > bottom THEN 1 ELSE 0 END",
        }, ("break_side", "turned", "trend", "sweep"),
    )


def odds_sql() -> str:
    seen = "(PARTITION BY symbol, colour ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    share = lambda cond: f"CASE WHEN colour IS NOT NULL THEN 100.0 * count(*) FILTER (WHERE {cond}) OVER {seen} / count(*) OVER {seen} END"
    out = {f"odds_{s}_{k}": share(f"high >= h1 + {k} * st" if s == "up" else f"low <= l1 - {k} * st") for k in range(3) for s in ("up", "down")}
    return layers(f"{lag('open')} AS o1, {lag('close')} AS c1, {lag('high')} AS h1, {lag('low')} AS l1", f"CASE WHEN c1 > o1 THEN 1 WHEN c1 < o1 THEN -1 END AS colour, c1 * {0.1 / 100!r} AS st") + shown(2, out)


def sessions_sql() -> str:
    cases = " ".join(f"WHEN hour(ts) >= {a} AND hour(ts) < {b} THEN '{s}'" for s, a, b in T.SESSIONS)
    s = "(PARTITION BY symbol, ts::DATE, session ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return layers(f"CASE {cases} ELSE 'late' END AS session") + shown(
        1, {
            "session": "session", "session_high": f"max(high) OVER {s}", "session_low": f"min(low) OVER {s}", "session_mean": f"avg(close) OVER {s}",
            "session_vwap": f"sum(close * volume) OVER {s} / sum(volume) OVER {s}", "session_bars": f"count(*) OVER {s}",
        }, ("session_bars",), ("session",),
    )


def composed_sql() -> str:
    side = "CASE WHEN lr BETWEEN 1 AND 3 AND ao > 0 AND st > 0 THEN 1 WHEN sr BETWEEN 1 AND 3 AND ao < 0 AND st < 0 THEN -1 END AS side"
    run = lambda x: f"rn - coalesce(max(CASE WHEN NOT {x} THEN rn END) OVER {SO_FAR}, 0)"
    return layers(
        f"{MOVES}, {roll('avg', 'high', 10)} AS sh, {roll('avg', 'low', 10)} AS sl", f"{AO} AS ao, {VORTEX['vortex_plus']} AS vp, {VORTEX['vortex_minus']} AS vm, {SSL} AS st",
        "coalesce(vp > vm, false) AS lc, coalesce(vp < vm, false) AS sc", f"{run('lc')} AS lr, {run('sc')} AS sr", side, f"last_value(side IGNORE NULLS) OVER {BEFORE} AS before",
    ) + shown(6, {"signal": "CASE WHEN side IS NOT NULL AND (before IS NULL OR before <> side) THEN side ELSE 0 END"}, ("signal",))


def oracle_sql() -> dict[str, str]:
    return {
        "study_means": means_sql(), "study_oscillators": oscillators_sql(), "study_channels": channels_sql(), "study_patterns": patterns_sql(), "study_gaps": gaps_sql(), "study_breakout_odds": odds_sql(),
        "study_sessions": sessions_sql(), "study_composed": composed_sql(), "study_breaks": breaks_sql(),
    }
