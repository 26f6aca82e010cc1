"""SQL for DuckDB that the queries are held against."""

from __future__ import annotations

OHLCV = ["open", "high", "low", "close", "volume"]
#: Names and lengths of exponential means.
RECURSIVE = {"ema9": 9, "ema21": 21, "ema50": 50}


def numbered(body: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({body})"


EVENT_BARS = numbered(
    "SELECT event_type AS symbol, time_bucket(INTERVAL '30 minutes', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM events GROUP BY 1, 2"
)
ORDER_BARS = numbered(
    "SELECT 'ORDERS' AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 2"
)
LINE_BARS = numbered(
    "SELECT 'LINES' AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber) AS close, sum(l_quantity)::DOUBLE AS volume FROM lineitem GROUP BY 2"
)
FRAMES = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 4, 5, 9, 10, 13, 14, 20, 22, 26, 30, 45, 49, 50, 52, 80, 100, 130))
WINDOWS = f"WINDOW w AS (PARTITION BY symbol ORDER BY ts), s AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), s1 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {FRAMES}"
TRUE_RANGE = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


def steps(bars: str, *layers: str) -> str:
    """Common tables b0 (bars), b1, ...: each adds the given expressions to the one before."""
    out = [f"b0 AS ({bars})"]
    for i, more in enumerate(layers):
        out.append(f"b{i + 1} AS (SELECT *, {more} FROM b{i} {WINDOWS})")
    return "WITH RECURSIVE " + ", ".join(out)


def shown(expressions: dict[str, str], last: int, whole: tuple[str, ...] = (), digits: int = 6) -> str:
    """symbol, ts and the given columns, as finished() gives them."""
    cols = [f"({e})::INT AS {n}" if n in whole else f"round(({e})::DOUBLE, {digits}) + 0.0 AS {n}" for n, e in expressions.items()]
    return f" SELECT symbol, ts, {', '.join(cols)} FROM b{last} {WINDOWS}"


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


BANDS = (
    f"{TRUE_RANGE} AS tr, {roll('avg', 'close', 20)} AS mid, {roll('stddev_pop', 'close', 20)} AS sd",
    f"{roll('avg', 'tr', 20)} AS tr20",
    "coalesce(mid + 2 * sd < mid + 1.5 * tr20 AND mid - 2 * sd > mid - 1.5 * tr20, false) AS inside",
)


BAND_COLUMNS = {
    "bb_basis": "mid", "bb_upper": "mid + 2 * sd", "bb_lower": "mid - 2 * sd", "kc_upper": "mid + 1.5 * tr20", "kc_lower": "mid - 1.5 * tr20", "bb_width_pct": "4 * sd / nullif(mid, 0) * 100",
    "bb_position": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0)", "squeeze_state": "CASE WHEN inside THEN -1 WHEN lag(inside) OVER w THEN 1 ELSE 0 END",
}


def bollinger_sql() -> str:
    return steps(EVENT_BARS, *BANDS) + shown(BAND_COLUMNS, 3, ("squeeze_state",))


def walk_sql() -> str:
    """b1: the bars with what recursion gives, state by state along each symbol's bars."""
    weights = {"ema9": 2 / 10, "ema21": 2 / 22, "ema50": 2 / 51, "e12": 2 / 13, "e26": 2 / 27}
    walk = ", ".join(f"{a!r} * b.close + {1 - a!r} * r.{n} AS {n}" for n, a in weights.items())
    line = f"({weights['e12']!r} * b.close + {1 - weights['e12']!r} * r.e12 - {weights['e26']!r} * b.close - {1 - weights['e26']!r} * r.e26)"
    mean = lambda new, old, n=14: f"CASE WHEN {old} IS NULL THEN {new} ELSE ({new}) / {n}.0 + {old} * {n - 1}.0 / {n}.0 END"
    rise, fall = "greatest(b.close - r.close, 0)", "greatest(r.close - b.close, 0)"
    tr = "greatest(b.high - b.low, abs(b.high - r.close), abs(b.low - r.close))"
    return (
        f"WITH RECURSIVE b0 AS MATERIALIZED ({EVENT_BARS}), r AS (SELECT symbol, ts, rn, close, {', '.join(f'close AS {n}' for n in weights)}, NULL::DOUBLE AS sig, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, (high - low)::DOUBLE AS atr, (high - low)::DOUBLE AS atr5 FROM b0 WHERE rn = 1 "
        f"UNION ALL SELECT b.symbol, b.ts, b.rn, b.close, {walk}, CASE WHEN b.rn < 26 THEN NULL WHEN r.sig IS NULL THEN {line} ELSE 0.2 * {line} + 0.8 * r.sig END, {mean(rise, 'r.up')}, {mean(fall, 'r.dn')}, {mean(tr, 'r.atr')}, {mean(tr, 'r.atr5', 5)} FROM r JOIN b0 b ON b.symbol = r.symbol AND b.rn = r.rn + 1), "
        f"b1 AS (SELECT b0.*, {', '.join(f'r.{n}' for n in weights)}, sig, up, dn, CASE WHEN b0.rn >= 14 THEN atr END AS atr_14, CASE WHEN b0.rn >= 5 THEN atr5 END AS atr_5 FROM b0 JOIN r ON r.symbol = b0.symbol AND r.rn = b0.rn)"
    )


def exponential_sql() -> str:
    return walk_sql() + shown(
        {n: f"CASE WHEN rn >= {k} THEN {n} END" for n, k in RECURSIVE.items()}
        | {"rsi_14": "CASE WHEN rn >= 15 AND dn > 0 THEN 100 - 100 / (1 + up / dn) END", "macd_line": "CASE WHEN rn >= 26 THEN e12 - e26 END", "macd_signal": "CASE WHEN rn >= 34 THEN sig END", "atr_14": "atr_14"}, 1,
    )


def volatility_sql() -> str:
    layers = [*BANDS[:2], f"{BANDS[2]}, CASE WHEN count(atr_14) OVER w100 = 100 THEN array_agg(atr_14) OVER w100 END AS a"]
    return walk_sql() + "".join(f", b{i + 2} AS (SELECT *, {more} FROM b{i + 1} {WINDOWS})" for i, more in enumerate(layers)) + shown(
        same("atr_14", "atr_5") | {"atr_ratio": "atr_5 / nullif(atr_14, 0)", "atr_percentile": "len(list_filter(a, lambda x: x < atr_14)) + (len(list_filter(a, lambda x: x = atr_14)) + 1) / 2.0"} | BAND_COLUMNS, 4, ("squeeze_state",),
    )


def reversion_sql() -> str:
    n = 20
    powers = ", ".join(f"list_sum(list_transform(a, lambda x: (x - m) ** {k})) / {n} AS m{k}" for k in (2, 3, 4))
    z = lambda k: f"(close - {roll('avg', 'close', k)}) / nullif({roll('stddev_pop', 'close', k)}, 0)"
    return steps(
        EVENT_BARS, f"{BANDS[0]}, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r", f"CASE WHEN count(r) OVER w{n} = {n} THEN array_agg(r) OVER w{n} END AS a, lag(r) OVER w AS p", "list_avg(a) AS m, CASE WHEN r IS NOT NULL AND p IS NOT NULL THEN r END AS x, CASE WHEN r IS NOT NULL THEN p END AS y", powers,
    ) + shown(
        {
            "bb_pct_b": BAND_COLUMNS["bb_position"], "bb_dist_mid_sigma": z(20), "zscore_20": z(20), "zscore_50": z(50),
            "skewness_20": f"CASE WHEN m2 = 0 THEN 0 ELSE m3 / m2 ** 1.5 * {((n * (n - 1)) ** 0.5 / (n - 2))!r} END",
            "kurtosis_20": f"CASE WHEN m2 = 0 THEN -3 ELSE (({n} + 1) * (m4 / m2 ** 2 - 3) + 6) * {((n - 1) / ((n - 2) * (n - 3)))!r} END",
            "autocorr_1": "CASE WHEN count(x) OVER w49 = 49 THEN covar_pop(x, y) OVER w49 / nullif(stddev_pop(x) OVER w49 * stddev_pop(y) OVER w49, 0) END",
        }, 4,
    )


def statistics_sql() -> str:
    n = 20
    moments = f"CASE WHEN count(close) OVER w{n} = {n} THEN array_agg(close) OVER w{n} END AS a, lag(close) OVER w AS p, CASE WHEN lag(close) OVER w IS NOT NULL THEN close END AS q"
    more = "list_avg(a) AS m"
    powers = ", ".join(f"list_sum(list_transform(a, lambda x: (x - m) ** {k})) / {n} AS m{k}" for k in (2, 3, 4))
    return steps(EVENT_BARS, moments, more, powers) + shown(
        {
            "mean_10": roll("avg", "close", 10), "sd_10": roll("stddev_pop", "close", 10),
            "skew_20": f"CASE WHEN m2 = 0 THEN 0 ELSE m3 / m2 ** 1.5 * {((n * (n - 1)) ** 0.5 / (n - 2))!r} END",
            "kurt_20": f"CASE WHEN m2 = 0 THEN -3 ELSE (({n} + 1) * (m4 / m2 ** 2 - 3) + 6) * {((n - 1) / ((n - 2) * (n - 3)))!r} END",
            "line_20": f"CASE WHEN count(close) OVER w{n} = {n} THEN regr_intercept(close, rn) OVER w{n} + regr_slope(close, rn) OVER w{n} * rn END",
            "rank_20": f"(len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close)) + 1) / 2.0) / {n} * 100",
            "corr_20": f"CASE WHEN count(p) OVER w{n} = {n} THEN covar_pop(q, p) OVER w{n} / nullif(stddev_pop(q) OVER w{n} * stddev_pop(p) OVER w{n}, 0) END",
        }, 3, digits=5,
    )


PIVOT = {k: f"CASE WHEN count({x}) OVER w5 = 5 AND lag({x}, 2) OVER w = {agg}({x}) OVER w5 THEN lag({x}, 2) OVER w END AS {k}" for k, x, agg in (("ph", "high", "max"), ("pl", "low", "min"))}


def distance_sql() -> str:
    return steps(EVENT_BARS, f"{roll('avg', 'close', 10)} AS m, {PIVOT['ph']}, {PIVOT['pl']}", "(lag(close) OVER w <= lag(m) OVER w AND close > m)::INT AS crossed") + shown(
        {
            "crossed": "crossed", "since_cross": "rn - max(CASE WHEN crossed = 1 THEN rn END) OVER s", "run_above": "rn - coalesce(max(CASE WHEN NOT coalesce(close > m, false) THEN rn END) OVER s, 0)",
            "last_high": "last_value(ph IGNORE NULLS) OVER s", "last_low": "last_value(pl IGNORE NULLS) OVER s", "high_before": "last_value(ph IGNORE NULLS) OVER s1",
        }, 2, ("crossed", "since_cross", "run_above"),
    )


def candles_sql() -> str:
    return steps(
        EVENT_BARS, "abs(close - open) AS body, lag(open) OVER w AS po, lag(close) OVER w AS pc, nullif(high - low, 0) AS r", "body / r AS body_pct, (high - greatest(open, close)) / r AS upper_wick_pct, (least(open, close) - low) / r AS lower_wick_pct"
    ) + shown(
        same("body_pct", "upper_wick_pct", "lower_wick_pct")
        | {
            "range_pct": "(high - low) / nullif(close, 0) * 100", "is_bullish": "close > open", "body_vs_prev_body": "body / nullif(lag(body) OVER w, 0)",
            "engulfing_signal": "CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1 WHEN close < open AND pc > po AND close <= po AND open >= pc THEN -1 ELSE 0 END",
            "pin_bar_signal": "CASE WHEN lower_wick_pct > 2 * body_pct AND upper_wick_pct < body_pct THEN 1 ELSE 0 END - CASE WHEN upper_wick_pct > 2 * body_pct AND lower_wick_pct < body_pct THEN 1 ELSE 0 END",
            "inside_bar_flag": "coalesce(high < lag(high) OVER w AND low > lag(low) OVER w, false)",
        }, 2, ("is_bullish", "engulfing_signal", "pin_bar_signal", "inside_bar_flag"),
    )


def calendar_sql() -> str:
    out = {f"{name}_{f}": f"{f}(2 * pi() * {x} / {n})" for name, x, n in (("hour_of_day", "hour(ts)", 24), ("day_of_week", "(isodow(ts) - 1)", 7)) for f in ("sin", "cos")}
    flags = {"is_weekend": "isodow(ts) >= 6", "session_overlap_asian_london": "hour(ts) BETWEEN 7 AND 8", "session_overlap_london_ny": "hour(ts) BETWEEN 13 AND 15", "session_overlap_ny_asian": "hour(ts) >= 21 OR hour(ts) < 6", "month_of_year": "month(ts)"}
    return steps(EVENT_BARS) + shown(out | flags, 0, tuple(flags))


def context_sql() -> str:
    today = "OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return steps(EVENT_BARS, f"first_value(open) {today} AS o, abs(max(high) {today} - close) AS up, abs(close - min(low) {today}) AS down, nullif(close, 0) AS c") + shown(
        {f"prev_bar_{x}_vs_close_pct": f"(lag({x}) OVER w - close) / c * 100" for x in ("close", "high", "low")}
        | {"prev_bar_volume_ratio": "lag(volume) OVER w / nullif(volume, 0)", "today_open_to_now_pct": "(close - o) / nullif(o, 0) * 100", "today_high_low_distance_from_current_pct": "CASE WHEN down < up THEN down ELSE -up END / c * 100"}, 1,
    )


def ichimoku_sql() -> str:
    mid = lambda n: f"CASE WHEN count(*) OVER w{n} = {n} THEN (max(high) OVER w{n} + min(low) OVER w{n}) / 2 END"
    return steps(EVENT_BARS, f"{mid(9)} AS t, {mid(26)} AS k, {mid(52)} AS b, nullif(close, 0) AS c", "lag((t + k) / 2, 26) OVER w AS sa, lag(b, 26) OVER w AS sb") + shown(
        {
            "tenkan_dist_pct": "(close - t) / c * 100", "kijun_dist_pct": "(close - k) / c * 100", "tk_diff_pct": "(t - k) / c * 100", "senkou_a_dist_pct": "(close - sa) / c * 100", "senkou_b_dist_pct": "(close - sb) / c * 100",
            "cloud_dist_pct": "(close - (sa + sb) / 2) / c * 100",
        }, 2,
    )


def resample_sql() -> str:
    return (
        f"WITH b AS ({EVENT_BARS}), m AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2), "
        "g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '4 hours')) AS ts FROM m GROUP BY symbol) "
        f"SELECT g.symbol, g.ts, {', '.join(f'round(m.{x}, 6) AS {x}' for x in OHLCV[:4])}, round(coalesce(m.volume, 0), 6) AS volume FROM g LEFT JOIN m ON m.symbol = g.symbol AND m.ts = g.ts"
    )


BARRIER_CTE = (
    "h AS (SELECT b.symbol, b.rn, min(CASE WHEN n.high >= b.close + 2.4 * b.tr20 THEN n.rn - b.rn END) AS iu, min(CASE WHEN n.low <= b.close - 2.4 * b.tr20 THEN n.rn - b.rn END) AS id, count(n.rn) AS ahead, max(CASE WHEN n.rn = b.rn + 12 THEN n.close END) AS last "
    "FROM b2 b LEFT JOIN b0 n ON n.symbol = b.symbol AND n.rn BETWEEN b.rn + 1 AND b.rn + 12 GROUP BY 1, 2), "
    "k AS (SELECT b.*, h.iu, h.id, h.last, h.ahead < 12 AS tail, tr20 IS NULL OR tr20 <= 0 AS unknown, coalesce(tr20 / nullif(close, 0) * 100 < 0.5, false) AS quiet, coalesce(iu < coalesce(id, 99), false) AS up, coalesce(id <= coalesce(iu, 99), false) AS down, (last - close) / nullif(close, 0) * 100 AS ret FROM b2 b JOIN h ON h.symbol = b.symbol AND h.rn = b.rn), "
    "b3 AS (SELECT *, CASE WHEN tail THEN -1 WHEN unknown THEN 2 WHEN quiet THEN -2 WHEN up THEN 0 WHEN down THEN 1 WHEN ret > 0.3 THEN 0 WHEN ret < -0.3 THEN 1 ELSE 2 END AS label, CASE WHEN tail OR unknown OR quiet THEN 12 WHEN up THEN iu WHEN down THEN id ELSE 12 END AS holding_bars, "
    "CASE WHEN tail OR unknown OR quiet THEN NULL WHEN up THEN close + 2.4 * tr20 WHEN down THEN close - 2.4 * tr20 ELSE last END AS exit_price FROM k)"
)


def barriers(bars: str) -> str:
    return steps(bars, *BANDS[:2]) + ", " + BARRIER_CTE


def barrier_sql() -> str:
    return barriers(EVENT_BARS) + shown(same("label", "holding_bars", "exit_price") | {"pnl_pct": "(exit_price - close) / nullif(close, 0) * 100"}, 3, ("label", "holding_bars"))


FOLDS = (
    "e AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b0 GROUP BY 1), f0 AS (SELECT symbol, z, CASE WHEN a = date_trunc('month', a) THEN a ELSE date_trunc('month', a) + INTERVAL 1 MONTH END AS base FROM e), "
    "f1 AS (SELECT symbol, z, base, unnest(range(0, 1000)) AS fold FROM f0), f AS (SELECT symbol, fold::INT AS fold, (base + to_months(fold::INT))::TIMESTAMP AS train_start, (base + to_months(fold::INT + 9))::TIMESTAMP AS train_end, (base + to_months(fold::INT + 10))::TIMESTAMP AS val_end FROM f1 WHERE base + to_months(fold::INT + 10) <= z)"
)


def fold_parts(table: str) -> str:
    return (
        f"{FOLDS}, p0 AS (SELECT x.*, f.fold, CASE WHEN x.ts < train_end THEN 'train' ELSE 'val' END AS part FROM {table} x JOIN f ON f.symbol = x.symbol AND x.ts >= train_start AND x.ts < val_end), "
        "p1 AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold, part ORDER BY ts) AS u, row_number() OVER (PARTITION BY symbol, fold, part ORDER BY ts DESC) AS d FROM p0), p AS (SELECT * FROM p1 WHERE CASE WHEN part = 'train' THEN d > 12 ELSE u > 12 END)"
    )


GATE_CTE = (
    "kn AS (SELECT * FROM p WHERE label IN (0, 1, 2)), t AS (SELECT symbol, fold, count(*) FILTER (label = 0) + 1.0 AS c0, count(*) FILTER (label = 1) + 1.0 AS c1, count(*) FILTER (label = 2) + 1.0 AS c2 FROM kn WHERE part = 'train' GROUP BY 1, 2), "
    "v AS (SELECT k.symbol, k.fold, -avg(ln(CASE label WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END / (c0 + c1 + c2))) AS log_loss, count(*) AS n_val FROM kn k JOIN t ON t.symbol = k.symbol AND t.fold = k.fold WHERE part = 'val' GROUP BY 1, 2), "
    "q AS (SELECT symbol, fold, label, count(*) AS n FROM kn WHERE part = 'val' GROUP BY ALL), pr AS (SELECT symbol, fold, -sum(n / s * ln(n / s)) AS prior FROM (SELECT *, sum(n) OVER (PARTITION BY symbol, fold) AS s FROM q) GROUP BY 1, 2), "
    "g AS (SELECT v.symbol, v.fold, log_loss, n_val, prior, CASE WHEN prior <> 0 THEN log_loss / prior END AS ratio FROM v JOIN pr ON pr.symbol = v.symbol AND pr.fold = v.fold)"
)


def gate_sql(select: str) -> str:
    return f"{barriers(ORDER_BARS)}, {fold_parts('b3')}, {GATE_CTE} {select}"


TAKEN = (
    "c AS (SELECT symbol, ts, rn, holding_bars, coalesce(pnl_pct IS NOT NULL AND lag(close) OVER w <= lag(mid) OVER w AND close > mid, false) AS sig, pnl_pct - 0.09 AS pnl FROM (SELECT *, (exit_price - close) / nullif(close, 0) * 100 AS pnl_pct FROM b3) WINDOW w AS (PARTITION BY symbol ORDER BY ts)), "
    "o AS (SELECT symbol, rn, sig AS taken, CASE WHEN sig THEN holding_bars ELSE 0 END AS rest FROM c WHERE rn = 1 UNION ALL "
    "SELECT c.symbol, c.rn, o.rest = 0 AND c.sig, CASE WHEN o.rest > 0 THEN o.rest - 1 WHEN c.sig THEN c.holding_bars ELSE 0 END FROM o JOIN c ON c.symbol = o.symbol AND c.rn = o.rn + 1), "
    "tr AS (SELECT c.* FROM c JOIN o ON c.symbol = o.symbol AND c.rn = o.rn WHERE taken)"
)


def measures_sql() -> str:
    return (
        f"{barriers(EVENT_BARS)}, {TAKEN}, a AS (SELECT *, sum(pnl) OVER s AS total FROM tr WINDOW s AS (PARTITION BY symbol ORDER BY ts)), d AS (SELECT *, greatest(max(total) OVER s, 0) - total AS fall FROM a WINDOW s AS (PARTITION BY symbol ORDER BY ts)) "
        "SELECT symbol, count(*) AS trades, round(avg((pnl > 0)::DOUBLE), 5) AS win_rate, round(avg(pnl), 5) AS mean_pnl, round(stddev_pop(pnl), 5) AS sd_pnl, round(avg(pnl) / nullif(stddev_pop(pnl), 0), 5) AS sharpe, round(avg(pnl) / nullif(sqrt(avg(least(pnl, 0) ** 2)), 0), 5) AS sortino, "
        "round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 5) AS profit_factor, sum(holding_bars)::BIGINT AS bars_held, round(max(fall), 5) AS max_drawdown FROM d GROUP BY symbol"
    )


VOLUME_BARS = (
    "WITH t AS (SELECT l_returnflag AS symbol, l_extendedprice AS price, l_quantity AS q, row_number() OVER w AS i, floor(coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 500)::BIGINT AS bar FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber)) "
    "SELECT symbol, bar, round(arg_min(price, i), 4) AS open, round(max(price), 4) AS high, round(min(price), 4) AS low, round(arg_max(price, i), 4) AS close, round(sum(q), 4) AS volume, count(*) AS ticks FROM t GROUP BY 1, 2"
)
DRIFT = (
    f"WITH b AS ({EVENT_BARS}), c AS (SELECT symbol, least(greatest(floor(close / 20), 0), 9) AS k, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS p, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS q FROM b GROUP BY 1, 2), "
    "g AS (SELECT symbol, k, coalesce(p, 0) + 0.5 AS p, coalesce(q, 0) + 0.5 AS q FROM (SELECT DISTINCT b.symbol, r.k FROM b, range(0, 10) r(k)) LEFT JOIN c USING (symbol, k)), s AS (SELECT symbol, p::DOUBLE / sum(p) OVER (PARTITION BY symbol) AS p, q::DOUBLE / sum(q) OVER (PARTITION BY symbol) AS q FROM g) "
    "SELECT symbol, round(sum((q - p) * ln(q / p)), 6) AS psi FROM s GROUP BY 1"
)


def plain_bars(bars: str, digits: int = 6) -> str:
    return steps(bars) + shown(same(*OHLCV), 0, digits=digits)


def plain_sql() -> dict[str, str]:
    return {
        "volume_bars": VOLUME_BARS, "drift": DRIFT, "backtest_measures": measures_sql(), "backtest_trades": f"{barriers(EVENT_BARS)}, {TAKEN} SELECT symbol, ts, holding_bars::INT AS holding_bars, round(pnl, 6) AS pnl FROM tr",
        "calibration": "SELECT quality, round(avg((s - toxic) ** 2), 6) AS brier, count(*) AS n FROM (SELECT *, avg(toxic) OVER () AS s FROM labels) GROUP BY 1",
        "bars_30m": plain_bars(EVENT_BARS), "bars_daily_orders": plain_bars(ORDER_BARS, 4), "bars_daily_lines": plain_bars(LINE_BARS, 4), "resample_4h": resample_sql(),
        "range_scan": "SELECT event_id, ts, event_type, round(value, 6) AS value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'",
        "latest_bar": f"SELECT symbol, max(ts) AS last_ts, count(*) AS bars FROM ({EVENT_BARS}) GROUP BY 1",
        "keep_last": "SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 6) AS o_totalprice FROM orders GROUP BY 1, 2",
        "exponential": exponential_sql(), "bollinger": bollinger_sql(), "window_statistics": statistics_sql(), "event_distance": distance_sql(),
        "features_volatility": volatility_sql(), "features_mean_reversion": reversion_sql(), "features_candles": candles_sql(), "features_calendar": calendar_sql(), "features_context": context_sql(), "features_ichimoku": ichimoku_sql(), "triple_barrier": barrier_sql(),
        "label_shares": barriers(EVENT_BARS) + " SELECT symbol, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM b3 GROUP BY symbol, label",
        "prior_entropy": "SELECT toxic, round(-sum(n / s * ln(n / s)), 6) AS prior, sum(n)::BIGINT AS n FROM (SELECT toxic, quality, count(*) AS n, sum(count(*)) OVER (PARTITION BY toxic) AS s FROM labels GROUP BY toxic, quality) GROUP BY toxic",
        "walk_forward_folds": f"WITH b0 AS ({ORDER_BARS}), {FOLDS} SELECT * FROM f",
        "fold_sizes": f"WITH b0 AS ({ORDER_BARS}), {fold_parts('b0')} SELECT symbol, fold, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1, 2, 3",
        "prior_gate": gate_sql("SELECT symbol, fold, round(log_loss, 6) AS log_loss, n_val, round(prior, 6) AS prior, round(ratio, 6) AS ratio FROM g"),
        "gate_summary": gate_sql("SELECT symbol, count(*) AS folds, round(avg(log_loss), 6) AS mean_log_loss, round(avg(prior), 6) AS mean_prior, round(avg(log_loss) / avg(prior), 6) AS mean_ratio, round(median(ratio), 6) AS median_ratio, count(*) FILTER (ratio <= 0.98) AS folds_passed FROM g GROUP BY 1"),
    }

