"""SQL for the families and machines that rest on recurrences: recursion along each symbol's bars, then layers of windows."""

from __future__ import annotations

from tidebars.operators.levels import ANCHORS, PIVOTS, RETRACEMENTS
from tidebars.plans.sql import BAND_COLUMNS, BANDS, EVENT_BARS, PIVOT, WINDOWS, roll, same, shown

#: States in dependent levels: name: (value at the first bar, value at a later one); o_<name> is the state of the bar before.
Levels = list[dict[str, tuple[str, str]]]
NONE = "NULL::DOUBLE"


def ewm(name: str, x: str, alpha: float, first: str = NONE) -> dict[str, tuple[str, str]]:
    """Seeded by the first value that isn't NULL."""
    return {name: (first, f"CASE WHEN ({x}) IS NULL THEN o_{name} WHEN o_{name} IS NULL THEN ({x}) ELSE {alpha!r} * ({x}) + {1 - alpha!r} * o_{name} END")}


def span(n: int) -> float:
    return 2 / (n + 1)


def merged(*parts: dict) -> dict:
    return {k: v for p in parts for k, v in p.items()}


def walk(levels: Levels, finals: dict[str, str], source: str = EVENT_BARS) -> str:
    """b1: bars with the finals; b0 has the bars and what windows give of the bars before."""
    names = [n for level in levels for n in level]
    first, later = "SELECT * FROM b0 WHERE rn = 1", f"SELECT b.*, {', '.join(f'r.{n} AS o_{n}' for n in names)} FROM r JOIN b0 b ON b.symbol = r.symbol AND b.rn = r.rn + 1"
    for level in levels:
        first = f"SELECT *, {', '.join(f'({a})::DOUBLE AS {n}' for n, (a, _) in level.items())} FROM ({first})"
        later = f"SELECT *, {', '.join(f'({b})::DOUBLE AS {n}' for n, (_, b) in level.items())} FROM ({later})"
    bars = (
        f"SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph1, lag(low) OVER w AS pl1, lag(high, 2) OVER w AS ph2, lag(low, 2) OVER w AS pl2, abs(close - lag(close, 10) OVER w) AS net, max(high) OVER w22 AS hh22, min(low) OVER w22 AS ll22 FROM ({source}) {WINDOWS}"
    )
    bars = f"SELECT *, sum(abs(close - pc)) OVER w10 AS path FROM ({bars}) {WINDOWS}"
    cols = ", ".join(["symbol", "rn", *names])
    return (
        f"WITH RECURSIVE b0 AS MATERIALIZED ({bars}), r AS (SELECT {cols} FROM ({first}) UNION ALL SELECT {cols} FROM ({later})), "
        f"b1 AS MATERIALIZED (SELECT b.symbol, b.ts, b.rn, open, high, low, close, volume, {', '.join(f'{e} AS {n}' for n, e in finals.items())} FROM b0 b JOIN r ON r.symbol = b.symbol AND r.rn = b.rn)"
    )


def layered(head: str, *layers: str, after: int = 1) -> tuple[str, int]:
    """head with further common tables, b2, b3, ... after b1, and the last one's number."""
    return head + "".join(f", b{i + 1} AS (SELECT *, {more} FROM b{i} {WINDOWS})" for i, more in enumerate(layers, after)), after + len(layers)


TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
UP, DOWN = "greatest(close - pc, 0)", "greatest(pc - close, 0)"
RISE, FALL = "high - ph1", "pl1 - low"


def atr(name: str, n: int) -> dict:
    return ewm(name, TR, 1 / n, "high - low")


PSAR: Levels = [
    {"s0": (NONE, "CASE WHEN rn > 2 AND o_trend > 0 THEN least(o_stop + o_af * (o_ext - o_stop), pl1, pl2) WHEN rn > 2 THEN greatest(o_stop + o_af * (o_ext - o_stop), ph1, ph2) END")},
    {"turned": ("0", "CASE WHEN rn > 2 AND CASE WHEN o_trend > 0 THEN low < s0 ELSE high > s0 END THEN 1 ELSE 0 END")},
    {
        "trend": (NONE, "CASE WHEN rn = 2 THEN CASE WHEN high >= ph1 THEN 1 ELSE -1 END WHEN turned = 1 THEN -o_trend ELSE o_trend END"),
        "further": ("0", "CASE WHEN rn > 2 AND turned = 0 AND CASE WHEN o_trend > 0 THEN high > o_ext ELSE low < o_ext END THEN 1 ELSE 0 END"),
    },
    {
        "stop": (NONE, "CASE WHEN rn = 2 THEN CASE WHEN trend > 0 THEN pl1 ELSE ph1 END WHEN turned = 1 THEN o_ext ELSE s0 END"),
        "ext": (NONE, "CASE WHEN rn = 2 OR turned = 1 OR further = 1 THEN CASE WHEN trend > 0 THEN high ELSE low END ELSE o_ext END"),
        "af": ("0.02", "CASE WHEN rn = 2 OR turned = 1 THEN 0.02 WHEN further = 1 THEN least(o_af + 0.02, 0.2) ELSE o_af END"),
    },
]
PSAR_OUT = {"psar": "CASE WHEN b.rn >= 2 THEN stop END", "psar_trend": "CASE WHEN b.rn >= 2 THEN trend END"}
KAMA: Levels = [{"k": (NONE, f"CASE WHEN rn < 11 THEN NULL WHEN o_k IS NULL THEN close WHEN path <= 1e-9 THEN NULL ELSE o_k + (net / path * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}) ** 2 * (close - o_k) END")}]
TSI: Levels = [
    merged(ewm("ta", "close - pc", span(25)), ewm("tc", "abs(close - pc)", span(25))),
    merged(ewm("tb", "CASE WHEN rn >= 26 THEN ta END", span(13)), ewm("td", "CASE WHEN rn >= 26 THEN tc END", span(13))),
    ewm("tsig", "CASE WHEN rn >= 38 THEN 100 * tb / nullif(td, 0) END", span(7)),
]
TSI_OUT = {"tsi": "CASE WHEN b.rn >= 38 THEN 100 * tb / nullif(td, 0) END", "tsi_signal": "CASE WHEN b.rn >= 44 THEN tsig END"}


def joined(*each: Levels) -> Levels:
    depth = max(map(len, each))
    return [merged(*[x[i] for x in each if i < len(x)]) for i in range(depth)]


P3 = "(high + low + close) / 3"
SHARED: Levels = joined(
    [
        merged(*[ewm(f"e{n}", "close", span(n), "close") for n in (9, 12, 21, 26, 50)], ewm("up", UP, 1 / 14), ewm("dn", DOWN, 1 / 14), atr("a14", 14), atr("a5", 5)),
        ewm("sig", "CASE WHEN rn >= 26 THEN e12 - e26 END", span(9)),
    ],
    [
        merged(ewm("pu", f"CASE WHEN {RISE} > {FALL} AND {RISE} > 0 THEN {RISE} ELSE 0 END", 1 / 14, "0"), ewm("pd", f"CASE WHEN {FALL} > {RISE} AND {FALL} > 0 THEN {FALL} ELSE 0 END", 1 / 14, "0")),
        ewm("dx", "CASE WHEN rn >= 14 THEN 100 * abs(pu - pd) / nullif(pu + pd, 0) END", 1 / 14),
    ],
    [
        ewm("wm", P3, span(10), P3),
        ewm("wd", f"CASE WHEN rn >= 10 THEN abs({P3} - wm) END", span(10)),
        ewm("wo", f"CASE WHEN rn >= 19 THEN ({P3} - wm) / nullif(0.015 * wd, 0) END", span(21)),
    ],
    [{}, ewm("c2", "CASE WHEN rn >= 21 THEN e21 END", span(21)), ewm("c3", "CASE WHEN rn >= 41 THEN c2 END", span(21))],
    TSI, KAMA, PSAR,
)
SHARED_OUT = {
    "ema9": "CASE WHEN b.rn >= 9 THEN e9 END", "ema21": "CASE WHEN b.rn >= 21 THEN e21 END", "ema50": "CASE WHEN b.rn >= 50 THEN e50 END", "rsi_14": "CASE WHEN b.rn >= 15 AND dn <> 0 THEN 100 - 100 / (1 + up / dn) END",
    "macd_line": "CASE WHEN b.rn >= 26 THEN e12 - e26 END", "macd_signal": "CASE WHEN b.rn >= 34 THEN sig END", "di_plus": "CASE WHEN b.rn >= 14 THEN 100 * pu / nullif(a14, 0) END", "di_minus": "CASE WHEN b.rn >= 14 THEN 100 * pd / nullif(a14, 0) END",
    "adx": "CASE WHEN b.rn >= 27 THEN dx END", "wt1": "CASE WHEN b.rn >= 39 THEN wo END", "atr_14": "CASE WHEN b.rn >= 14 THEN a14 END", "atr_5": "CASE WHEN b.rn >= 5 THEN a5 END",
    "dema21": "CASE WHEN b.rn >= 41 THEN 2 * e21 - c2 END", "tema21": "CASE WHEN b.rn >= 61 THEN 3 * e21 - 3 * c2 + c3 END", "kama": "k",
} | TSI_OUT | PSAR_OUT


def shared() -> str:
    return walk(SHARED, SHARED_OUT)


def over(x: str, y: str | float) -> str:
    """x passes above y."""
    return f"coalesce(lag({x}) OVER w <= {y if isinstance(y, (int, float)) else f'lag({y}) OVER w'} AND {x} > {y}, false)"


def under(x: str, y: str | float) -> str:
    return f"coalesce(lag({x}) OVER w >= {y if isinstance(y, (int, float)) else f'lag({y}) OVER w'} AND {x} < {y}, false)"


def pct(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0) * 100"


def change(x: str, k: int = 1) -> str:
    return f"{x} - lag({x}, {k}) OVER w"


def zone(x: str, high: float, low: float) -> str:
    return f"CASE WHEN {x} > {high} THEN 1 WHEN {x} < {low} THEN -1 ELSE 0 END"


def since(cond: str) -> str:
    return f"rn - max(CASE WHEN {cond} THEN rn END) OVER s"


STATE = BAND_COLUMNS["squeeze_state"]
MOMENTUM_LAYERS = (
    *BANDS[:2],
    f"{BANDS[2]}, (CASE WHEN count(*) OVER w20 = 20 THEN (max(high) OVER w20 + min(low) OVER w20) / 2 END + mid) / 2 AS lifted, CASE WHEN count(*) OVER w14 = 14 THEN (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) * 100 END AS k0, macd_line - macd_signal AS macd_hist, rsi_14 - lag(rsi_14) OVER w AS rsi_slope",
    f"{STATE} AS squeeze_state, close - lifted AS lift, {roll('avg', 'k0', 3)} AS stoch_k, {roll('avg', 'wt1', 4)} AS wt2, {change('macd_hist')} AS macd_hist_slope, {change('macd_line')} AS dm, {change('wt1')} AS dw",
    f"CASE WHEN count(lift) OVER w20 = 20 THEN regr_intercept(lift, rn) OVER w20 + regr_slope(lift, rn) OVER w20 * rn END AS squeeze_value, {roll('avg', 'stoch_k', 3)} AS stoch_d, {change('stoch_k')} AS dk",
)


def momentum() -> str:
    head, last = layered(shared(), *MOMENTUM_LAYERS)
    ints = {
        "rsi_zone": zone("rsi_14", 70, 30), "wt_cross_signal": f"{over('wt1', 'wt2')}::INT - {under('wt1', 'wt2')}::INT", "wt_ob_os_zone": zone("wt1", 60, -60),
        "stoch_cross_signal": f"{over('stoch_k', 'stoch_d')}::INT - {under('stoch_k', 'stoch_d')}::INT", "stoch_ob_os_zone": zone("stoch_k", 80, 20), "squeeze_release_state": "squeeze_state",
        "bars_in_squeeze": "rn - coalesce(max(CASE WHEN squeeze_state <> -1 THEN rn END) OVER s, 0)", "rsi_wt_divergence_flag": "CASE WHEN rsi_14 IS NULL OR wt1 IS NULL THEN 1 ELSE (sign(rsi_14 - 50) <> sign(wt1))::INT END",
    }
    doubles = same("rsi_14", "rsi_slope", "macd_line", "macd_signal", "macd_hist", "macd_hist_slope", "wt1", "wt2", "stoch_k", "stoch_d", "squeeze_value") | {
        "rsi_dist_from_50": "rsi_14 - 50", "macd_zero_cross_state": "sign(macd_line)", "macd_hist_acceleration": change("macd_hist_slope"), "squeeze_signal": f"({change('squeeze_value', 5)}) / 5",
        **{f"roc_{n}bar": f"(close / nullif(lag(close, {n}) OVER w, 0) - 1) * 100" for n in (1, 3, 6, 12)},
        "macd_rsi_alignment": "sign(macd_hist) * sign(rsi_14 - 50)", "d2_rsi": change("rsi_slope"), "d2_macd_line": change("dm"), "d2_wt1": change("dw"), "d2_stoch_k": change("dk"),
    }
    return head + shown(ints | doubles, last, tuple(ints))


def trend() -> str:
    head, last = layered(shared(), f"{change('adx')} AS adx_slope")
    ints = {"adx_trending": "coalesce(adx > 25, false)", "adx_weak": "coalesce(adx < 20, false)", "adx_accelerating": "coalesce(adx_slope > 0.5, false)", "adx_decelerating": "coalesce(adx_slope < -0.5, false)"}
    doubles = same("di_plus", "di_minus", "adx", "adx_slope") | {f"ema{n}_dist_pct": pct(f"close - ema{n}", "close") for n in (9, 21, 50)} | {
        "di_spread": "di_plus - di_minus", "ema_stack_30m": "coalesce(sign(ema9 - ema21), 0) + coalesce(sign(ema21 - ema50), 0) + coalesce(sign(close - ema9), 0)", "ema21_dist_atr": "(close - ema21) / nullif(atr_14, 0)",
    }
    return head + shown(ints | doubles, last, tuple(ints))


def lagged() -> str:
    head, last = layered(shared(), f"{pct('close - ema21', 'close')} AS apart")
    return head + shown({"delta_rsi_1": change("rsi_14"), "delta_rsi_3": change("rsi_14", 3), "delta_adx_3": change("adx", 3), "delta_volume_3": pct(change("volume", 3), "lag(volume, 3) OVER w"), "delta_close_vs_ema21_3": change("apart", 3)}, last)


def more_momentum() -> str:
    head, last = layered(
        shared(), f"{P3} AS tp, close - lag(close) OVER w AS d, CASE WHEN count(*) OVER w14 = 14 THEN -(max(high) OVER w14 - close) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) * 100 END AS williams_r",
        f"CASE WHEN count(tp) OVER w20 = 20 THEN array_agg(tp) OVER w20 END AS tps, {roll('avg', 'tp', 20)} AS tpm, CASE WHEN count(d) OVER w14 = 14 THEN sum(greatest(d, 0)) OVER w14 END AS u, CASE WHEN count(d) OVER w14 = 14 THEN sum(greatest(-d, 0)) OVER w14 END AS dd",
        "(tp - tpm) / nullif(0.015 * list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 20, 0) AS cci_20, (u - dd) / nullif(u + dd, 0) * 100 AS cmo",
    )
    return head + shown({"williams_r_zone": zone("williams_r", -20, -80), **same("williams_r", "cci_20"), "cci_zero_cross_state": "sign(cci_20)", "cmo_zero_cross_state": "sign(cmo)", "tsi_signal_cross_state": "sign(tsi - tsi_signal)", "tsi_zero_cross_state": "sign(tsi)"}, last, ("williams_r_zone",))


def adaptive() -> str:
    return shared() + shown({f"{n}_dist_pct": pct(f"close - {x}", "close") for n, x in (("kama", "kama"), ("dema", "dema21"), ("tema", "tema21"), ("psar_state", "psar"))}, 1)


def rank(x: str) -> str:
    return f"len(list_filter(a_{x}, lambda x: x < {x})) + (len(list_filter(a_{x}, lambda x: x = {x})) + 1) / 2.0"


def regime() -> str:
    lists = ", ".join(f"CASE WHEN count({x}) OVER w100 = 100 THEN array_agg({x}) OVER w100 END AS a_{x}" for x in ("atr_14", "bw", "volume"))
    tercile = lambda x: f"CASE WHEN {x} < 33.33 THEN 0 WHEN {x} > 66.67 THEN 2 WHEN {x} IS NOT NULL THEN 1 END"
    head, last = layered(
        shared(), *BANDS[:1], "4 * sd / nullif(mid, 0) * 100 AS bw", lists, ", ".join(f"{rank(x)} AS k_{x}" for x in ("atr_14", "bw", "volume")),
        "coalesce(adx > 25 AND abs(di_plus - di_minus) > 10, false) AS t, coalesce(adx < 20 AND k_bw < 30, false) AS g", "CASE WHEN g THEN 4 WHEN t THEN 1 ELSE 0 END AS label", "coalesce(label = lag(label) OVER w, false) AS kept",
    )
    ints = {"trending_regime": "t", "ranging_regime": "g", "volatility_regime": tercile("k_atr_14"), "volume_regime": tercile("k_volume"), "trend_direction": "coalesce(ema9 > ema21 AND ema21 > ema50, false)::INT - coalesce(ema9 < ema21 AND ema21 < ema50, false)::INT", "regime_change_bar": f"{since('NOT kept')} + 1"}
    return head + shown(ints | {"vol_adjusted_momentum_regime": "(close / nullif(lag(close, 3) OVER w, 0) - 1) * 100 / nullif(atr_14 / nullif(close, 0) * 100, 0)"}, last, tuple(ints))


def pivot(x: str, agg: str, name: str) -> str:
    return f"CASE WHEN count({x}) OVER w5 = 5 AND lag({x}, 2) OVER w = {agg}({x}) OVER w5 THEN lag({x}, 2) OVER w END AS {name}"


def divergence(x: str, out: str) -> tuple[str, str, str]:
    """Three layers: swing points of close and x, those of the last swing of the close before, and the findings."""
    before = lambda p, o, b: f"last_value(CASE WHEN {p} IS NOT NULL THEN struct_pack(rn := rn, p := {p}, o := {o}) END IGNORE NULLS) OVER s1 AS {b}"
    high, low = f"{out}h", f"{out}l"
    near = lambda b: f"rn - {b}.rn <= 14"
    return (
        ", ".join([pivot("close", "max", f"{high}p"), pivot("close", "min", f"{low}p"), pivot(x, "max", f"{high}o"), pivot(x, "min", f"{low}o")]),
        f"{before(f'{high}p', f'{high}o', f'{high}b')}, {before(f'{low}p', f'{low}o', f'{low}b')}",
        f"CASE WHEN {near(f'{low}b')} AND {low}p < {low}b.p AND {low}o > {low}b.o THEN 1 WHEN {near(f'{high}b')} AND {high}p > {high}b.p AND {high}o < {high}b.o THEN -1 ELSE 0 END AS {out}_regular, "
        f"CASE WHEN {near(f'{low}b')} AND {low}p > {low}b.p AND {low}o < {low}b.o THEN 1 WHEN {near(f'{high}b')} AND {high}p < {high}b.p AND {high}o > {high}b.o THEN -1 ELSE 0 END AS {out}_hidden",
    )


def divergences() -> str:
    a, b = divergence("rsi_14", "dr"), divergence("macd_hist", "dx")
    head, last = layered(shared(), "macd_line - macd_signal AS macd_hist", *[f"{x}, {y}" for x, y in zip(a, b, strict=True)])
    ints = {
        "regular_bullish_div_rsi": "dr_regular > 0", "regular_bearish_div_rsi": "dr_regular < 0", "regular_bullish_div_macd": "dx_regular > 0", "regular_bearish_div_macd": "dx_regular < 0", "hidden_bullish_div_rsi": "dr_hidden > 0",
        "hidden_bearish_div_rsi": "dr_hidden < 0", "divergence_recency": since("dr_regular <> 0 OR dx_regular <> 0 OR dr_hidden <> 0"),
    }
    return head + shown(ints, last, tuple(ints))


BARE = f"WITH RECURSIVE b1 AS MATERIALIZED ({EVENT_BARS})"


def money_flow() -> str:
    d = divergence("ad", "da")
    head, last = layered(
        BARE, f"((close - low) - (high - close)) / nullif(high - low, 0) * volume AS f, {P3} AS tp", "CASE WHEN tp > lag(tp) OVER w THEN tp * volume ELSE 0 END AS u, CASE WHEN tp < lag(tp) OVER w THEN tp * volume ELSE 0 END AS v, CASE WHEN f IS NOT NULL THEN sum(f) OVER s END AS ad",
        f"{roll('sum', 'f', 20)} / nullif({roll('sum', 'volume', 20)}, 0) AS cmf_20, 100 - 100.0 / nullif(1 + {roll('sum', 'u', 14)} / nullif({roll('sum', 'v', 14)}, 0), 0) AS mfi_14", *d,
    )
    return head + shown(same("cmf_20", "mfi_14") | {"cmf_slope": change("cmf_20"), "mfi_zone": zone("mfi_14", 80, 20), "ad_slope_10": f"({change('ad', 10)}) / 10", "ad_price_divergence_flag": "da_regular"}, last, ("mfi_zone", "ad_price_divergence_flag"))


def volume() -> str:
    """The signal line is a recursion of its own, over the bars that have a flow."""
    d = divergence("obv", "dob")
    head, last = layered(
        BARE, f"{P3} AS tp, {roll('avg', 'volume', 20)} AS v20, {roll('stddev_pop', 'volume', 20)} AS vs, coalesce(sign(close - lag(close) OVER w), 0) * volume AS sv, {roll('avg', 'volume', 130)} AS mv, (close / nullif(lag(close) OVER w, 0) - 1) * volume AS rv",
        "ln(tp / nullif(lag(tp) OVER w, 0)) AS inter, tp - lag(tp) OVER w AS mf, lag(mv) OVER w AS ave, sum(sv) OVER s AS obv", f"0.2 * {roll('stddev_pop', 'inter', 30)} * close AS c0",
        "CASE WHEN ave IS NOT NULL THEN least(volume, ave * 2.5) END * CASE WHEN abs(mf) > c0 THEN sign(mf) ELSE 0 END AS flow", f"{roll('sum', 'flow', 130)} / nullif(ave, 0) AS raw", f"{roll('avg', 'raw', 3)} AS vfi", *d,
    )
    a = span(5)
    step = f"CASE WHEN b.vfi IS NULL THEN e.y WHEN e.y IS NULL THEN b.vfi ELSE {a!r} * b.vfi + {1 - a!r} * e.y END"
    head = head.replace(f", b{last} AS (", f", b{last} AS MATERIALIZED (")
    head += (
        f", e AS (SELECT symbol, rn, vfi AS y, (vfi IS NOT NULL)::INT AS n FROM b{last} WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {step}, e.n + (b.vfi IS NOT NULL)::INT FROM e JOIN b{last} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"
        f", b{last + 1} AS (SELECT b.*, CASE WHEN n >= 5 THEN y END AS vfi_signal FROM b{last} b JOIN e ON e.symbol = b.symbol AND e.rn = b.rn)"
    )
    place = "(close - low) / nullif(high - low, 0)"
    ints = {"volume_spike_flag": "coalesce(volume > 3 * v20, false)", "obv_divergence_flag": "dob_regular", "high_vol_close_top_tercile": f"coalesce(volume > 1.5 * v20 AND {place} >= 2.0 / 3, false)", "high_vol_close_bottom_tercile": f"coalesce(volume > 1.5 * v20 AND {place} <= 1.0 / 3, false)"}
    doubles = {
        "volume_ratio_20": "volume / nullif(v20, 0)", "volume_zscore_20": "(volume - v20) / nullif(vs, 0)", **same("vfi", "vfi_signal"), "vfi_hist_slope": "(vfi - vfi_signal) - (lag(vfi) OVER w - lag(vfi_signal) OVER w)", "obv_slope": f"({change('obv', 10)}) / 10",
        "candle_buy_sell_signed": f"{place} * sign(close - open)", "volume_weighted_momentum_10": f"{roll('sum', 'rv', 10)} / nullif({roll('sum', 'volume', 10)}, 0)",
    }
    return head + shown(ints | doubles, last + 1, tuple(ints))


COUNTS = {"higher_highs_count_20": "hh", "higher_lows_count_20": "hl", "lower_highs_count_20": "lh", "lower_lows_count_20": "ll", "fractal_pivot_count_20": "anyp"}


def structure() -> str:
    """Legs of the alternating swings by numbering changes of kind; each leg's extreme so far against the two legs before."""
    head, last = layered(
        BARE, f"{PIVOT['ph']}, {PIVOT['pl']}", "last_value(ph IGNORE NULLS) OVER s1 AS h1, last_value(pl IGNORE NULLS) OVER s1 AS l1",
        "coalesce(ph > h1, false)::INT AS hh, coalesce(pl > l1, false)::INT AS hl, coalesce(ph < h1, false)::INT AS lh, coalesce(pl < l1, false)::INT AS ll, (ph IS NOT NULL OR pl IS NOT NULL)::INT AS anyp, count(ph) OVER s >= 2 AND count(pl) OVER s >= 2 AS ready",
        "coalesce(last_value(CASE WHEN hh = 1 THEN 1 WHEN lh = 1 THEN 0 END IGNORE NULLS) OVER s, 0) AS u, coalesce(last_value(CASE WHEN hl = 1 THEN 1 WHEN ll = 1 THEN 0 END IGNORE NULLS) OVER s, 0) AS lo",
        "CASE WHEN ready AND u = 1 AND lo = 1 THEN 1 WHEN ready AND u = 0 AND lo = 0 THEN -1 ELSE 0 END AS st",
    )
    head += (
        f", p0 AS (SELECT symbol, rn, 0 AS ord, ph AS p FROM b{last} WHERE ph IS NOT NULL UNION ALL SELECT symbol, rn, 1, pl FROM b{last} WHERE pl IS NOT NULL), "
        "p1 AS (SELECT *, CASE WHEN ord <> lag(ord) OVER (PARTITION BY symbol ORDER BY rn, ord) THEN 1 ELSE 0 END AS turn FROM p0), p2 AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY rn, ord ROWS UNBOUNDED PRECEDING) AS leg FROM p1), "
        "p3 AS (SELECT *, CASE WHEN ord = 0 THEN max(p) OVER g ELSE min(p) OVER g END AS x FROM p2 WINDOW g AS (PARTITION BY symbol, leg ORDER BY rn, ord ROWS UNBOUNDED PRECEDING)), "
        "l0 AS (SELECT symbol, leg, last(x ORDER BY rn, ord) AS z FROM p3 GROUP BY 1, 2), l1 AS (SELECT symbol, leg, lag(z) OVER (PARTITION BY symbol ORDER BY leg) AS e1, lag(z, 2) OVER (PARTITION BY symbol ORDER BY leg) AS e2 FROM l0), "
        "q AS (SELECT symbol, rn, last(abs(x - e1) / nullif(abs(e1 - e2), 0) ORDER BY ord) AS ratio FROM p3 JOIN l1 USING (symbol, leg) GROUP BY 1, 2), "
        f"b{last + 1} AS (SELECT b.*, ratio FROM b{last} b LEFT JOIN q ON q.symbol = b.symbol AND q.rn = b.rn)"
    )
    was = "coalesce(lag(st) OVER w, 0)"
    ints = {"structure_type": "st", "break_of_structure": f"CASE WHEN st = 1 AND {was} = -1 THEN 1 WHEN st = -1 AND {was} = 1 THEN -1 ELSE 0 END"} | {n: roll("sum", x, 20) for n, x in COUNTS.items()}
    carried = lambda x: f"last_value({x} IGNORE NULLS) OVER s"
    return head + shown(ints | {"swing_high_dist_pct": pct(f"close - {carried('ph')}", "close"), "swing_low_dist_pct": pct(f"close - {carried('pl')}", "close"), "swing_length_ratio": carried("ratio")}, last + 1, tuple(ints))


def with_levels() -> str:
    """b2: the shared columns, and the levels d0 to d6 and w0 to w6 of the day and week before."""
    ends = "".join(
        f", e{k[0]} AS (SELECT symbol, {k}, lag(h) OVER v AS h{k[0]}, lag(l) OVER v AS l{k[0]}, lag(c) OVER v AS c{k[0]} FROM (SELECT symbol, {k}, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM k GROUP BY 1, 2) WINDOW v AS (PARTITION BY symbol ORDER BY {k}))"
        for k in ("dday", "wweek")
    )
    made = ", ".join(f"(h{k} + l{k} + c{k}) / 3 + {share!r} * (h{k} - l{k}) AS {k}{i}" for k in "dw" for i, share in enumerate(PIVOTS.values()))
    return (
        f"{shared()}, k AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS dday, date_trunc('week', ts)::TIMESTAMP AS wweek FROM b1){ends}, "
        f"b2 AS MATERIALIZED (SELECT k.*, {made} FROM k LEFT JOIN ed ON ed.symbol = k.symbol AND ed.dday = k.dday LEFT JOIN ew ON ew.symbol = k.symbol AND ew.wweek = k.wweek)"
    )


RUNGS = {k: [f"{k}{i}" for i in range(len(PIVOTS))] for k in "dw"}


def touched(k: str) -> str:
    return "(" + " OR ".join(f"coalesce(abs({x} - close) / nullif(close, 0) <= 0.0005, false)" for x in RUNGS[k]) + ")"


def running(x: str, key: str) -> str:
    return f"sum({x}) OVER (PARTITION BY symbol, {key} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def pivots() -> str:
    lines = [f"(sl + {f!r} * span)" for f in RETRACEMENTS]
    nearest = f"least({', '.join(f'abs({x} - close)' for x in lines)})"
    head, last = layered(
        with_levels(), f"{PIVOT['ph']}, {PIVOT['pl']}, {touched('d')}::INT AS td, {touched('w')}::INT AS tw", "last_value(ph IGNORE NULLS) OVER s AS sh, last_value(pl IGNORE NULLS) OVER s AS sl", "CASE WHEN sh <> sl THEN sh - sl END AS span",
        f"(close - sl) / nullif(span, 0) AS fib_retracement_pct, {nearest} AS nearest, coalesce(abs(close - {lines[0]}) <= 0.001 * close, false)::INT AS t382, coalesce(abs(close - {lines[2]}) <= 0.001 * close, false)::INT AS t618",
        f"CASE {' '.join(f'WHEN abs({x} - close) = nearest THEN {x}' for x in lines)} END AS fib", after=2,
    )
    ints, doubles = {}, {}
    for k, prefix, tested, period, key in (("d", "pivot", "pivot_times_tested_today", "daily", "dday"), ("w", "weekly_pivot", "weekly_pivot_times_tested_this_week", "weekly", "wweek")):
        r = RUNGS[k]
        doubles |= {f"{prefix}_{n}_dist_pct": pct(f"close - {x}", "close") for n, x in zip(PIVOTS, r, strict=True)}
        bands = " ".join(f"WHEN close >= {r[i]} AND close < {r[i + 1]} THEN {i}" for i in range(6))
        ints |= {f"{prefix}_zone": f"CASE WHEN {r[3]} IS NULL THEN NULL WHEN close <= {r[0]} THEN 0 WHEN close >= {r[6]} THEN 5 {bands} END", tested: running(f"t{k}", key)}
        doubles |= {f"pivot_position_{period}_01": f"(close - {r[2]}) / nullif({r[4]} - {r[2]}, 0)", "dist_to_nearest_pivot_atr" if k == "d" else "dist_to_nearest_weekly_pivot_atr": f"least({', '.join(f'abs({x} - close)' for x in r)}) / nullif(atr_14, 0)"}
    near = lambda pairs: " OR ".join(f"coalesce(abs({x} - {y}) <= 0.25 * atr_14, false)" for x, y in pairs)
    ints |= {
        "daily_pivot_weekly_pivot_confluence": near([(x, y) for x in ("d2", "d3", "d4") for y in RUNGS["w"]]), "in_golden_pocket": "coalesce(fib_retracement_pct >= 0.618 AND fib_retracement_pct <= 0.65, false)",
        "fib_touches_382": roll("sum", "t382", 20), "fib_touches_618": roll("sum", "t618", 20), "swing_fib_pivot_confluence": near([("fib", x) for x in RUNGS["d"] + RUNGS["w"]]),
    }
    doubles |= {"fib_retracement_pct": "fib_retracement_pct", "nearest_fib_level_dist": "nearest / nullif(atr_14, 0)", "extension_progress_1272": "(close - sl) / nullif(1.272 * span, 0)"}
    return head + shown(ints | doubles, last, tuple(ints))


def vwaps() -> str:
    keys = dict(zip(ANCHORS, ("dday", "wweek", "kh", "kl", "kp"), strict=True))
    v = [f"v_{a}" for a in ANCHORS]
    day = "(PARTITION BY symbol, dday ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    crossed = " OR ".join(f"{over('close', x)} OR {under('close', x)}" for x in v)
    head, last = layered(
        with_levels(),
        f"{PIVOT['ph']}, {PIVOT['pl']}, {P3} * volume AS tv, (coalesce(lag(close) OVER w <= d3 AND close > d3, false) OR coalesce(lag(close) OVER w >= d3 AND close < d3, false))::INT AS broke",
        "count(ph) OVER s AS kh, count(pl) OVER s AS kl, sum(broke) OVER s AS kp",
        ", ".join(f"{running('tv', k)} / nullif({running('volume', k)}, 0) AS v_{a}" for a, k in keys.items()) + f", CASE WHEN count(close) OVER {day} = 20 THEN stddev_pop(close) OVER {day} END AS sd",
        f"({' + '.join(f'coalesce({x}, 0)' for x in v)}) / nullif({' + '.join(f'({x} IS NOT NULL)::INT' for x in v)}, 0) AS vv, ({crossed})::INT AS crossing, {', '.join(f'coalesce(abs(close - {x}) <= 0.1 * atr_14, false)::INT AS n{x}' for x in v)}",
        ", ".join(f"coalesce({roll('sum', f'n{x}', 100)}, 0) AS m{x}" for x in v), f"greatest({', '.join(f'm{x}' for x in v)}) AS top", f"CASE {' '.join(f'WHEN m{x} = top THEN {x}' for x in v)} END AS heavy", after=2,
    )
    d = v[0]
    ints = {
        "daily_vwap_zone": f"CASE WHEN sd IS NULL THEN NULL WHEN close < {d} - 2 * sd THEN 0 WHEN close < {d} - sd THEN 1 WHEN close > {d} + 2 * sd THEN 4 WHEN close > {d} + sd THEN 3 ELSE 2 END",
        "multi_anchor_confluence_signed_count": " + ".join(f"coalesce(close > {x}, false)::INT - coalesce(close < {x}, false)::INT" for x in v), "vwap_cross_events_count_10": roll("sum", "crossing", 10),
    }
    doubles = {
        "daily_vwap": d, "daily_vwap_upper_band_1sig": f"{d} + sd", "daily_vwap_lower_band_1sig": f"{d} - sd", "daily_vwap_dist_pct": pct(f"close - {d}", "close"),
        **{f"{a}_vwap_pos": pct(f"close - v_{a}", "close") for a in ANCHORS[1:]}, "vwap_of_vwaps_mean_reversion_dist_pct": pct(f"close - {roll('avg', 'vv', 20)}", "close"),
        "dist_to_nearest_anchored_vwap_atr": f"least({', '.join(f'abs(close - {x})' for x in v)}) / nullif(atr_14, 0)", "close_above_below_heavy_vwap_flag": "CASE WHEN top > 0 THEN coalesce(sign(close - heavy), 0) ELSE 0 END",
    }
    return head + shown(ints | doubles, last, tuple(ints))


def memory() -> str:
    both = lambda x, y: f"({over(x, y)} OR {under(x, y)})"
    stay = "(PARTITION BY symbol, stay ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    head, last = layered(
        with_levels(), *MOMENTUM_LAYERS,
        f"{roll('avg', 'volume', 20)} AS v20, {PIVOT['ph']}, {PIVOT['pl']}, CASE WHEN rsi_14 IS NOT NULL THEN {zone('rsi_14', 70, 30)} END AS side, squeeze_state = -1 AND coalesce(lag(squeeze_state) OVER w, 0) <> -1 AS enter, {both('close', 'ema21')} AS x21, "
        f"{both('macd_line', 0)} AS xz, {both('macd_line', 'macd_signal')} AS xs, {both('rsi_14', 50)} AS x50, lag(adx) OVER w <= 25 AND adx > 25 AS strong, lag(adx) OVER w >= 15 AND adx < 15 AS weak",
        "last_value(ph IGNORE NULLS) OVER s1 AS h1, last_value(pl IGNORE NULLS) OVER s1 AS l1, last_value(side IGNORE NULLS) OVER s1 AS side0",
        "sum(CASE WHEN side IS NOT NULL AND coalesce(side0, 0) <> side THEN 1 ELSE 0 END) OVER s AS stay", f"CASE WHEN side = 1 THEN max(rsi_14 - 70) OVER {stay} WHEN side = -1 THEN max(30 - rsi_14) OVER {stay} END AS depth", after=2,
    )
    events = {
        "rsi_ob": "rsi_14 > 70", "rsi_os": "rsi_14 < 30", "rsi_mid_cross": "x50", "stoch_ob": "stoch_k > 80", "stoch_os": "stoch_k < 20", "wt_ob": "wt1 > 53", "wt_os": "wt1 < -53", "adx_trend_start": "strong", "adx_weak_start": "weak", "squeeze_fire": "squeeze_state = 1",
        "squeeze_entry": "enter", "volume_spike": "volume > 3 * v20", "last_hh": "ph > h1", "last_ll": "pl < l1", "pivot_touch_daily": touched("d"), "pivot_touch_weekly": touched("w"), "ema21_cross": "x21", "macd_zero_cross": "xz", "macd_signal_cross": "xs",
    }
    ints = {f"bars_since_{n}": since(e) for n, e in events.items()} | {"bars_in_current_rsi_episode": "rn - coalesce(max(CASE WHEN NOT coalesce(rsi_14 > 70 OR rsi_14 < 30, false) THEN rn END) OVER s, 0)"}
    doubles = {"last_rsi_extreme_depth": "last_value(depth IGNORE NULLS) OVER s", "squeeze_direction_at_fire": "last_value(CASE WHEN squeeze_state = 1 THEN sign(squeeze_value) END IGNORE NULLS) OVER s"}
    return head + shown(ints | doubles, last, tuple(ints))


def cross_asset() -> str:
    """The tables have fewer than 200 days, so no bar has a lead above or below its mean of 200; funding rates they have none."""
    pair = "r IS NOT NULL AND lr IS NOT NULL"
    head = shared() + ", b2 AS (SELECT b.*, o.close AS lc, o.atr_14 AS la FROM b1 b LEFT JOIN b1 o ON o.symbol = 'purchase' AND o.ts = b.ts)"
    head, last = layered(head, "close / nullif(lag(close) OVER w, 0) - 1 AS r, lc / nullif(lag(lc) OVER w, 0) - 1 AS lr", f"CASE WHEN {pair} THEN r END AS x, CASE WHEN {pair} THEN lr END AS y", after=2)
    doubles = {"lead_corr_20bar": "CASE WHEN count(x) OVER w20 = 20 THEN covar_pop(x, y) OVER w20 / nullif(stddev_pop(x) OVER w20 * stddev_pop(y) OVER w20, 0) END", **{f"lead_return_{n}bar": f"(lc / nullif(lag(lc, {n}) OVER w, 0) - 1) * 100" for n in (1, 3, 12)}}
    doubles |= {"lead_vs_asset_atr_norm_diff": "(lc - lag(lc) OVER w) / nullif(la, 0) - (close - lag(close) OVER w) / nullif(atr_14, 0)", "lead_funding_rate": NONE, "lead_above_ema200_daily": NONE}
    return head + shown(doubles, last)


def machine(levels: Levels, finals: dict[str, str]) -> str:
    return walk(levels, finals) + shown(same(*finals), 1)


MIDDLE = "(high + low) / 2"
SUPER: Levels = [
    atr("a", 10),
    {
        "sup": (NONE, f"CASE WHEN rn >= 10 THEN CASE WHEN o_sup IS NOT NULL AND pc > o_sup THEN greatest({MIDDLE} - 3 * a, o_sup) ELSE {MIDDLE} - 3 * a END END"),
        "sdown": (NONE, f"CASE WHEN rn >= 10 THEN CASE WHEN o_sdown IS NOT NULL AND pc < o_sdown THEN least({MIDDLE} + 3 * a, o_sdown) ELSE {MIDDLE} + 3 * a END END"),
        "dir": ("1", "CASE WHEN o_sup IS NULL THEN o_dir WHEN o_dir < 0 AND close > o_sdown THEN 1 WHEN o_dir > 0 AND close < o_sup THEN -1 ELSE o_dir END"),
    },
]
LONG, SHORT = "hh22 - 3 * a", "ll22 + 3 * a"
CHANDELIER: Levels = [
    atr("a", 22),
    {
        "lng": (NONE, f"CASE WHEN rn >= 22 THEN CASE WHEN pc > coalesce(o_lng, {LONG}) THEN greatest({LONG}, coalesce(o_lng, {LONG})) ELSE {LONG} END END"),
        "shrt": (NONE, f"CASE WHEN rn >= 22 THEN CASE WHEN pc < coalesce(o_shrt, {SHORT}) THEN least({SHORT}, coalesce(o_shrt, {SHORT})) ELSE {SHORT} END END"),
        "dir": ("1", f"CASE WHEN rn < 22 THEN o_dir WHEN close > coalesce(o_shrt, {SHORT}) THEN 1 WHEN close < coalesce(o_lng, {LONG}) THEN -1 ELSE o_dir END"),
    },
]
TRAIL: Levels = [
    atr("a", 10),
    {"stp": (NONE, "CASE WHEN rn < 10 THEN NULL WHEN o_stp IS NULL THEN close - a WHEN close > o_stp AND pc > o_stp THEN greatest(o_stp, close - a) WHEN close < o_stp AND pc < o_stp THEN least(o_stp, close + a) WHEN close > o_stp THEN close - a ELSE close + a END")},
    {"signal": ("0", "CASE WHEN o_stp IS NULL THEN 0 WHEN pc <= o_stp AND close > stp THEN 1 WHEN pc >= o_stp AND close < stp THEN -1 ELSE 0 END")},
]
CUSUM: Levels = [
    {"u0": ("0", "greatest(0, o_cu + (close - pc))"), "d0": ("0", "least(0, o_cd + (close - pc))")},
    {"event": ("0", "CASE WHEN u0 > 50 THEN 1 WHEN d0 < -50 THEN -1 ELSE 0 END"), "cu": ("0", "CASE WHEN u0 > 50 THEN 0 ELSE u0 END"), "cd": ("0", "CASE WHEN u0 <= 50 AND d0 < -50 THEN 0 ELSE d0 END")},
]
HEIKIN: Levels = [{"hc": ("(open + high + low + close) / 4", "(open + high + low + close) / 4"), "ho": ("(open + close) / 2", "(o_ho + o_hc) / 2")}]
MCGINLEY: Levels = [{"y": ("close", "CASE WHEN o_y = 0 THEN close WHEN abs(close / o_y) > 1e-3 THEN o_y + (close - o_y) / (14 * ((close / o_y) * (close / o_y) * (close / o_y) * (close / o_y))) ELSE o_y END")}]


def oracle_sql() -> dict[str, str]:
    return {
        "features_momentum": momentum(), "features_trend": trend(), "features_lagged": lagged(), "features_more_momentum": more_momentum(), "features_adaptive": adaptive(), "features_regime": regime(), "features_divergences": divergences(),
        "features_money_flow": money_flow(), "features_volume": volume(), "features_structure": structure(), "features_pivots": pivots(), "features_vwap": vwaps(), "features_memory": memory(), "features_cross_asset": cross_asset(),
        "trail_psar": machine(PSAR, PSAR_OUT), "kama": machine(KAMA, {"kama": "k"}), "tsi": machine(TSI, TSI_OUT), "cusum_events": machine(CUSUM, {"event": "event"}), "mcginley": machine(MCGINLEY, {"mcginley": "y"}),
        "heikin_ashi": machine(HEIKIN, {"ha_open": "ho", "ha_high": "greatest(high, ho, hc)", "ha_low": "least(low, ho, hc)", "ha_close": "hc"}),
        "trail_supertrend": machine(SUPER, {"supertrend": "CASE WHEN dir > 0 THEN sup ELSE sdown END", "direction": "CASE WHEN b.rn >= 10 THEN dir END"}),
        "trail_chandelier": machine(CHANDELIER, {"long_stop": "lng", "short_stop": "shrt", "direction": "CASE WHEN b.rn >= 22 THEN dir END"}),
        "trail_stop": machine(TRAIL, {"stop": "stp", "signal": "CASE WHEN b.rn >= 10 THEN signal END"}),
    }
