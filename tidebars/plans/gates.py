"""Queries of labels with each symbol's own parameters and of the learned gate, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import rolling as R
from tidebars.functions.nulls import pct, safe_div
from tidebars.operators import boosting, calibration, gate, labels, oscillators, timeframes
from tidebars.operators import recurrence as S
from tidebars.plans.matrix import finished
from tidebars.plans.oracles import DOWN, FALL, RISE, SHARED_OUT, UP, atr, ewm, joined, merged, span, walk
from tidebars.plans.sql import BARRIER_CTE, BANDS, LINE_BARS, ORDER_BARS, fold_parts, shown, steps, walk_sql
from tidebars.sources import bars as B

C = F.col
#: Ranges to either barrier, least move and quiet range in percent, of the leading symbol and of the others: fixed values.
LEADING = (2.4, 0.3, 0.275)
OTHERS = (2.7, 0.4, 0.6)
LEAD = "purchase"
FEATURES = ["position", "range_share", "move_1", "move_5", "volume_ratio"]


def own(k: int) -> Column:
    return F.when(C("symbol") == LEAD, LEADING[k]).otherwise(OTHERS[k])


def labels_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the true range mean, on bars without the warm-up, with each symbol's own parameters; unlabelled tails are left out."""
    bars = labels.trim(S.scan(B.event_bars(spark, sf_dir), [S.Scan(("atr_14",), S.Atr)]))
    made = labels.triple_barrier(bars, up=own(0), down=own(0), least_pct=own(1), quiet_pct=own(2))
    return finished(made.where(C("label") != labels.NONE), ["label", "holding_bars", "exit_price", "pnl_pct"])


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold rows of daily bars of orders and lines, with labels and features."""
    bars = B.order_bars(spark, sf_dir).unionByName(B.line_bars(spark, sf_dir))
    c = C("close")
    df = oscillators.squeeze(bars).withColumns({
        "position": safe_div(c - R.mean("close", 20), R.deviation("close", 20)), "range_share": safe_div(C("_tr20"), c), "move_1": safe_div(R.change("close"), R.prev("close")),
        "move_5": safe_div(R.change("close", 5), R.prev("close", 5)), "volume_ratio": safe_div(C("volume"), R.mean("volume", 20)),
    })
    df = labels.triple_barrier(df, atr="_tr20", quiet_pct=0.5).select("symbol", "ts", "label", *FEATURES)
    return labels.fold_rows(df, labels.folds(bars))


def gate_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold rows with features between -1 and 1, counted and summed by fold and part."""
    rows = calibration.scaled(gate.known(gate_rows(spark, sf_dir), FEATURES), FEATURES)
    return rounded(rows.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), *[f(n).alias(f"{k}_{n}") for n in FEATURES for k, f in (("least", F.min), ("most", F.max), ("mean", F.avg))]))


def gate_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate model's odds of a rise, calibrated on the earlier half of each validation month and judged on the later."""
    return rounded(calibration.calibrated(calibration.halves(calibration.odds(gate_rows(spark, sf_dir), FEATURES))), 5)


#: The five features of the first gate: fixed names.
FIVE = ["ema21_dist_pct", "rsi_14", "adx", "htf_ema21_pos", "volume_ratio_20"]
WEEK = 7 * 86400
TREES = boosting.Plan()


def five_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold rows of daily bars of orders and lines with the five features; the coarser frame of a day is the last week before that has bars."""
    bars = B.order_bars(spark, sf_dir).unionByName(B.line_bars(spark, sf_dir))
    c = C("close")
    week = S.scan(B.resample(bars, WEEK, fill=False), [S.ema("_e21", 21)]).withColumn("htf_ema21_pos", pct(c - C("_e21"), c))
    df = S.scan(timeframes.join_closed(bars, week, WEEK, ["htf_ema21_pos"]), [S.ema("_e21", 21), S.Scan(("rsi_14",), S.Rsi), S.Scan(("_p", "_n", "adx"), S.Adx)])
    df = oscillators.squeeze(df).withColumns({"ema21_dist_pct": pct(c - C("_e21"), c), "volume_ratio_20": safe_div(C("volume"), R.mean("volume", 20))})
    df = labels.triple_barrier(df, atr="_tr20", quiet_pct=0.5).select("symbol", "ts", "label", *[F.round(f, 9).alias(f) for f in FIVE])
    return labels.fold_rows(df, labels.folds(df))


FIRST = boosting.Plan(rounds=5)


def boosted_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's validation loss after each of the first trees (0: class shares of training rows)."""
    made = boosting.boosted(five_rows(spark, sf_dir), FIVE, plan=FIRST)
    return rounded(made.select("symbol", "fold", "n_val", F.posexplode("losses").alias("round", "loss")).withColumn("loss", C("loss") / boosting.LOSS_UNIT / C("n_val")))


def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five features by gain."""
    return rounded(boosting.gain(boosting.boosted(five_rows(spark, sf_dir), FIVE, plan=TREES), FIVE))


def boosted_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of boosted trees in every fold."""
    return rounded(boosting.boosted_gate(five_rows(spark, sf_dir), FIVE, plan=TREES))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else C(n) for n, t in df.dtypes])


def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.model_gate(gate_rows(spark, sf_dir), FEATURES))


def gate_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.importance(gate_rows(spark, sf_dir), FEATURES))


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.decision(labels.gate_summary(gate.model_gate(gate_rows(spark, sf_dir), FEATURES)), "ORDERS")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (labels_full, model_gate, gate_importance, gate_decision, boosted_gate, boosted_rounds, boosted_importance, gate_scaled, gate_calibrated)}


def labels_sql() -> str:
    k = lambda i: f"CASE WHEN symbol = '{LEAD}' THEN {LEADING[i]} ELSE {OTHERS[i]} END"
    return (
        f"{walk_sql()}, c AS (SELECT *, atr_14 * {k(0)} AS reach, {k(1)} AS least_move, {k(2)} AS quiet_range FROM b1 WHERE rn > 150), "
        "h AS (SELECT c.symbol, c.rn, min(CASE WHEN n.high >= c.close + c.reach THEN n.rn - c.rn END) AS iu, min(CASE WHEN n.low <= c.close - c.reach THEN n.rn - c.rn END) AS id, count(n.rn) AS ahead, max(CASE WHEN n.rn = c.rn + 12 THEN n.close END) AS last "
        "FROM c LEFT JOIN b0 n ON n.symbol = c.symbol AND n.rn BETWEEN c.rn + 1 AND c.rn + 12 GROUP BY 1, 2), "
        "k AS (SELECT c.*, iu, id, last, atr_14 IS NULL OR atr_14 <= 0 AS unknown, coalesce(atr_14 / nullif(close, 0) * 100 < quiet_range, false) AS quiet, coalesce(iu < coalesce(id, 99), false) AS rises, coalesce(id <= coalesce(iu, 99), false) AS falls, (last - close) / nullif(close, 0) * 100 AS ret FROM c JOIN h ON h.symbol = c.symbol AND h.rn = c.rn WHERE ahead = 12), "
        "b2 AS (SELECT *, CASE WHEN unknown THEN 2 WHEN quiet THEN -2 WHEN rises THEN 0 WHEN falls THEN 1 WHEN ret > least_move THEN 0 WHEN ret < -least_move THEN 1 ELSE 2 END AS label, CASE WHEN unknown OR quiet THEN 12 WHEN rises THEN iu WHEN falls THEN id ELSE 12 END AS holding_bars, "
        "CASE WHEN unknown OR quiet THEN NULL WHEN rises THEN close + reach WHEN falls THEN close - reach ELSE last END AS exit_price FROM k)"
    ) + shown({"label": "label", "holding_bars": "holding_bars", "exit_price": "exit_price", "pnl_pct": "(exit_price - close) / nullif(close, 0) * 100"}, 2, ("label", "holding_bars"))


def learned_sql() -> str:
    w = "(PARTITION BY symbol ORDER BY ts)"
    made = (
        f"(close - mid) / nullif(sd, 0) AS position, tr20 / nullif(close, 0) AS range_share, close / nullif(lag(close) OVER {w}, 0) - 1 AS move_1, close / nullif(lag(close, 5) OVER {w}, 0) - 1 AS move_5, "
        "CASE WHEN rn >= 20 THEN volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), 0) END AS volume_ratio"
    )
    moments = ", ".join(f"avg({f}) AS m_{f}, greatest(var_pop({f}), 1e-12) AS v_{f}" for f in FEATURES)
    height = " + ".join(f"ln(v_{f}) + ({f} - m_{f}) ** 2 / v_{f}" for f in FEATURES)
    return (
        f"{steps(f'{ORDER_BARS} UNION ALL {LINE_BARS}', *BANDS[:2])}, {BARRIER_CTE}, fe AS (SELECT symbol, ts, label, {made} FROM b3), {fold_parts('fe')}, kn AS (SELECT * FROM p WHERE label IN (0, 1, 2) AND {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}), "
        f"m AS (SELECT symbol, fold, label AS k, count(*) AS n, {moments} FROM kn WHERE part = 'train' GROUP BY 1, 2, 3), s AS (SELECT kn.symbol, kn.fold, kn.ts, kn.label, m.k, ln(n) - ({height}) / 2 AS l FROM kn JOIN m ON m.symbol = kn.symbol AND m.fold = kn.fold WHERE part = 'val'), "
        "ch AS (SELECT symbol, fold, ts, label, coalesce(sum(exp(l - top)) FILTER (k = label), 0) / sum(exp(l - top)) AS chance FROM (SELECT *, max(l) OVER (PARTITION BY symbol, fold, ts) AS top FROM s) GROUP BY ALL), "
        "v AS (SELECT symbol, fold, -avg(ln(least(greatest(chance, 1e-15), 1 - 1e-15))) AS log_loss, count(*) AS n_val FROM ch GROUP BY 1, 2), q AS (SELECT symbol, fold, label, count(*) AS n FROM kn WHERE part = 'val' GROUP BY ALL), "
        "pr AS (SELECT symbol, fold, -sum(n / a * ln(n / a)) AS prior FROM (SELECT *, sum(n) OVER (PARTITION BY symbol, fold) AS a FROM q) GROUP BY 1, 2), g AS (SELECT v.symbol, v.fold, log_loss, n_val, prior, log_loss / nullif(prior, 0) AS ratio FROM v JOIN pr ON pr.symbol = v.symbol AND pr.fold = v.fold)"
    )


def five_sql() -> str:
    """p: fold rows with labels and the five features."""
    bars = f"{ORDER_BARS} UNION ALL {LINE_BARS}"
    move = joined([merged(ewm("e21", "close", span(21), "close"), ewm("up", UP, 1 / 14), ewm("dn", DOWN, 1 / 14), atr("a14", 14))], [
        merged(ewm("pu", f"CASE WHEN {RISE} > {FALL} AND {RISE} > 0 THEN {RISE} ELSE 0 END", 1 / 14, "0"), ewm("pd", f"CASE WHEN {FALL} > {RISE} AND {FALL} > 0 THEN {FALL} ELSE 0 END", 1 / 14, "0")),
        ewm("dx", "CASE WHEN rn >= 14 THEN 100 * abs(pu - pd) / nullif(pu + pd, 0) END", 1 / 14),
    ])
    daily = walk(move, {n: SHARED_OUT[n] for n in ("ema21", "rsi_14", "adx")}, bars)
    bucket = f"make_timestamp((epoch(ts)::BIGINT // {WEEK}) * {WEEK} * 1000000)"
    weeks = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM (SELECT symbol, {bucket} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({bars}) GROUP BY 1, 2)"
    weekly = walk([ewm("e21", "close", span(21), "close")], {"ema21": SHARED_OUT["ema21"]}, weeks)
    made = (
        "round((b.close - d.ema21) / nullif(b.close, 0) * 100, 9) AS ema21_dist_pct, round(d.rsi_14, 9) AS rsi_14, round(d.adx, 9) AS adx, round(wk.pos, 9) AS htf_ema21_pos, "
        "round(CASE WHEN b.rn >= 20 THEN b.volume / nullif(avg(b.volume) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 19 PRECEDING), 0) END, 9) AS volume_ratio_20"
    )
    return (
        f"{steps(bars, *BANDS[:2])}, {BARRIER_CTE}, d AS ({daily} SELECT * FROM b1), wk AS ({weekly} SELECT symbol, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS ts, (close - ema21) / nullif(close, 0) * 100 AS pos FROM b1), "
        f"fe AS (SELECT b.symbol, b.ts, b.label, {made} FROM b3 b JOIN d ON d.symbol = b.symbol AND d.ts = b.ts LEFT JOIN wk ON wk.symbol = b.symbol AND wk.ts = make_timestamp((epoch(b.ts)::BIGINT // {WEEK}) * {WEEK} * 1000000)), {fold_parts('fe')}, "
        f"kn AS MATERIALIZED (SELECT * FROM p WHERE label IN (0, 1, 2) AND {' AND '.join(f'{f} IS NOT NULL' for f in FIVE)})"
    )


def rounds_sql(plan: boosting.Plan = FIRST) -> str:
    """Boosting by recursion: a step is a level of all folds' trees, over all rows."""
    n, depth = plan.bins, plan.depth
    long = " UNION ALL ".join(f"SELECT symbol, fold, {i} AS f, {f} AS x FROM kn WHERE part = 'train'" for i, f in enumerate(FIVE))
    bin_of = ", ".join(f"coalesce(len(list_filter(c.c{i}, lambda e: e < kn.{f})), 0) AS b{i}" for i, f in enumerate(FIVE))
    cuts = ", ".join(f"max(cuts) FILTER (f = {i}) AS c{i}" for i in range(len(FIVE)))
    top = "greatest(s0, s1, s2)"
    chance = [f"exp(s{k} - {top}) / (exp(s0 - {top}) + exp(s1 - {top}) + exp(s2 - {top}))" for k in range(3)]
    grads = ", ".join(f"round_even((p{k} - CASE WHEN label = {k} THEN 1 ELSE 0 END) * {boosting.UNIT!r}, 0)::BIGINT AS g{k}, round_even(1.5::DOUBLE * p{k} * (1 - p{k}) * {boosting.UNIT!r}, 0)::BIGINT AS h{k}" for k in range(3))
    each = " UNION ALL ".join(f"SELECT symbol, fold, lv, {k} AS k, n{k} AS node, {i} AS f, b{i} AS bin, g{k} AS g, h{k} AS h FROM gr WHERE part = 'train'" for k in range(3) for i in range(len(FIVE)))
    w = "(PARTITION BY symbol, fold, k, node, f ORDER BY bin)"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE * {a}::DOUBLE / {b}::DOUBLE ELSE 0 END"
    able = f"gi > 0 AND nl >= {plan.least_rows} AND nw - nl >= {plan.least_rows} AND hl >= {plan.least_curve * boosting.UNIT!r} AND hw - hl >= {plan.least_curve * boosting.UNIT!r}"
    leaf = lambda g, h: f"CASE WHEN {h} > 0 THEN {-plan.rate!r}::DOUBLE * ({g}::DOUBLE / {h}::DOUBLE) ELSE 0 END"
    went = [f"(t{k}.f >= 0 AND list_extract([{', '.join(f'st.b{i}' for i in range(len(FIVE)))}], t{k}.f + 1) > t{k}.edge)" for k in range(3)]
    last = f"st.lv = {depth - 1}"
    moved = ", ".join(f"CASE WHEN {last} THEN st.s{k} + CASE WHEN {went[k]} THEN t{k}.vr ELSE t{k}.vl END ELSE st.s{k} END AS s{k}" for k in range(3))
    nodes = ", ".join(f"CASE WHEN {last} THEN 0 ELSE 2 * st.n{k} + CASE WHEN {went[k]} THEN 1 ELSE 0 END END AS n{k}" for k in range(3))
    joins = " ".join(f"JOIN tr t{k} ON t{k}.symbol = st.symbol AND t{k}.fold = st.fold AND t{k}.k = {k} AND t{k}.node = st.n{k}" for k in range(3))
    fixed = "symbol, fold, ts, part, label, " + ", ".join(f"b{i}" for i in range(len(FIVE)))
    return (
        f"{five_sql()}, lo AS ({long}), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold, f ORDER BY x) AS r, count(*) OVER (PARTITION BY symbol, fold, f) AS n FROM lo), "
        f"ct AS (SELECT symbol, fold, f, list_sort(list_distinct(list(x))) AS cuts FROM rk WHERE r < n AND (r * {n}) // n > ((r - 1) * {n}) // n GROUP BY 1, 2, 3), cw AS (SELECT symbol, fold, {cuts} FROM ct GROUP BY 1, 2), "
        "sh AS (SELECT symbol, fold, count(*) FILTER (part = 'train') AS n, count(*) FILTER (part = 'val') AS n_val, " + ", ".join(f"count(*) FILTER (part = 'train' AND label = {k}) AS c{k}" for k in range(3)) + " FROM kn GROUP BY 1, 2), "
        f"st AS (SELECT kn.symbol, kn.fold, kn.ts, part, label, {bin_of}, " + ", ".join(f"ln(greatest(sh.c{k}::DOUBLE / sh.n, 1e-15)) AS s{k}" for k in range(3)) + ", 0 AS n0, 0 AS n1, 0 AS n2, 0 AS lv, 0 AS round "
        "FROM kn JOIN sh ON sh.symbol = kn.symbol AND sh.fold = kn.fold LEFT JOIN cw c ON c.symbol = kn.symbol AND c.fold = kn.fold WHERE sh.n > 0 AND n_val > 0 UNION ALL "
        f"(WITH pr AS (SELECT *, {', '.join(f'{c} AS p{k}' for k, c in enumerate(chance))} FROM st WHERE round < {plan.rounds}), gr AS (SELECT *, {grads} FROM pr), "
        f"hi AS (SELECT symbol, fold, k, node, f, bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h, count(*) AS n FROM ({each}) GROUP BY ALL), "
        f"cu AS (SELECT *, (sum(g) OVER {w})::BIGINT AS gl, (sum(h) OVER {w})::BIGINT AS hl, (sum(n) OVER {w})::BIGINT AS nl, (sum(g) OVER (PARTITION BY symbol, fold, k, node, f))::BIGINT AS gw, (sum(h) OVER (PARTITION BY symbol, fold, k, node, f))::BIGINT AS hw, (sum(n) OVER (PARTITION BY symbol, fold, k, node, f))::BIGINT AS nw FROM hi), "
        f"ga AS (SELECT *, {ratio('gl', 'hl')} + {ratio('(gw - gl)', '(hw - hl)')} - {ratio('gw', 'hw')} AS gi FROM cu), "
        f"be AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold, k, node ORDER BY coalesce({able}, false) DESC, CASE WHEN {able} THEN gi END DESC, f, bin) AS best, coalesce({able}, false) AS cut FROM ga), "
        f"tr AS (SELECT symbol, fold, k, node, CASE WHEN cut THEN f ELSE -1 END AS f, bin AS edge, {leaf('CASE WHEN cut THEN gl ELSE gw END', 'CASE WHEN cut THEN hl ELSE hw END')} AS vl, {leaf('(gw - gl)', '(hw - hl)')} AS vr FROM be WHERE best = 1) "
        f"SELECT {', '.join('st.' + c.strip() for c in fixed.split(','))}, {moved}, {nodes}, CASE WHEN {last} THEN 0 ELSE st.lv + 1 END AS lv, CASE WHEN {last} THEN st.round + 1 ELSE st.round END AS round FROM st {joins} WHERE st.round < {plan.rounds})), "
        f"ls AS (SELECT symbol, fold, round, label, {', '.join(f'{c} AS p{k}' for k, c in enumerate(chance))} FROM st WHERE part = 'val' AND lv = 0) "
        f"SELECT symbol, fold, count(*) AS n_val, round, round(sum(-ln(least(greatest(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15), 1 - 1e-15))) / count(*), 6) AS loss FROM ls GROUP BY 1, 2, 4"
    )


def scaled_sql() -> str:
    ends = ", ".join(f"min({f}) FILTER (part = 'train') OVER (PARTITION BY symbol, fold) AS a_{f}, max({f}) FILTER (part = 'train') OVER (PARTITION BY symbol, fold) AS b_{f}" for f in FEATURES)
    at = ", ".join(f"2 * ({f} - a_{f}) / nullif(b_{f} - a_{f}, 0) - 1 AS x_{f}" for f in FEATURES)
    told = ", ".join(f"round({g}(x_{f}), 6) AS {k}_{f}" for f in FEATURES for k, g in (("least", "min"), ("most", "max"), ("mean", "avg")))
    return f"{learned_sql()}, e1 AS (SELECT *, {ends} FROM kn), e2 AS (SELECT *, {at} FROM e1) SELECT symbol, fold, part, count(*) AS n, {told} FROM e2 GROUP BY 1, 2, 3"


def calibrated_sql(steps: int = 12) -> str:
    p = lambda a, b, s="score": f"(1 / (1 + exp(-({a} * {s} + {b}))))"
    loss = lambda x: f"-avg(ln(least(greatest(CASE WHEN rose = 1 THEN {x} ELSE 1 - {x} END, 1e-15), 1 - 1e-15)))"
    r, longest = calibration.RIDGE, calibration.LONGEST
    grid = ", ".join(f"{t!r}::DOUBLE" for t in calibration.GRID)
    return (
        f"{learned_sql()}, lo AS (SELECT symbol, fold, ts, max(label) AS label, sum(exp(l - top)) FILTER (k = 0) / sum(exp(l - top)) AS chance FROM (SELECT *, max(l) OVER (PARTITION BY symbol, fold, ts) AS top FROM s) GROUP BY 1, 2, 3), "
        "sc AS (SELECT symbol, fold, ts, (label = 0)::INT AS rose, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, ln(greatest(coalesce(chance, 0), 1e-15) / greatest(1 - coalesce(chance, 0), 1e-15)))) AS score FROM lo), "
        "hf AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY ts) * 2 <= count(*) OVER (PARTITION BY symbol, fold) AS early FROM sc), "
        "nn AS (SELECT symbol, fold, sum(rose) AS ones, count(*) AS n FROM hf WHERE early GROUP BY 1, 2), "
        "er AS MATERIALIZED (SELECT hf.*, CASE WHEN rose = 1 THEN (ones + 1) / (ones + 2) ELSE 1 / (n - ones + 2) END AS t FROM hf JOIN nn ON nn.symbol = hf.symbol AND nn.fold = hf.fold WHERE early), "
        "nw AS (SELECT symbol, fold, 0 AS it, 0.0::DOUBLE AS a, ln((ones + 1)::DOUBLE / (n - ones + 1)) AS b FROM nn UNION ALL "
        f"SELECT symbol, fold, it + 1, a + least(1.0, {longest!r} / greatest(abs(da), abs(db), 1e-300)) * da, b + least(1.0, {longest!r} / greatest(abs(da), abs(db), 1e-300)) * db FROM ("
        f"SELECT *, (w * g - s * h) / (ss * w - s * s) AS da, (ss * h - s * g) / (ss * w - s * s) AS db FROM ("
        f"SELECT er.symbol, er.fold, it, a, b, sum((t - {p('a', 'b')}) * score) AS g, sum(t - {p('a', 'b')}) AS h, sum({p('a', 'b')} * (1 - {p('a', 'b')}) * score * score) + {r!r} AS ss, sum({p('a', 'b')} * (1 - {p('a', 'b')}) * score) AS s, sum({p('a', 'b')} * (1 - {p('a', 'b')})) + {r!r} AS w "
        f"FROM nw JOIN er ON er.symbol = nw.symbol AND er.fold = nw.fold WHERE it < {steps} GROUP BY ALL))), "
        f"tp AS (SELECT hf.*, a, b, {p('a', 'b')} AS p FROM hf JOIN nw ON nw.symbol = hf.symbol AND nw.fold = hf.fold AND it = {steps}), "
        f"gr AS (SELECT symbol, fold, t, count(*) FILTER (p >= t AND rose = 1) AS hit, count(*) FILTER (p >= t OR rose = 1) AS every FROM (SELECT *, unnest([{grid}]) AS t FROM tp WHERE early) GROUP BY 1, 2, 3), "
        "th AS (SELECT symbol, fold, t AS threshold FROM gr QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY round(CASE WHEN every > 0 THEN 2 * hit / (hit + every) ELSE 0 END, 12) DESC, t) = 1) "
        f"SELECT tp.symbol, tp.fold, round(a, 5) AS a, round(b, 5) AS b, threshold, round({loss(p('1.0', '0.0'))}, 5) AS raw_loss, round({loss('p')}, 5) AS loss, count(*) AS n, count(*) FILTER (p >= threshold) AS signals, count(*) FILTER (p >= threshold AND rose = 1) AS hits "
        "FROM tp JOIN th ON th.symbol = tp.symbol AND th.fold = tp.fold WHERE NOT early GROUP BY tp.symbol, tp.fold, a, b, threshold"
    )


def oracle_sql() -> dict[str, str]:
    each = " UNION ALL ".join(f"SELECT symbol, fold, '{f}' AS feature, label, {f} AS x FROM kn WHERE part = 'train'" for f in FEATURES)
    return {
        "labels_full": labels_sql(),
        "boosted_rounds": rounds_sql(),
        "gate_scaled": scaled_sql(),
        "gate_calibrated": calibrated_sql(),
        "model_gate": learned_sql() + " SELECT symbol, fold, round(log_loss, 6) AS log_loss, n_val, round(prior, 6) AS prior, round(ratio, 6) AS ratio FROM g",
        "gate_importance": learned_sql() + f", u AS ({each}), t AS (SELECT symbol, fold, feature, avg(x) AS a, sum(x * x) - sum(x) ** 2 / count(*) AS total FROM u GROUP BY 1, 2, 3), c AS (SELECT symbol, fold, feature, label, count(*) AS n, avg(x) AS m FROM u GROUP BY 1, 2, 3, 4), "
        "z AS (SELECT c.symbol, c.fold, c.feature, sum(n * (m - a) ** 2) / nullif(max(total), 0) AS share FROM c JOIN t ON t.symbol = c.symbol AND t.fold = c.fold AND t.feature = c.feature GROUP BY 1, 2, 3), y AS (SELECT symbol, feature, avg(share) AS gain FROM z GROUP BY 1, 2) "
        "SELECT symbol, feature, round(gain, 6) AS gain, (row_number() OVER (PARTITION BY symbol ORDER BY gain DESC, feature))::INT AS place FROM y",
        "gate_decision": learned_sql() + ", d AS (SELECT symbol, avg(log_loss) / avg(prior) <= 0.98 AS ok FROM g GROUP BY 1), d2 AS (SELECT count(*) FILTER (ok AND symbol = 'ORDERS') AS a, count(*) FILTER (ok AND symbol <> 'ORDERS') AS o, count(*) FILTER (symbol <> 'ORDERS') AS n FROM d) "
        "SELECT CASE WHEN a > 0 AND o = n THEN 'a' WHEN a > 0 THEN 'd' WHEN o > 0 THEN 'b' ELSE 'c' END AS tier, a::INT AS anchor_passed, o AS others_passed, n AS others FROM d2",
    }
