"""The query of the tick machine over events, and the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.plans.oracles import TRAIL, walk
from tidebars.streaming import ticks as T

C = F.col


def tick_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries inside half-hour bars of each event type's values, with how they end."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(C("event_type").alias("symbol"), "ts", "event_id", C("value").alias("price"))
    return T.replayed(rows).withColumns({n: C(n).cast("timestamp_ntz") for n in ("bar", "at")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"tick_signals": tick_signals}


def tick_sql(rule: T.Rule = T.Rule()) -> str:
    """Recursion along each symbol's ticks, with the stop of the bars before."""
    trail = walk(TRAIL, {"stop": "stp", "a": "CASE WHEN b.rn >= 10 THEN a END"})
    ticks = (
        f"WITH RECURSIVE bars AS ({trail} SELECT * FROM b1), lv AS (SELECT symbol, ts AS bar, lag(stop) OVER w AS level, coalesce(lag(a) OVER w, 0) * {rule.reach!r} AS gap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)), "
        "t0 AS (SELECT event_type AS symbol, ts, value AS price, time_bucket(INTERVAL '30 minutes', ts) AS bar, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL), "
        "t AS MATERIALIZED (SELECT t0.*, level, gap, coalesce(lag(t0.bar) OVER w <> t0.bar, true) AS starts, coalesce(lead(t0.bar) OVER w <> t0.bar, true) AS ends, lag(price) OVER w AS before FROM t0 JOIN lv ON lv.symbol = t0.symbol AND lv.bar = t0.bar WINDOW w AS (PARTITION BY t0.symbol ORDER BY k))"
    )
    state = ("latch", "up", "down", "held", "sure", "side")

    def steps(source: str) -> str:
        s = f"SELECT *, CASE WHEN starts THEN 0 ELSE o_side END AS side0, CASE WHEN before <= level AND level < price THEN 1 WHEN before >= level AND level > price THEN -1 ELSE o_latch END AS latch0 FROM ({source})"
        s = f"SELECT *, CASE WHEN price > level AND latch0 = 1 THEN CASE WHEN starts THEN 0 ELSE o_up END + 1 ELSE 0 END AS up, CASE WHEN price < level AND latch0 = -1 THEN CASE WHEN starts THEN 0 ELSE o_down END + 1 ELSE 0 END AS down FROM ({s})"
        s = f"SELECT *, CASE WHEN side0 <> 0 OR level IS NULL THEN 0 WHEN up >= {rule.stable} AND price - level > gap AND o_held <= 0 THEN 1 WHEN down >= {rule.stable} AND level - price > gap AND o_held >= 0 THEN -1 ELSE 0 END AS opened FROM ({s})"
        s = f"SELECT *, CASE WHEN opened <> 0 THEN opened ELSE side0 END AS side, CASE WHEN opened <> 0 THEN 0 ELSE latch0 END AS latch, CASE WHEN opened <> 0 THEN opened ELSE o_held END AS held0 FROM ({s})"
        s = f"SELECT *, ends AND side <> 0 AS judged, coalesce(side * (price - level) > 0, false) AS holds FROM ({s})"
        return f"SELECT *, CASE WHEN judged AND NOT holds THEN o_sure WHEN judged THEN side ELSE held0 END AS held, CASE WHEN judged AND holds THEN side WHEN judged THEN o_sure WHEN ends THEN held0 ELSE o_sure END AS sure, judged AND holds AND o_sure = -side AS flipped FROM ({s})"

    cols = "symbol, k, bar, ts, price, opened, judged, holds, flipped, " + ", ".join(f"{c}::INT AS {c}" for c in state)
    first = steps("SELECT *, " + ", ".join(f"0 AS o_{c}" for c in state) + " FROM t WHERE k = 1")
    later = steps("SELECT t.*, " + ", ".join(f"r.{c} AS o_{c}" for c in state) + " FROM r JOIN t ON t.symbol = r.symbol AND t.k = r.k + 1")
    return (
        f"{ticks}, r AS (SELECT {cols} FROM ({first}) UNION ALL SELECT {cols} FROM ({later})) "
        "SELECT symbol, bar, ts AS at, 'open' AS event, opened::INT AS side, price, 0 AS flipped FROM r WHERE opened <> 0 UNION ALL "
        f"SELECT symbol, bar, bar + INTERVAL {rule.seconds} SECOND, CASE WHEN holds THEN 'confirm' ELSE 'cancel' END, side, price, flipped::INT FROM r WHERE judged"
    )


def oracle_sql() -> dict[str, str]:
    return {"tick_signals": tick_sql()}
