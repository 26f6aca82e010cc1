"""A keyed machine over ticks: entries inside a bar, confirmed or cancelled when the bar closes.

A tick beyond the trailing stop of the bars closed so far, after crossing it and for `stable` ticks in a row, opens an entry at once, one a bar.
At the bar's close the entry is confirmed if the close is still beyond the stop, which may flip the side held before; else it is
cancelled, and the side confirmed before holds again.

replayed() runs the machine over a table of ticks; streamed() runs it over a stream, where ticks wait until the watermark has
passed them, so that the order in which they come doesn't show, and a bar without a later tick is closed by a timer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars.operators.recurrence import TrailingStop

EVENTS = "symbol string, bar timestamp, at timestamp, event string, side int, price double, flipped int"
C = F.col


@dataclass
class Rule:
    seconds: int = 1800
    stable: int = 2
    reach: float = 0.1
    """Ranges that an entry is to be beyond the stop."""
    n: int = 10
    k: float = 1.0


@dataclass
class Ticks:
    """Times are microseconds since the epoch. Events: (bar, at, event, side, price, flipped)."""

    rule: Rule
    trail: TrailingStop = field(init=False)
    level: float | None = None
    gap: float = 0.0
    bar: int | None = None
    last: float | None = None
    high: float = 0.0
    low: float = 0.0
    latch: int = 0
    runs: tuple[int, int] = (0, 0)
    state: int = 0
    confirmed: int = 0
    side: int = 0

    def __post_init__(self):
        self.trail = TrailingStop(self.rule.n, self.rule.k)

    @property
    def end(self) -> int | None:
        return None if self.bar is None else self.bar + self.rule.seconds * 1_000_000

    def closed(self) -> list[tuple]:
        """Ends the bar at hand, if there is one."""
        if self.bar is None:
            return []
        out = []
        if self.side:
            holds = self.side * (self.last - self.level) > 0
            out.append((self.bar, self.end, "confirm" if holds else "cancel", self.side, self.last, int(holds and self.confirmed == -self.side)))
            self.state = self.side if holds else self.confirmed
        self.confirmed = self.state
        self.level, _ = self.trail.step(self.high, self.low, self.last)
        atr = self.trail.atr.mean
        self.gap = self.rule.reach * atr.y if atr.n >= atr.least else 0.0
        self.bar, self.side, self.runs = None, 0, (0, 0)
        return out

    def tick(self, at: int, price: float) -> list[tuple]:
        start = at - at % (self.rule.seconds * 1_000_000)
        out = self.closed() if self.bar is not None and start > self.bar else []
        if self.bar is None:
            self.bar, self.high, self.low = start, price, price
        self.high, self.low = max(self.high, price), min(self.low, price)
        before, self.last = self.last, price
        if self.level is None:
            return out
        if before is not None and before <= self.level < price:
            self.latch = 1
        elif before is not None and before >= self.level > price:
            self.latch = -1
        away = price - self.level
        self.runs = (self.runs[0] + 1 if away > 0 and self.latch == 1 else 0, self.runs[1] + 1 if away < 0 and self.latch == -1 else 0)
        if not self.side:
            ready = 1 if self.runs[0] >= self.rule.stable and away > self.gap and self.state <= 0 else -1 if self.runs[1] >= self.rule.stable and -away > self.gap and self.state >= 0 else 0
            if ready:
                self.state = self.side = ready
                self.latch = 0
                out.append((self.bar, at, "open", ready, price, 0))
        return out


def shown(symbol: str, events: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(events, columns=["bar", "at", "event", "side", "price", "flipped"])
    times = {c: pd.to_datetime(f[c].astype("int64"), unit="us", utc=True) for c in ("bar", "at")}
    return f.assign(symbol=symbol, **times)[[c.split()[0] for c in EVENTS.split(", ")]]


def replayed(ticks: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Events of a table of ticks (symbol, ts, event_id, price), in order of ts and event_id; the last bar counts as closed. A row without
    time, symbol or price isn't a tick."""
    some = ticks.where("symbol IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL")
    rows = some.select("symbol", F.unix_micros(C("ts").cast("timestamp")).alias("at"), "event_id", C("price").cast("double").alias("price")).repartition("symbol").sortWithinPartitions("symbol", "at", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, machine = None, None
        for f in frames:
            for s, g in f.groupby("symbol", sort=False):
                if s != symbol:
                    if machine is not None:
                        yield shown(symbol, machine.closed())
                    symbol, machine = s, Ticks(rule)
                yield shown(s, [e for at, p in zip(g["at"].tolist(), g["price"].tolist(), strict=True) for e in machine.tick(at, p)])
        if machine is not None:
            yield shown(symbol, machine.closed())

    return rows.mapInPandas(run, EVENTS)


class Keyed(StatefulProcessor):
    """Holds a symbol's machine and the ticks that the watermark hasn't passed yet."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "machine binary, waiting binary")

    def loaded(self) -> tuple[Ticks, list[tuple[int, int, float]]]:
        got = self.held.get() if self.held.exists() else None
        return (pickle.loads(got[0]), pickle.loads(got[1])) if got else (Ticks(self.rule), [])

    def settle(self, symbol: str, machine: Ticks, waiting: list, mark: int) -> Iterator[pd.DataFrame]:
        """All that the watermark (milliseconds) has passed, then a timer for what comes next."""
        ready = sorted(t for t in waiting if t[0] < mark * 1000)
        waiting = [t for t in waiting if t[0] >= mark * 1000]
        events = [e for at, _, price in ready for e in machine.tick(at, price)]
        if machine.end is not None and machine.end <= mark * 1000:
            events += machine.closed()
        self.held.update((pickle.dumps(machine), pickle.dumps(waiting)))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        nexts = [t[0] // 1000 + 1 for t in waiting] + ([machine.end // 1000] if machine.end is not None else [])
        if nexts:
            self.handle.registerTimer(max(min(nexts), mark + 1))
        yield shown(symbol, events)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine, waiting = self.loaded()
        for f in rows:
            waiting += zip(f["at"].tolist(), f["event_id"].tolist(), f["price"].tolist(), strict=True)
        yield from self.settle(key[0], machine, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine, waiting = self.loaded()
        yield from self.settle(key[0], machine, waiting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def streamed(ticks: DataFrame, rule: Rule = Rule(), late: str = "10 minutes") -> DataFrame:
    """Events of a stream of ticks (symbol, ts, event_id, price), told when the watermark passes what they rest on. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass)."""
    some = ticks.where("symbol IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL").withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late)
    rows = some.select("symbol", "ts", F.unix_micros("ts").alias("at"), "event_id", C("price").cast("double").alias("price"))
    return rows.groupBy("symbol").transformWithStateInPandas(Keyed(rule), EVENTS, "append", "eventTime")
