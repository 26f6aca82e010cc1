"""Recurrences over ordered bars that no window function has: exponential means, trailing stops, and what is built on them.

scan() deals rows by symbol, sorts them inside the partitions and streams them through small state machines, all in one pass:
state is carried from batch to batch, so a long series is never held in memory, and many symbols run at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

Value = float | None


@dataclass
class Ewm:
    """Exponential mean of weight alpha, seeded by the first value; gaps let the weights of old values decay."""

    alpha: float
    least: int = 1
    y: float = 0.0
    n: int = 0
    weight: float = 1.0

    @classmethod
    def span(cls, n: int) -> Ewm:
        return cls(2 / (n + 1), n)

    @classmethod
    def wilder(cls, n: int) -> Ewm:
        return cls(1 / n, n)

    def step(self, x: Value) -> Value:
        if self.n:
            self.weight *= 1 - self.alpha
        if x is not None:
            if self.n:
                self.y = (self.weight * self.y + self.alpha * x) / (self.weight + self.alpha)
            else:
                self.y = x
            self.weight = 1.0
            self.n += 1
        return self.y if self.n >= self.least else None


def minus(a: Value, b: Value) -> Value:
    return None if a is None or b is None else a - b


def over(a: Value, b: Value) -> Value:
    return None if a is None or not b else a / b


class Machine:
    """Turns a bar's inputs into its outputs; names of both are class attributes."""

    inputs: tuple[str, ...] = ("close",)

    def step(self, *x: Value) -> tuple[Value, ...]:
        raise NotImplementedError


class Mean(Machine):
    def __init__(self, of: str, ewm: Ewm):
        self.inputs, self.ewm = (of,), ewm

    def step(self, x: Value) -> tuple[Value]:
        return (self.ewm.step(x),)


class Rsi(Machine):
    """Undefined where nothing fell."""

    def __init__(self, n: int = 14, of: str = "close"):
        self.inputs = (of,)
        self.up, self.down, self.last = Ewm.wilder(n), Ewm.wilder(n), None

    def step(self, x: Value) -> tuple[Value]:
        d = minus(x, self.last)
        self.last = x
        up, down = (self.up.step(None), self.down.step(None)) if d is None else (self.up.step(max(d, 0.0)), self.down.step(max(-d, 0.0)))
        ratio = over(up, down)
        return (None if ratio is None else 100 - 100 / (1 + ratio),)


class Macd(Machine):
    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.signal = Ewm.span(fast), Ewm.span(slow), Ewm.span(signal)

    def step(self, x: Value) -> tuple[Value, Value]:
        line = minus(self.fast.step(x), self.slow.step(x))
        return line, self.signal.step(line)


class Adx(Machine):
    """True range mean, both directional indices and their trend strength."""

    inputs = ("high", "low", "close")

    def __init__(self, n: int = 14):
        self.tr, self.up, self.down, self.dx = (Ewm.wilder(n) for _ in range(4))
        self.last: tuple[Value, Value, Value] | None = None

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value, ...]:
        if h is None or low is None or c is None:
            tr = up = down = None
        elif self.last is None or None in self.last:
            tr, up, down = h - low, 0.0, 0.0
        else:
            ph, pl, pc = self.last
            tr = max(h - low, abs(h - pc), abs(low - pc))
            rise, fall = h - ph, pl - low
            up, down = rise if rise > fall and rise > 0 else 0.0, fall if fall > rise and fall > 0 else 0.0
        self.last = (h, low, c)
        atr = self.tr.step(tr)
        plus, less = over(self.up.step(up), atr), over(self.down.step(down), atr)
        plus, less = None if plus is None else 100 * plus, None if less is None else 100 * less
        dx = None if plus is None or less is None else over(abs(plus - less), plus + less)
        return plus, less, self.dx.step(None if dx is None else 100 * dx)


class WaveTrend(Machine):
    inputs = ("high", "low", "close")

    def __init__(self, n1: int = 10, n2: int = 21):
        self.mean, self.spread, self.out = Ewm.span(n1), Ewm.span(n1), Ewm.span(n2)

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value]:
        p = None if h is None or low is None or c is None else (h + low + c) / 3
        d = minus(p, self.mean.step(p))
        spread = self.spread.step(None if d is None else abs(d))
        return (self.out.step(over(d, None if spread is None else 0.015 * spread)),)


class Tsi(Machine):
    """Twice smoothed change over twice smoothed absolute change, with its signal line."""

    def __init__(self, long: int = 25, short: int = 13, signal: int = 7):
        self.a, self.b, self.c, self.d = Ewm.span(long), Ewm.span(short), Ewm.span(long), Ewm.span(short)
        self.signal, self.last = Ewm.span(signal), None

    def step(self, x: Value) -> tuple[Value, Value]:
        d = minus(x, self.last)
        self.last = x
        top, low = self.b.step(self.a.step(d)), self.d.step(self.c.step(None if d is None else abs(d)))
        r = over(top, low)
        r = None if r is None else 100 * r
        return r, self.signal.step(r)


class Cascade(Machine):
    """Double and triple exponential means."""

    def __init__(self, n: int = 21):
        self.e = [Ewm.span(n) for _ in range(3)]

    def step(self, x: Value) -> tuple[Value, Value]:
        a = self.e[0].step(x)
        b = self.e[1].step(a)
        c = self.e[2].step(b)
        return None if b is None else 2 * a - b, None if c is None else 3 * a - 3 * b + c


class Kama(Machine):
    """Kaufman's adaptive mean: efficiency sets the weight; starts, and starts again after a gap, at the close."""

    def __init__(self, n: int = 10, fast: int = 2, slow: int = 30):
        self.n, self.fast, self.slow = n, 2 / (fast + 1), 2 / (slow + 1)
        self.past: list[float] = []
        self.y: Value = None
        self.begun = False

    def step(self, x: Value) -> tuple[Value]:
        if x is None:
            return (self.y,)
        self.past = [*self.past[-self.n :], x]
        if len(self.past) <= self.n:
            return (None,)
        if not self.begun or self.y is None:
            self.begun, self.y = True, x
            return (x,)
        path = sum(abs(b - a) for a, b in zip(self.past, self.past[1:], strict=False))
        if path <= 1e-9:
            self.y = None
            return (None,)
        weight = (abs(x - self.past[0]) / path * (self.fast - self.slow) + self.slow) ** 2
        self.y += weight * (x - self.y)
        return (self.y,)


class Psar(Machine):
    """Parabolic stop and reverse: the stop, and +1 or -1 for the trend. Starts with the second bar."""

    inputs = ("high", "low", "close")

    def __init__(self, start: float = 0.02, step: float = 0.02, most: float = 0.2):
        self.start, self.pace, self.most = start, step, most
        self.past: list[tuple[float, float, float]] = []
        self.trend, self.stop, self.extreme, self.af = 0, 0.0, 0.0, start

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value, Value]:
        if h is None or low is None or c is None:
            return None, None
        past, self.past = self.past, [*self.past[-1:], (h, low, c)]
        if not past:
            return None, None
        if not self.trend:
            self.trend = 1 if h >= past[-1][0] else -1
            self.stop = past[-1][1] if self.trend > 0 else past[-1][0]
            self.extreme = h if self.trend > 0 else low
            return self.stop, float(self.trend)
        stop = self.stop + self.af * (self.extreme - self.stop)
        if self.trend > 0:
            stop = min([stop, *[p[1] for p in past]])
            turned = low < stop
        else:
            stop = max([stop, *[p[0] for p in past]])
            turned = h > stop
        if turned:
            stop, self.trend, self.af = self.extreme, -self.trend, self.start
            self.extreme = h if self.trend > 0 else low
        elif (self.trend > 0 and h > self.extreme) or (self.trend < 0 and low < self.extreme):
            self.extreme = h if self.trend > 0 else low
            self.af = min(self.af + self.pace, self.most)
        self.stop = stop
        return stop, float(self.trend)


class Atr(Machine):
    inputs = ("high", "low", "close")

    def __init__(self, n: int = 14):
        self.mean, self.last = Ewm.wilder(n), None

    def range(self, h: Value, low: Value, c: Value) -> Value:
        last, self.last = self.last, c if c is not None else self.last
        if h is None or low is None:
            return None
        return h - low if last is None else max(h - low, abs(h - last), abs(low - last))

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value]:
        return (self.mean.step(self.range(h, low, c)),)


class SuperTrend(Machine):
    """Bands of k ranges around the middle that only tighten while the close stays on their side; the line and the trend."""

    inputs = ("high", "low", "close")

    def __init__(self, n: int = 10, k: float = 3.0):
        self.atr, self.k = Atr(n), k
        self.up: Value = None
        self.down: Value = None
        self.trend, self.last = 1, None

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value, Value]:
        (atr,) = self.atr.step(h, low, c)
        if atr is None or h is None or low is None or c is None:
            self.last = c if c is not None else self.last
            return None, None
        middle = (h + low) / 2
        up, down = middle - self.k * atr, middle + self.k * atr
        if self.up is not None and self.last is not None:
            up = max(up, self.up) if self.last > self.up else up
            down = min(down, self.down) if self.last < self.down else down
            if self.trend < 0 and c > self.down:
                self.trend = 1
            elif self.trend > 0 and c < self.up:
                self.trend = -1
        self.up, self.down, self.last = up, down, c
        return (up if self.trend > 0 else down), float(self.trend)


class Chandelier(Machine):
    """Stops hung k ranges below the highest high and above the lowest low of n bars, ratcheted; the direction."""

    inputs = ("high", "low", "close")

    def __init__(self, n: int = 22, k: float = 3.0):
        self.atr, self.n, self.k = Atr(n), n, k
        self.highs: list[float] = []
        self.lows: list[float] = []
        self.long = self.short = self.last = None
        self.direction = 1

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value, Value, Value]:
        (atr,) = self.atr.step(h, low, c)
        if h is None or low is None or c is None:
            return None, None, None
        self.highs, self.lows = [*self.highs[1 - self.n :], h], [*self.lows[1 - self.n :], low]
        if atr is None or len(self.highs) < self.n:
            self.last = c
            return None, None, None
        long, short = max(self.highs) - self.k * atr, min(self.lows) + self.k * atr
        before_long, before_short = (long, short) if self.long is None else (self.long, self.short)
        if self.last is not None and self.last > before_long:
            long = max(long, before_long)
        if self.last is not None and self.last < before_short:
            short = min(short, before_short)
        self.direction = 1 if c > before_short else -1 if c < before_long else self.direction
        self.long, self.short, self.last = long, short, c
        return long, short, float(self.direction)


class TrailingStop(Machine):
    """A stop k ranges off the close that only follows; buys and sells where the close crosses it."""

    inputs = ("high", "low", "close")

    def __init__(self, n: int = 10, k: float = 1.0):
        self.atr, self.k = Atr(n), k
        self.stop: Value = None
        self.last: Value = None

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value, Value]:
        (atr,) = self.atr.step(h, low, c)
        if atr is None or c is None:
            self.last = c if c is not None else self.last
            return None, None
        gap, old, last = self.k * atr, self.stop, self.last
        if old is None or last is None:
            stop = c - gap
        elif c > old and last > old:
            stop = max(old, c - gap)
        elif c < old and last < old:
            stop = min(old, c + gap)
        else:
            stop = c - gap if c > old else c + gap
        signal = 0.0 if old is None or last is None else 1.0 if last <= old and c > stop else -1.0 if last >= old and c < stop else 0.0
        self.stop, self.last = stop, c
        return stop, signal


class HeikinAshi(Machine):
    inputs = ("open", "high", "low", "close")

    def __init__(self):
        self.o = self.c = None

    def step(self, o: Value, h: Value, low: Value, c: Value) -> tuple[Value, ...]:
        if None in (o, h, low, c):
            return None, None, None, None
        close = (o + h + low + c) / 4
        open_ = (o + c) / 2 if self.o is None else (self.o + self.c) / 2
        self.o, self.c = open_, close
        return open_, max(h, open_, close), min(low, open_, close), close


class McGinley(Machine):
    """A mean that follows faster when the value is below it; it starts anew where it has come to zero, and holds where the step
    has no finite size (a value far below it)."""

    def __init__(self, n: int = 14):
        self.n, self.y = n, None

    def step(self, x: Value) -> tuple[Value]:
        if x is None:
            return (self.y,)
        if not self.y:
            self.y = x
        elif abs(r := x / self.y) > 1e-3:
            self.y += (x - self.y) / (self.n * (r * r * r * r))
        return (self.y,)


class Cusum(Machine):
    """+1 or -1 where the summed changes since the last event pass the threshold, which starts the sums anew."""

    def __init__(self, threshold: float):
        self.threshold, self.up, self.down, self.last = threshold, 0.0, 0.0, None

    def step(self, x: Value) -> tuple[Value]:
        d = minus(x, self.last)
        self.last = x if x is not None else self.last
        if d is None:
            return (0.0,)
        self.up, self.down = max(0.0, self.up + d), min(0.0, self.down + d)
        if self.up > self.threshold:
            self.up = 0.0
            return (1.0,)
        if self.down < -self.threshold:
            self.down = 0.0
            return (-1.0,)
        return (0.0,)


@dataclass
class Scan:
    """Outputs, and how to make the machine that gives them."""

    outputs: tuple[str, ...]
    make: Callable[[], Machine]
    machine: Machine = field(init=False)

    def __post_init__(self):
        self.machine = self.make()


def ema(name: str, n: int, of: str = "close") -> Scan:
    return Scan((name,), lambda: Mean(of, Ewm.span(n)))


def rma(name: str, n: int, of: str = "close") -> Scan:
    return Scan((name,), lambda: Mean(of, Ewm.wilder(n)))


def scan(bars: DataFrame, scans: list[Scan]) -> DataFrame:
    """bars with the outputs of all scans. One exchange by symbol, one sort, one pass."""
    plans = [(s.outputs, s.make) for s in scans]
    inputs = sorted({c for s in scans for c in s.machine.inputs})
    names = [o for s in scans for o in s.outputs]
    rows = bars.repartition("symbol").sortWithinPartitions("symbol", "ts")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, machines = None, []
        for f in frames:
            columns = {c: [None if x is None or x != x else float(x) for x in f[c].tolist()] for c in inputs}
            out: dict[str, list[Value]] = {o: [] for o in names}
            for i, s in enumerate(f["symbol"].tolist()):
                if s != symbol or not machines:
                    symbol, machines = s, [(outputs, make()) for outputs, make in plans]
                for outputs, m in machines:
                    for o, v in zip(outputs, m.step(*[columns[c][i] for c in m.inputs]), strict=True):
                        out[o].append(v if v is None or math.isfinite(v) else None)
            yield f.assign(**{o: pd.Series(v, index=f.index, dtype="float64") for o, v in out.items()})

    return rows.mapInPandas(run, kept + "".join(f", `{o}` double" for o in names))
