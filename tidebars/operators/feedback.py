"""Volatility machines that feed back on themselves: bands that hold while the series stays on their side, a trend line that turns on
extremes, and a filter that moves only when the series leaves its range. For scan(); bars without a close change nothing."""

from __future__ import annotations

from tidebars.operators.recurrence import Machine, Value


class Smooth:
    """Exponential mean seeded by its first value; a missing one changes nothing."""

    def __init__(self, alpha: float):
        self.alpha, self.y = alpha, None

    def step(self, x: Value) -> Value:
        if x is not None:
            self.y = x if self.y is None else self.alpha * x + (1 - self.alpha) * self.y
        return self.y


def span(n: int) -> Smooth:
    return Smooth(2 / (n + 1))


def passed(now: Value, line: Value, before: Value, line_before: Value) -> bool:
    """Either way."""
    return None not in (now, line, before, line_before) and ((now > line and before <= line_before) or (now < line and before >= line_before))


class Qqe(Machine):
    """A smoothed RSI with bands of its own mean moves: the lower one only rises while the RSI is above it, the upper one only falls
    while below. The trend turns where the RSI passes a band; the line is the band behind it."""

    def __init__(self, n: int = 6, smooth: int = 5, factor: float = 1.61):
        self.up, self.down, self.rsi = Smooth(1 / n), Smooth(1 / n), span(smooth)
        self.moves, self.again, self.factor = span(2 * n - 1), span(2 * n - 1), factor
        self.last: Value = None
        self.low: tuple[Value, Value] = (None, None)
        self.high: tuple[Value, Value] = (None, None)
        self.trend = 1

    def step(self, x: Value) -> tuple[Value, ...]:
        if x is None:
            return self.rsi.y, None, float(self.trend)
        move = None if self.last is None else x - self.last
        self.last = x
        up, down = self.up.step(None if move is None else max(move, 0.0)), self.down.step(None if move is None else max(-move, 0.0))
        before = self.rsi.y
        now = self.rsi.step(100 - 100 / (1 + up / down) if down else None)
        wide = self.again.step(self.moves.step(None if now is None or before is None else abs(now - before)))
        if wide is None:
            return now, None, float(self.trend)
        (low, low2), (high, high2) = self.low, self.high
        new_low, new_high = now - wide * self.factor, now + wide * self.factor
        kept_low = max(low, new_low) if low is not None and before > low and now > low else new_low
        kept_high = min(high, new_high) if high is not None and before < high and now < high else new_high
        self.trend = 1 if passed(now, high, before, high2) else -1 if passed(now, low, before, low2) else self.trend
        self.low, self.high = (kept_low, low), (kept_high, high)
        return now, kept_low if self.trend == 1 else kept_high, float(self.trend)


class HalfTrend(Machine):
    """A line that steps along highest lows in a rise and lowest highs in a fall; a fall begins when the mean high is below the highest
    low so far and the close below the low before, a rise likewise. Trend 0 is a rise."""

    inputs = ("high", "low", "close")

    def __init__(self):
        self.before: tuple[float, float] | None = None
        self.trend = self.awaited = 0
        self.most = self.least = 0.0
        self.up: Value = None
        self.down: Value = None

    def step(self, h: Value, low: Value, c: Value) -> tuple[Value, ...]:
        if None in (h, low, c):
            return None, float(self.trend)
        if self.before is None:
            self.before, self.most, self.least = (h, low), low, h
            return None, 0.0
        (h1, l1), old = self.before, self.trend
        self.before = (h, low)
        top, bottom = max(h, h1), min(low, l1)
        if self.awaited:
            self.most = max(bottom, self.most)
            if (h + h1) / 2 < self.most and c < l1:
                self.trend, self.awaited, self.least = 1, 0, top
        else:
            self.least = min(top, self.least)
            if (low + l1) / 2 > self.least and c > h1:
                self.trend, self.awaited, self.most = 0, 1, bottom
        if self.trend == 0:
            self.up = self.down if old else self.most if self.up is None else max(self.most, self.up)
            return self.up, 0.0
        self.down = self.up if not old else self.least if self.down is None else min(self.least, self.down)
        return self.down, 1.0


class RangeFilter(Machine):
    """Follows the close only as far as it leaves the filter by more than `factor` twice smoothed mean moves; and for how many bars it
    has gone up (positive) or down (negative); pauses don't count."""

    def __init__(self, n: int = 100, factor: float = 3.0):
        self.moves, self.again, self.factor = span(n), span(2 * n - 1), factor
        self.last: Value = None
        self.y: Value = None
        self.run = 0

    def step(self, x: Value) -> tuple[Value, ...]:
        if x is None:
            return self.y, float(self.run)
        wide = self.again.step(self.moves.step(None if self.last is None else abs(x - self.last)))
        self.last = x
        if wide is None:
            return None, 0.0
        r, old = wide * self.factor, self.y
        self.y = x if old is None else max(old, x - r) if x > old else min(old, x + r)
        if old is not None and self.y > old:
            self.run = max(self.run, 0) + 1
        elif old is not None and self.y < old:
            self.run = min(self.run, 0) - 1
        return self.y, float(self.run)
