"""Smoothers as states: values go in piece by piece, and each piece continues where the one before ended.

A state is a short list of doubles, so it can stand in a table or a stream's store between increments.
``run`` takes values in order (NaN for null) and gives as many; what it gives doesn't depend on how the
values are cut into pieces. Recursions with rates are solved in blocks of closed form, not row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: A block ends where the product of its rates falls below this, so scaled sums neither overflow nor lose digits.
LEAST_PRODUCT = 1e-200
BLOCK = 4096


def recursion(rates: np.ndarray | float, inputs: np.ndarray, start: float) -> np.ndarray:
    """y[i] = rates[i] * y[i - 1] + inputs[i], with y[-1] = start; rates are at least 0.

    Within a block, y = P * (start + cumsum(inputs / P)) for the running product P of the rates.
    """
    n, out, a = len(inputs), np.empty(len(inputs)), 0
    constant = np.isscalar(rates)
    step = BLOCK if not constant or rates >= 1 else 1 if rates <= 0 else max(1, min(BLOCK, int(math.log(LEAST_PRODUCT) / math.log(rates))))
    while a < n:
        b = min(n, a + step)
        if constant:
            product = np.power(float(rates), np.arange(1, b - a + 1))
        else:
            product = np.cumprod(rates[a:b])
            small = np.flatnonzero(product < LEAST_PRODUCT)
            if len(small):  # at least one row, which a rate of 0 may make begin anew
                b = a + max(1, int(small[0]))
                product = product[: b - a]
        if product[0] <= 0:
            out[a] = inputs[a]
            b = a + 1
        else:
            out[a:b] = product * (start + np.cumsum(inputs[a:b] / product))
        start, a = out[b - 1], b
    return out


class State:
    """``values`` is all a state carries on."""

    def __init__(self, values: list[float]):
        self.values = list(values)

    def run(self, v: np.ndarray, days: np.ndarray | None = None) -> np.ndarray:
        """What the values give; ``days`` are theirs, for states that end with the day."""
        at = np.flatnonzero(~np.isnan(v))  # rows without a value are skipped
        out = np.full(len(v), np.nan)
        if len(at):
            out[at] = self.step(v[at])
        return out

    def step(self, v: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Ewm(State):
    """Exponentially weighted mean with weights that sum to 1; gaps decay, nothing before the first value."""

    def __init__(self, alpha: float):
        super().__init__([0.0, 0.0, math.nan])
        self.keep = 1 - alpha

    def run(self, v: np.ndarray, days: np.ndarray | None = None) -> np.ndarray:
        if not len(v):
            return np.empty(0)
        present = ~np.isnan(v)
        total, weight = (recursion(self.keep, x, s) for x, s in ((np.where(present, v, 0.0), self.values[0]), (present.astype(np.float64), self.values[1])))
        last = np.maximum.accumulate(np.where(present, np.arange(len(v)), -1))
        mean = np.divide(total, weight, out=np.full(len(v), np.nan), where=present)
        out = np.where(last >= 0, mean[np.maximum(last, 0)], self.values[2])
        self.values = [total[-1], weight[-1], out[-1]]
        return out


class Ema(State):
    """Exponential smoothing that starts with the mean of the first ``n`` values; NaN before.

    ``warm`` gives the first n values, too: value i by a smoothing of length i.
    """

    def __init__(self, n: int, alpha: float | None = None, warm: bool = False):
        super().__init__([0.0, 0.0, math.nan])  # values so far, their sum while they are fewer than n, and the mean
        self.n, self.alpha, self.warm = n, 2 / (n + 1) if alpha is None else alpha, warm

    def step(self, v: np.ndarray) -> np.ndarray:
        count, total, held = self.values
        out, early = np.full(len(v), np.nan), v[: max(0, self.n - int(count))]
        if len(early):
            sums = total + np.cumsum(early)
            if self.warm:
                i = count + np.arange(len(early))
                before = np.divide(sums - early, i, out=np.zeros(len(early)), where=i > 0)
                out[: len(early)] = np.where(i > 0, before + 2 / (i + 1) * (early - before), early)
            total = sums[-1]
            if count + len(early) == self.n:
                held = total / self.n
                if not self.warm:
                    out[len(early) - 1] = held
        rest = v[len(early) :]
        if len(rest):
            out[len(early) :] = recursion(1 - self.alpha, self.alpha * rest, held)
            held = out[-1]
        self.values = [count + len(v), total, held]
        return out


class Chain(State):
    """States made of parts; ``values`` are theirs, one after the other."""

    def __init__(self, parts: list[State], own: list[float] | None = None):
        self.parts, self.own = parts, own or []

    @property
    def values(self) -> list[float]:
        return [*self.own, *(x for p in self.parts for x in p.values)]

    @values.setter
    def values(self, given: list[float]) -> None:
        own, at = len(self.own), len(self.own)
        self.own = list(given[:own])
        for p in self.parts:
            n = len(p.values)
            p.values, at = list(given[at : at + n]), at + n


class Dema(Chain):
    def __init__(self, n: int):
        super().__init__([Ema(n), Ema(n)])

    def step(self, v: np.ndarray) -> np.ndarray:
        once = self.parts[0].run(v)
        return 2 * once - self.parts[1].run(once)


class T3(Chain):
    """Six smoothings combined by a cubic of the volume factor."""

    def __init__(self, n: int, k: float = 0.7):
        super().__init__([Ema(n) for _ in range(6)])
        self.k = k

    def step(self, v: np.ndarray) -> np.ndarray:
        e, k = [v], self.k
        for part in self.parts:
            e.append(part.run(e[-1]))
        return -(k**3) * e[6] + (3 * k**2 + 3 * k**3) * e[5] + (-6 * k**2 - 3 * k - 3 * k**3) * e[4] + (1 + 3 * k + k**3 + 3 * k**2) * e[3]


class Kama(State):
    """Smoothing whose rate follows the efficiency of the last ``n`` steps, between spans of 2 and 30."""

    def __init__(self, n: int):
        super().__init__([0.0, math.nan] + [math.nan] * n)  # values so far, the mean, and the last n values
        self.n = n

    def step(self, v: np.ndarray) -> np.ndarray:
        n, count, held = self.n, int(self.values[0]), self.values[1]
        known = np.array(self.values[2:])[n - min(count, n) :]
        x = np.concatenate([known, v])
        out = np.full(len(x), np.nan)
        if len(x) > n:
            path = np.lib.stride_tricks.sliding_window_view(np.abs(np.diff(x)), n).sum(axis=1)
            efficiency = np.minimum(np.divide(np.abs(x[n:] - x[:-n]), path, out=np.ones(len(path)), where=path > 0), 1.0)
            rates = (efficiency * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            out[n:] = recursion(1 - rates, rates * x[n:], held if count > n else x[n - 1])
            held = out[-1]
        last = x[-n:]
        self.values = [float(count + len(v)), held, *([math.nan] * (n - len(last))), *last.tolist()]
        return out[len(known) :]


class Strength(Chain):
    """Smoothed gains and losses of the steps; ``of`` combines them."""

    def __init__(self, n: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        super().__init__([Ema(n, 1 / n), Ema(n, 1 / n)], [math.nan])
        self.of = of

    def step(self, v: np.ndarray) -> np.ndarray:
        moved = np.diff(v, prepend=self.own[0])
        self.own = [float(v[-1])]
        up, down = (part.run(np.where(np.isnan(moved), np.nan, np.maximum(sign * moved, 0))) for part, sign in zip(self.parts, (1, -1), strict=True))
        return np.divide(100 * self.of(up, down), up + down, out=np.where(np.isnan(up), np.nan, 0.0), where=up + down > 0)


class Macd(Chain):
    """Smoothing of the difference of two smoothings that both begin at the slow one's first value."""

    def __init__(self, fast: int, slow: int, signal: int = 9):
        super().__init__([Ema(fast), Ema(slow), Ema(signal)], [0.0])
        self.skip = slow - fast

    def step(self, v: np.ndarray) -> np.ndarray:
        behind = max(0, self.skip - int(self.own[0]))
        self.own = [self.own[0] + len(v)]
        short = np.full(len(v), np.nan)
        short[behind:] = self.parts[0].run(v[behind:])
        long = self.parts[1].run(v)
        return self.parts[2].run(np.where(np.isnan(long), np.nan, short - long))


class Trendline(State):
    """Instantaneous trendline: means over the dominant cycle that a Hilbert transform finds; NaN for 63 rows.

    The cycle's length feeds back into the next row's, so this one goes row by row.
    """

    LONGEST, TAPS = 50, 7

    def __init__(self):
        super().__init__([0.0] * (6 + self.LONGEST + 5 * self.TAPS))

    def step(self, v: np.ndarray) -> np.ndarray:
        count, (i2, q2, re, im, period) = int(self.values[0]), self.values[1:6]
        back = self.LONGEST
        held = np.array(self.values[6 : 6 + back])
        x = np.concatenate([held, v])
        smooth, detrend, q1, i1, trends = (np.concatenate([np.zeros(back - self.TAPS), self.values[6 + back + k * self.TAPS : 6 + back + (k + 1) * self.TAPS], np.zeros(len(v))]) for k in range(5))
        out = np.full(len(v), np.nan)

        def hilbert(a: np.ndarray, i: int, rate: float) -> float:
            return (0.0962 * a[i] + 0.5769 * a[i - 2] - 0.5769 * a[i - 4] - 0.0962 * a[i - 6]) * rate

        for j in range(len(v)):
            n, i = count + j, back + j
            smooth[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10 if n >= 3 else x[i]
            if n < 9:
                continue
            rate = 0.075 * period + 0.54
            detrend[i] = hilbert(smooth, i, rate)
            q1[i], i1[i] = hilbert(detrend, i, rate), detrend[i - 3]
            i2_, q2_ = i1[i] - hilbert(q1, i, rate), q1[i] + hilbert(i1, i, rate)
            i2_, q2_ = 0.2 * i2_ + 0.8 * i2, 0.2 * q2_ + 0.8 * q2
            re, im = 0.2 * (i2_ * i2 + q2_ * q2) + 0.8 * re, 0.2 * (i2_ * q2 - q2_ * i2) + 0.8 * im
            i2, q2 = i2_, q2_
            new = 2 * math.pi / math.atan(im / re) if im and re else period
            new = min(max(new, 0.67 * period), 1.5 * period) if period else new
            period = 0.2 * min(max(new, 6.0), 50.0) + 0.8 * period
            cycle = min(max(1, int(period + 0.5)), n + 1)
            trends[i] = x[i - cycle + 1 : i + 1].mean()
            if n >= 63:
                out[j] = (4 * trends[i] + 3 * trends[i - 1] + 2 * trends[i - 2] + trends[i - 3]) / 10
        tails = [a[-self.TAPS :].tolist() for a in (smooth, detrend, q1, i1, trends)]
        self.values = [float(count + len(v)), i2, q2, re, im, period, *x[-back:].tolist(), *(t for tail in tails for t in tail)]
        return out


class Total(State):
    """Running sum."""

    def __init__(self):
        super().__init__([0.0])

    def step(self, v: np.ndarray) -> np.ndarray:
        out = self.values[0] + np.cumsum(v)
        self.values = [float(out[-1])]
        return out


class Latest(State):
    """The last value so far."""

    def __init__(self):
        super().__init__([math.nan])

    def run(self, v: np.ndarray, days: np.ndarray | None = None) -> np.ndarray:
        last = np.maximum.accumulate(np.where(np.isnan(v), -1, np.arange(len(v)))) if len(v) else np.empty(0, int)
        out = np.where(last >= 0, v[np.maximum(last, 0)] if len(v) else v, self.values[0])
        self.values = [float(out[-1])] if len(out) else self.values
        return out


class Trailing(State):
    """A statistic of the last ``n`` rows, null cells among them; holds the n - 1 rows before."""

    def __init__(self, n: int, of: Callable[[np.ndarray], np.ndarray]):
        if not isinstance(n, int):
            raise ValueError(f"a state holds a number of rows, not {n!r}; calendar windows need history")
        super().__init__([math.nan] * (n - 1))
        self.n, self.of = n, of

    def run(self, v: np.ndarray, days: np.ndarray | None = None) -> np.ndarray:
        x = np.concatenate([self.values, v])
        out = np.full(len(v), np.nan)
        for a in range(0, len(v), BLOCK):  # a block's windows at a time
            frames = np.lib.stride_tricks.sliding_window_view(x[a : a + BLOCK + self.n - 1], self.n)
            some = (~np.isnan(frames)).any(axis=1)
            if some.any():
                out[a : a + len(frames)][some] = self.of(frames[some])
        self.values = x[len(x) - self.n + 1 :].tolist()
        return out


class Pointwise(State):
    """A function of each value by itself."""

    def __init__(self, of: Callable[[np.ndarray], np.ndarray]):
        super().__init__([])
        self.of = of

    def step(self, v: np.ndarray) -> np.ndarray:
        return self.of(v)


def deviation(frames: np.ndarray) -> np.ndarray:
    """Sample deviation of each row's values; NaN of fewer than two."""
    n = (~np.isnan(frames)).sum(axis=1)
    square = np.nansum((frames - np.nanmean(frames, axis=1, keepdims=True)) ** 2, axis=1)
    return np.sqrt(np.divide(square, n - 1, out=np.full(len(n), np.nan), where=n > 1))


class Daily(Chain):
    """A state that begins anew each day."""

    def __init__(self, new: Callable[[], State]):
        super().__init__([new()], [math.nan])
        self.new = new

    def run(self, v: np.ndarray, days: np.ndarray | None = None) -> np.ndarray:
        out = np.empty(len(v))
        starts = np.flatnonzero(np.diff(days, prepend=np.nan) != 0) if len(v) else []
        for a, b in zip(starts, [*starts[1:], len(v)], strict=True):
            if days[a] != self.own[0]:
                self.parts[0], self.own = self.new(), [float(days[a])]
            out[a:b] = self.parts[0].run(v[a:b])
        return out


def rsi(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return up


def momentum(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return up - down


#: New states of transforms, by their names in ``TRANSFORMS`` and with the same parameters.
STATES: dict[str, Callable[..., State]] = {
    "ewma": lambda span: Ewm(2 / (span + 1)),
    "intraEwma": lambda span: Daily(lambda: Ewm(2 / (span + 1))),
    "intraCumSum": lambda: Daily(Total),
    "cumSum": Total,
    "fill": Latest,
    "mean": lambda window: Trailing(window, lambda f: np.nanmean(f, axis=1)),
    "std": lambda window: Trailing(window, deviation),
    "rmin": lambda window: Trailing(window, lambda f: np.nanmin(f, axis=1)),
    "rmax": lambda window: Trailing(window, lambda f: np.nanmax(f, axis=1)),
    "absv": lambda: Pointwise(np.abs),
    "exp": lambda: Pointwise(np.exp),
    "ema_func": lambda window: Ema(window, warm=True),
    "dema_func": Dema,
    "t3_func": T3,
    "kama_func": Kama,
    "rsi_func": lambda window: Strength(window, rsi),
    "cmo_func": lambda window: Strength(window, momentum),
    "macd_func": lambda window: Macd(window // 2, window),
    "htTrendline_func": lambda window=0: Trendline(),
}
STATES = {name: (lambda of: lambda **parameters: of(*parameters.values()))(of) for name, of in STATES.items()}
