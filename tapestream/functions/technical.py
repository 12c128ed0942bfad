"""Technical and statistical transforms that built-in window functions express, and their compositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from . import recursive
from .frames import at_least, ordered, ratio, rows
from .rolling import TRANSFORMS, transform, unbiased_kurtosis, unbiased_skew
from .scan import held, row_number


def _full(name: str, value: Callable[[Column, WindowSpec, int], Column], least: int | None = None) -> None:
    """A transform over ``window`` rows that all have a value (or ``least`` of them)."""

    def function(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        w = rows(window)
        numbered = frame.withColumn("__row", row_number(frame).cast("double"))
        return numbered.withColumn(out, at_least(window if least is None else least, x, w, value(x, w, window)))

    function.__name__ = name
    transform(function)


def _slope(x: Column, w: WindowSpec) -> Column:
    return F.regr_slope(x, F.col("__row")).over(w)


def _line(x: Column, w: WindowSpec, n: int, at: float) -> Column:
    """The fitted line ``at`` rows after the window's first."""
    return F.avg(x).over(w) + _slope(x, w) * (at - (n - 1) / 2)


for _name, _value, _least in (
    ("treg_func", lambda x, w, n: _line(x, w, n, n - 1), None),
    ("regag_func", lambda x, w, n: F.degrees(F.atan(_slope(x, w))), None),
    ("itc_func", lambda x, w, n: _line(x, w, n, 0), None),
    ("slope_func", lambda x, w, n: _slope(x, w), None),
    ("tsf_func", lambda x, w, n: _line(x, w, n, n), None),
    ("std_func", lambda x, w, n: F.stddev_pop(x).over(w), None),
    ("var_func", lambda x, w, n: F.var_pop(x).over(w), None),
    ("mean_std_func", lambda x, w, n: ratio(F.avg(x).over(w), F.stddev_samp(x).over(w)), 1),
    ("xMeanStd_func", lambda x, w, n: ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), 1),
    ("skew_func", lambda x, w, n: unbiased_skew(x, w), 1),
    ("kurt_func", lambda x, w, n: unbiased_kurtosis(x, w), 1),
    ("apo_func", lambda x, w, n: F.avg(x).over(rows(n // 2)) - F.avg(x).over(w), None),
    ("entropy_func", lambda x, w, n: F.ln(F.sum(x).over(w)) - ratio(F.sum(F.when(x > 0, x * F.ln(x)).otherwise(0.0)).over(w), F.sum(x).over(w)), None),
):
    _full(_name, _value, _least)


def _lagged(name: str, value: Callable[[Column, Column], Column]) -> None:
    def function(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        return frame.withColumn(out, value(x, F.lag(x, window).over(ordered())))

    function.__name__ = name
    transform(function)


_lagged("mom_func", lambda x, b: x - b)
_lagged("diff_func", lambda x, b: x - b)
_lagged("rocp_func", lambda x, b: ratio(x - b, b))


@transform
def DoubleDiff_func(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
    return frame.withColumn(out, x - 2 * F.lag(x, window).over(ordered()) + F.lag(x, 2 * window).over(ordered()))


@transform
def pct_func(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
    """Change over ``window`` rows relative to the absolute value then; carried forward over gaps."""
    before = F.lag(x, window).over(ordered())
    return held(frame, ratio(x - before, F.abs(before)), out)


@transform
def beta_func(frame: DataFrame, x: Column, out: str, rtn: str, window: int) -> DataFrame:
    """Rolling beta of the changes of ``rtn`` on the changes of x."""
    r = F.col(rtn)
    moved = frame.withColumn("__rx", ratio(x, F.lag(x).over(ordered())) - 1).withColumn("__ry", ratio(r, F.lag(r).over(ordered())) - 1)
    w, both = rows(window), F.when(F.col("__ry").isNotNull(), F.col("__rx"))
    return moved.withColumn(out, at_least(window, both, w, ratio(F.covar_pop("__rx", "__ry").over(w), F.var_pop("__rx").over(w))))


@transform
def regression_beta(frame: DataFrame, x: Column, out: str, factor: str, window: int = 11520) -> DataFrame:
    """Slope of x on another column over the ``window`` rows before the current one."""
    w = ordered().rowsBetween(-window, -1)
    return frame.withColumn(out, F.regr_slope(x, F.col(factor)).over(w))


@transform
def ma_func(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
    """Moving mean; of the first rows, row i has the mean of the last i values and row 0 its own."""
    w = rows(window)  # of the first rows, all so far
    numbered = frame.withColumn("__row", row_number(frame) - 1).withColumn("__mean", F.avg(x).over(w))
    early = (F.col("__mean") * (F.col("__row") + 1) - F.first(x).over(w)) / F.col("__row")
    return numbered.withColumn(out, F.when(F.col("__row") == 0, x).when(F.col("__row") < window, early).otherwise(F.col("__mean")))


@transform
def bbands_func(frame: DataFrame, x: Column, out: str, window: int, up: float = 2.0, down: float = 2.0) -> DataFrame:
    """1 above the upper band, -1 below the lower one, 0 after the middle is crossed; signals against the sign of x end."""
    numbered = frame.withColumn("__row", row_number(frame) - 1)
    warm, w = F.col("__row") < window, rows(window)
    # while warming up, the window holds all rows so far, and row i uses its last i values: all rows but the first
    n, sum_, square = F.col("__row"), F.sum(x).over(w) - F.first(x).over(w), F.sum(x * x).over(w) - F.first(x * x).over(w)
    mean = F.when(warm, ratio(sum_, n)).otherwise(F.avg(x).over(w))
    deviation = F.when(warm, F.sqrt(F.greatest(ratio(square, n) - ratio(sum_, n) * ratio(sum_, n), F.lit(0.0)))).otherwise(F.stddev_pop(x).over(w))
    ready = F.col("__row") >= 2
    bands = numbered.withColumn("__mid", F.when(ready, mean)).withColumn("__dev", F.when(ready, deviation))
    buy, sell = x >= F.col("__mid") + F.when(warm, up).otherwise(2.0) * F.col("__dev"), x <= F.col("__mid") - F.when(warm, down).otherwise(2.0) * F.col("__dev")
    first = held(bands.withColumn("__buy", buy).withColumn("__sell", sell), F.when(F.col("__sell"), -1.0).when(F.col("__buy"), 1.0), "__state")
    left = ((F.col("__state") == 1) & (x <= F.col("__mid"))) | ((F.col("__state") == -1) & (x >= F.col("__mid")))
    signal = F.when(F.col("__sell"), -1.0).when(F.col("__buy"), 1.0).when(left, 0.0)
    signal = F.when(((signal == 1) & (x < 0)) | ((signal == -1) & (x > 0)), 0.0).otherwise(signal)
    return held(first, signal, out)


def _crossings(short: Column, long: Column) -> tuple[Column, Column]:
    """Crosses upwards and downwards; averages of the same rows count as equal however they were summed."""
    short, long = F.round(short, 9), F.round(long, 9)
    s, l_ = F.lag(short).over(ordered()), F.lag(long).over(ordered())
    return (short > long) & (s <= l_), (short < long) & (s >= l_)


def _averages(name: str, smoother: str) -> None:
    """MACD*, Double* and Triple* signals of one kind of moving average: 1 from a cross upwards on, -1 from one downwards on."""

    def parts(frame: DataFrame, x: Column, spans: dict[str, int]) -> DataFrame:
        frame = frame.withColumn("xs", x)
        for column, n in spans.items():
            frame = TRANSFORMS[smoother](frame, x="xs", out=column, window=n)
        return frame

    def macd(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        up, down = _crossings(F.col("m2"), F.col("m1"))
        return held(parts(frame, x, {"m2": window // 2, "m1": window}), F.when(down, -1.0).when(up, 1.0), out).drop("xs", "m1", "m2")

    def double(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        up, down = _crossings(F.col("m2"), F.col("m1"))
        strong = TRANSFORMS["rsi_func"](parts(frame, x, {"m2": window // 2, "m1": window}), x="xs", out="rs", window=window)
        return held(strong, F.when(down & (F.col("rs") > 30), -1.0).when(up & (F.col("rs") < 70), 1.0), out).drop("xs", "m1", "m2", "rs")

    def triple(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        fast, medium = _crossings(F.col("m4"), F.col("m1")), _crossings(F.col("m2"), F.col("m1"))
        signalled = parts(frame, x, {"m4": window // 4, "m2": window // 2, "m1": window})
        return held(signalled, F.when(fast[1] & medium[1], -1.0).when(fast[0] & medium[0], 1.0), out).drop("xs", "m1", "m2", "m4")

    for kind, function in (("MACD", macd), ("Double", double), ("Triple", triple)):
        function.__name__ = f"{kind}{name}_func"
        transform(function)


_averages("Ma", "ma_func")
_averages("Ema", "ema_func")
_averages("Kama", "kama_func")


# Fractional differences.


def ffd_weights(d: float, thres: float = 1e-5, lim: int | None = None, most: int = 100_000) -> list[float]:
    """Binomial weights of the present, the row before, ... until one is below ``thres``."""
    found = [1.0]
    while len(found) < (lim or most):
        w = -found[-1] * (d - len(found) + 1) / len(found)
        if abs(w) < thres:
            break
        found.append(w)
    return found


@transform
def fracdiff(frame: DataFrame, x: Column, out: str, d: float, thres: float = 1e-5, lim: int | None = None, gap: int = 10, shift: int = 0) -> DataFrame:
    """Weighted sum over the values so far, those missing left out; null for the first ``gap`` values.

    ``shift`` drops the weights of the latest rows: value k then gets the weight of k + shift.
    """
    weights = ffd_weights(d, thres, lim)[shift:]
    return recursive.weighted_so_far(frame, x, out, weights, gap)


def _fracdiff_window(name: str, terms: Callable[[Column, Column, Column, int], Column], shifts: tuple[int, ...]) -> None:
    def function(frame: DataFrame, x: Column, out: str, d: float, window: int) -> DataFrame:
        frame = frame.withColumn("xs", x)
        for shift in shifts:
            frame = TRANSFORMS["fracdiff"](frame, x="xs", out=f"f{shift}", d=d, shift=shift)
        return frame.withColumn(out, terms(*(F.col(f"f{s}") for s in shifts), window)).drop("xs", *(f"f{s}" for s in shifts))

    function.__name__ = name
    transform(function)


def _whole_mean(x: Column, n: int) -> Column:
    return at_least(n, x, rows(n), F.avg(x).over(rows(n)))


_fracdiff_window("fracdiff_ma", lambda f0, n: _whole_mean(f0, n), (0,))
_fracdiff_window("fracdiff_rev", lambda f1, n: -_whole_mean(f1, n), (1,))
_fracdiff_window("fracdiff_marev", lambda f0, f1, f10, n: _whole_mean(f0, n) - 2 * f1 + f10, (0, 1, 10))


# Families: one transform at halving windows.

LEAST_WINDOW = 12


def halvings(window: int, least: int) -> list[int]:
    found = []
    while window >= least:
        found.append(window)
        window //= 2
    if not found:
        raise ValueError(f"a family needs a window of {least} rows or more")
    return found


def _mean_of(columns: list[Column]) -> Column:
    """Mean of those that aren't null."""
    n = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    return ratio(sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0))), n)


def _balance(columns: list[Column]) -> Column:
    """(sum of positives - sum of negatives' sizes) over the sum of both."""
    zero = F.lit(0.0)
    up = sum((F.greatest(F.coalesce(c, zero), zero) for c in columns), zero)
    down = sum((F.greatest(-F.coalesce(c, zero), zero) for c in columns), zero)
    return ratio(up - down, up + down)


def _family(name: str, combine: Callable[[list[Column]], Column]) -> None:
    def combined(frame: DataFrame, x: str, out: str, windows: list[int], tfunc: str) -> DataFrame:
        names = [f"{out}_{n}" for n in windows]
        for column, n in zip(names, windows, strict=True):
            frame = TRANSFORMS[tfunc](frame, x=x, out=column, window=n)
        return frame.withColumn(out, combine([F.col(c) for c in names])).drop(*names)

    def function(frame: DataFrame, x: Column, out: str, window: int, tfunc: str) -> DataFrame:
        return combined(frame.withColumn("xs", x), "xs", out, halvings(window, LEAST_WINDOW), tfunc).drop("xs")

    def reverse(frame: DataFrame, x: Column, out: str, window: int, tfunc: str, bars_a_day: int = 288) -> DataFrame:
        """The family's value against that of the history: x as many whole days back, over 24 days more and down to those days."""
        if window < bars_a_day:
            raise ValueError(f"a comparison with history needs a window of {bars_a_day} rows or more")
        back = window // bars_a_day * bars_a_day
        frame = held(frame.withColumn("xs", x).withColumn("__lag", F.lag(x, back).over(ordered())), F.col("__lag"), "xh")
        frame = combined(frame, "xs", "fam_now", halvings(window, LEAST_WINDOW), tfunc)
        frame = combined(frame, "xh", "fam_then", halvings(24 * bars_a_day + back, back), tfunc)
        now, then = F.col("fam_now"), F.col("fam_then")
        return frame.withColumn(out, ratio(now - then, F.abs(now) + F.abs(then))).drop("xs", "xh", "fam_now", "fam_then")

    function.__name__, reverse.__name__ = f"termtrend_{name}", f"termtrend_rev{name}"
    transform(function)
    transform(reverse)


_family("add", _mean_of)
_family("winr", lambda columns: _mean_of([F.signum(c) for c in columns]))
_family("plr", _balance)
