"""Time-series transforms of a factor.

``TRANSFORMS[name](frame, x=column, out=column, **parameters)`` adds a column to a frame of
(series, ts, ...). Missing values are null; a window of ``n`` rows counts rows of the dense grid and a
calendar window such as '30d' covers (t - 30 days, t]. All windows of a series have one order, so
transforms added to one frame share its exchange and sort. Ratios with a zero denominator are null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .frames import MICROS, at_least, bars, bucket, clock, day, ordered, ratio, rows, timed, trailing
from .order import Frames, framed, ratio_of
from .scan import row_number

Window_ = int | str
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def transform(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers a transform; frames get their order column, and temporary columns (``__*``) go."""

    def added(frame: DataFrame, x: str = "value", out: str = "out", **parameters) -> DataFrame:
        had_order = "us" in frame.columns
        before = set(frame.columns)
        counted = f"{x}#n"  # what ``scan.placed`` counted
        ready = timed(frame).withColumn("__count", F.col(f"`{counted}`")) if counted in before else timed(frame)
        result = function(ready, F.col(x), out, **parameters)
        return result.drop(*[c for c in result.columns if c.startswith("__") and c not in before], *([] if had_order else ["us"]))

    added.__name__, added.__doc__ = function.__name__, function.__doc__
    TRANSFORMS[function.__name__] = added
    return added


def _simple(name: str, value: Callable[[Column, WindowSpec], Column]) -> None:
    def function(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
        return frame.withColumn(out, value(x, trailing(window)))

    function.__name__ = name
    transform(function)


def unbiased_skew(x: Column, w: WindowSpec) -> Column:
    """Bias-corrected, from three values on; 0 for equal values."""
    n = F.count(x).over(w).cast("double")
    return F.when(n >= 3, F.coalesce(F.skewness(x).over(w), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(x: Column, w: WindowSpec) -> Column:
    """Bias-corrected excess, from four values on; -3 for equal values."""
    n = F.count(x).over(w).cast("double")
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6), F.lit(-3.0)))


for _name, _value in {
    "mean": lambda x, w: F.avg(x).over(w),
    "std": lambda x, w: F.stddev_samp(x).over(w),
    "rmin": lambda x, w: F.min(x).over(w),
    "rmax": lambda x, w: F.max(x).over(w),
    "skew": unbiased_skew,
    "kurt": unbiased_kurtosis,
}.items():
    _simple(_name, _value)


@transform
def iqr(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Distance of the quartiles."""
    return framed(frame, out, window, {"x": x}, lambda f: f["x"].quantile(0.75) - f["x"].quantile(0.25))


def _z(x: Column, w: WindowSpec) -> Column:
    return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


@transform
def zscore(frame: DataFrame, x: Column, out: str, period_str: str) -> DataFrame:
    """(x - mean) / std over a calendar window."""
    return frame.withColumn(out, _z(x, trailing(period_str)))


@transform
def zscore_fxwd(frame: DataFrame, x: Column, out: str, period_str: str, freq: str = "1min") -> DataFrame:
    """``zscore`` over the bars of a trading duration (four hours a day)."""
    return frame.withColumn(out, _z(x, rows(bars(period_str, freq))))


@transform
def zsc(frame: DataFrame, x: Column, out: str, period_str: str, freq: str = "1min") -> DataFrame:
    return frame.withColumn(out, _z(x, rows(bars(period_str, freq))))


def _day_shift(n: int) -> WindowSpec:
    """The row of the same clock time ``n`` calendar days before."""
    return ordered().rangeBetween(-n * MICROS["d"], -n * MICROS["d"])


@transform
def dod(frame: DataFrame, x: Column, out: str, n: int = 1) -> DataFrame:
    """x over its value ``n`` days before at the same clock time."""
    return frame.withColumn(out, ratio(x, F.first(x).over(_day_shift(n))))


@transform
def dod_three_minutes(frame: DataFrame, x: Column, out: str, n: int = 1) -> DataFrame:
    """x over the mean of three rows around that time ``n`` days before; null if one is missing."""
    around = (F.lag(x).over(ordered()) + x + F.lead(x).over(ordered())) / 3
    return frame.withColumn("__around", around).withColumn(out, ratio(x, F.first("__around").over(_day_shift(n))))


def _sloped(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    w = trailing(window)
    numbered = frame.withColumn("__row", row_number(frame).cast("double"))
    whole = (F.count(x).over(w) == F.count("*").over(w)) & (F.count("*").over(w) >= 2)
    return numbered.withColumn(out, F.when(whole, F.regr_slope(x, F.col("__row")).over(w) * F.count("*").over(w)))


@transform
def slope(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Rows of the frame times the slope of x on the row number; null if the frame lacks a value."""
    return _sloped(frame, x, out, window)


@transform
def rsi(frame: DataFrame, x: Column, out: str, period: int) -> DataFrame:
    """Relative strength by simple means of ``period`` gains and losses; a missing step is neither."""
    step = x - F.lag(x).over(ordered())
    moved = frame.withColumn("__gain", F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)) * step.isNotNull().cast("double")).withColumn("__loss", F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0)) * step.isNotNull().cast("double"))
    gain, loss = (at_least(period, F.col(c), rows(period), F.avg(c).over(rows(period))) for c in ("__gain", "__loss"))
    return moved.withColumn("__g", gain).withColumn("__l", loss).withColumn(out, F.when((F.col("__l") == 0) & (F.col("__g") > 0), 100.0).otherwise(100 - 100 / (1 + ratio(F.col("__g"), F.col("__l")))))


# Transforms of a window's values in order. Frames are collected as structs, which keeps null cells.


def _values(x: Column, w: WindowSpec) -> Column:
    return F.collect_list(F.struct(x.cast("double").alias("x"))).over(w)


def _framed(frame: DataFrame, x: Column, window: Window_) -> DataFrame:
    return frame.withColumn("__a", _values(x, trailing(window)))


def _steps(a: Column) -> Column:
    """Differences of neighbours that both have a value."""
    steps = F.transform(F.sequence(F.lit(2), F.size(a)), lambda i: F.element_at(a, i)["x"] - F.element_at(a, i - 1)["x"])
    return F.when(F.size(a) >= 2, F.filter(steps, lambda d: d.isNotNull())).otherwise(F.array().cast("array<double>"))


def _directions(frame: DataFrame, x: Column, window: Window_) -> DataFrame:
    steps = _framed(frame, x, window).withColumn("__d", _steps(F.col("__a")))
    return steps.withColumn("__s", F.transform("__d", lambda d: F.signum(d))).withColumn("__k", F.size("__s"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


@transform
def trendContinuation(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Share of steps in the direction of the first, with its sign; from two steps on."""
    first = F.element_at("__s", 1)
    return _directions(frame, x, window).withColumn(out, F.when(F.col("__k") >= 2, F.size(F.filter("__s", lambda s: s == F.get("__s", F.lit(0)))) / F.col("__k") * first))


@transform
def trendReversalRate(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Changes of direction, the first step counting as one, over steps less one; negative if the last step falls."""
    turns = F.size(F.filter(F.sequence(F.lit(1), F.col("__k")), lambda i: (i == 1) | (F.get("__s", i - 1) != F.get("__s", i - 2))))
    rate = turns / (F.col("__k") - 1)
    return _directions(frame, x, window).withColumn(out, F.when(F.col("__k") >= 2, F.when(F.element_at("__s", -1) < 0, -rate).otherwise(rate)))


@transform
def meanTrendDirectionConsistency(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Mean direction of the steps."""
    return _directions(frame, x, window).withColumn(out, F.when(F.col("__k") >= 2, _total(F.col("__s")) / F.col("__k")))


@transform
def trendDirectionEntropy(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Entropy (bits) of the steps' directions."""
    shares = [F.size(F.filter("__s", _is(sign))) / F.col("__k") for sign in (-1.0, 0.0, 1.0)]
    parts = [F.when(p > 0, -p * F.log2(p + 1e-9)).otherwise(0.0) for p in shares]
    return _directions(frame, x, window).withColumn(out, F.when(F.col("__k") >= 2, parts[0] + parts[1] + parts[2]))


def _is(value: float) -> Callable[[Column], Column]:
    return lambda s: s == value


@transform
def trendStrengthRatio(frame: DataFrame, x: Column, out: str, window: Window_) -> DataFrame:
    """Range of the values over the deviation of the steps, with the sign of their mean."""
    w = trailing(window)
    mean = _total(F.col("__d")) / F.col("__k")
    moved = _directions(frame, x, window).withColumn("__m", F.when(F.col("__k") >= 2, mean))
    noise = F.sqrt(F.aggregate("__d", F.lit(0.0), lambda s, d: s + (d - F.col("__m")) * (d - F.col("__m"))) / F.col("__k"))
    return moved.withColumn(out, F.when(F.col("__k") >= 2, (F.max(x).over(w) - F.min(x).over(w)) / (noise + 1e-9) * F.signum("__m")))


def _rank(long: Frames, bound: np.ndarray) -> np.ndarray:
    """Share of the window below a bound, null cells counting; from two rows on, one of them with a value."""
    return np.where((long.size >= 2) & (long.count >= 1), long.below(bound) / np.maximum(long.size, 1), np.nan)


def _ranked(frame: DataFrame, x: Column, short: int, long: int) -> DataFrame:
    """__r: rank of the mean of the short frame within the long one."""
    return framed(frame, "__r", long, {"x": x, "mean": F.avg(x).over(rows(short))}, lambda f: _rank(f["x"], f["mean"].x))


@transform
def relativePercentileChange(frame: DataFrame, x: Column, out: str, short_window: int, long_window: int) -> DataFrame:
    """Change of the short mean's rank within the long window."""
    return _ranked(frame, x, short_window, long_window).withColumn(out, F.col("__r") - F.lag("__r").over(ordered()))


def _short_trend(x: Column, short: int, long: int) -> Column:
    """Sign of the change over ``short`` rows, which must lie within the long window."""
    return F.signum(x - F.lag(x, short).over(ordered())) if short < long else F.lit(None).cast("double")


@transform
def layeredPercentileTrend(frame: DataFrame, x: Column, out: str, short_window: int, long_window: int) -> DataFrame:
    """That rank with the sign of the short change."""
    return _ranked(frame, x, short_window, long_window).withColumn("__t", _short_trend(x, short_window, long_window)).withColumn(out, F.col("__r") * F.col("__t"))


@transform
def relativeExtremeTrend(frame: DataFrame, x: Column, out: str, short_window: int, long_window: int) -> DataFrame:
    """Place of the short mean between the long window's extremes, with the sign of the short change."""
    w = rows(long_window)
    place = (F.avg(x).over(rows(short_window)) - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-9)
    return frame.withColumn(out, F.when(F.count("*").over(w) >= 2, place * _short_trend(x, short_window, long_window)))


@transform
def shortLongTrendInteraction(frame: DataFrame, x: Column, out: str, short_window: int, long_window: int) -> DataFrame:
    """Null for every row: the long change never fits into the long window (kept as it is defined)."""
    return frame.withColumn(out, F.lit(None).cast("double"))


@transform
def trendInteraction(frame: DataFrame, x: Column, out: str, short_window: int, long_window: int) -> DataFrame:
    """What ``shortLongTrendInteraction`` means to be: mean short change times the change over the long window."""
    moved = frame.withColumn("__step", x - F.lag(x, short_window).over(ordered()))
    return moved.withColumn(out, F.avg("__step").over(rows(long_window)) * (x - F.lag(x, long_window - 1).over(ordered())))


@transform
def percentileTrendAcceleration(frame: DataFrame, x: Column, out: str, short_window: int, long_window: int) -> DataFrame:
    """Rank of the short mean less the rank of the short mean one row before, both within the long window."""
    before = F.avg(x).over(ordered().rowsBetween(-min(short_window, long_window - 1), -1)) if long_window > 1 else F.lit(None)
    means = {"x": x, "now": F.avg(x).over(rows(short_window)), "before": before}
    return framed(frame, out, long_window, means, lambda f: _rank(f["x"], f["now"].x) - _rank(f["x"], f["before"].x))


# Scaling and ranking within windows, also of one time of day.


@transform
def rollingRemoveIntradayEffect(frame: DataFrame, x: Column, out: str, window: str = "30d") -> DataFrame:
    """x less its mean at the same clock time over the window."""
    return frame.withColumn("__c", clock()).withColumn(out, x - F.avg(x).over(trailing(window, "__c")))


def _place(of: Frames, least: int, low: float, high: float) -> np.ndarray:
    """A row's value between two quantiles of its window; NaN without ``least`` values."""
    a, b = of.quantile(low), of.quantile(high)
    return np.where(of.count >= least, ratio_of(of.x - a, b - a), np.nan)


def _scaled(of: Frames, least: int, q: float) -> np.ndarray:
    return np.clip(_place(of, least, q, 1 - q), 0, 1)


def _share(of: Frames, least: int, above: bool = False) -> np.ndarray:
    """Share of the window's rows whose value is at most a row's own (at least, with ``above``); 0 for a row without one."""
    n = of.below(of.x, inclusive=not above)
    n = np.where(np.isnan(of.x), 0, of.count - n) if above else n
    return np.where(of.count >= least, n / np.maximum(of.size, 1), np.nan)


def _clocked(frame: DataFrame, exact: bool, interval: int) -> Column:
    return clock() if exact else bucket(interval)


def _by_clock(name: str, value: Callable[..., Column], exact: bool = False) -> None:
    """A transform over the rows of one time of day: of its exact clock time, or of its bucket of ``interval`` minutes."""

    def of_bucket(frame: DataFrame, x: Column, out: str, window: Window_ = "30d", min_periods: int = 1, quantile: float = 0.05, interval: int = 5) -> DataFrame:
        return frame.withColumn("__c", _clocked(frame, exact, interval)).withColumn(out, value(x, trailing(window, "__c"), min_periods))

    of_bucket.__name__ = name
    transform(of_bucket)


def _ordered_by_clock(name: str, value: Callable[[Frames, int, float], np.ndarray], exact: bool = False) -> None:
    """The same for order statistics."""

    def of_bucket(frame: DataFrame, x: Column, out: str, window: Window_ = "30d", min_periods: int = 1, quantile: float = 0.05, interval: int = 5) -> DataFrame:
        return framed(frame, out, window, {"x": x}, lambda f: value(f["x"], min_periods, quantile), by=_clocked(frame, exact, interval))

    of_bucket.__name__ = name
    transform(of_bucket)


for _name, _value in (
    ("rollingMinuteZScore", lambda x, w, k: at_least(k, x, w, _z(x, w))),
    ("aggZsc", lambda x, w, k: at_least(k, x, w, _z(x, w))),
    ("rollingMinuteDeMean", lambda x, w, k: at_least(k, x, w, x - F.avg(x).over(w))),
    ("aggDmean", lambda x, w, k: at_least(k, x, w, x - F.avg(x).over(w))),
    ("aggDivMean", lambda x, w, k: at_least(k, x, w, ratio(x, F.avg(x).over(w)))),
    ("aggDivMean_parallel", lambda x, w, k: at_least(k, x, w, ratio(x, F.avg(x).over(w)))),
):
    _by_clock(_name, _value)
for _name, _statistic, _exact in (
    ("rollingMinuteQuantileScale", _scaled, True),
    ("rollingAggMinuteMinMaxScale", _scaled, False),
    ("aggMinmax", _scaled, False),
    ("rollingAggMinutePercentile", lambda f, k, q: 100 * _share(f, k, above=True), False),
    ("rollingAggMinutePctl", lambda f, k, q: _share(f, k), False),
    ("aggPctl", lambda f, k, q: _share(f, k), False),
):
    _ordered_by_clock(_name, _statistic, _exact)


@transform
def minmax(frame: DataFrame, x: Column, out: str, window: Window_ = 20, min_periods: int = 10, quantile: float = 0.05) -> DataFrame:
    """x between two quantiles of its window, clipped to [0, 1]."""
    return framed(frame, out, window, {"x": x}, lambda f: _scaled(f["x"], min_periods, quantile))


TRANSFORMS["minmax_scale"] = minmax


@transform
def minmax_scale_numba_parallel(frame: DataFrame, x: Column, out: str, window: Window_ = 20, min_periods: int = 10, quantile: float = 0.05) -> DataFrame:
    """``minmax`` of single-precision values with 0 for null, and 1e-12 added to the range."""

    def value(f: dict[str, Frames]) -> np.ndarray:
        low, high = f["x"].quantile(quantile), f["x"].quantile(1 - quantile)
        return np.where(f["x"].count >= min_periods, np.clip((f["x"].x - low) / (high - low + 1e-12), 0, 1), np.nan)

    return framed(frame, out, window, {"x": F.coalesce(x, F.lit(0.0)).cast("float")}, value)


@transform
def rlPctl(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
    """Share of the rows before with a value that is at most x; 0 for a null x, null without such rows."""

    def value(f: dict[str, Frames]) -> np.ndarray:
        return np.where(f["x"].count > 0, f["x"].below(f["x"].x, inclusive=True) / np.maximum(f["x"].count, 1), np.nan)

    return framed(frame, out, window, {"x": x}, value, ahead=1)


@transform
def minmaxSep(frame: DataFrame, x: Column, out: str, window: Window_ = 20, min_periods: int = 10, quantile: float = 0.05) -> DataFrame:
    """Positive values scaled to [0.5, 1], negative ones to [0, 0.5] with the deepest at 0.5; 0 gives null."""

    def value(f: dict[str, Frames]) -> np.ndarray:
        positive = 0.5 + 0.5 * _place(f["up"], min_periods, quantile, 1 - quantile)
        negative = 0.5 * _place(f["down"], min_periods, 1 - quantile, quantile)
        return np.clip(np.where(np.isnan(f["up"].x), negative, positive), 0, 1)

    return framed(frame, out, window, {"up": F.when(x > 0, x), "down": F.when(x < 0, x)}, value)


# Of single values.


@transform
def bimodal_sin(frame: DataFrame, x: Column, out: str, power: float = 2) -> DataFrame:
    return frame.withColumn(out, 1 - F.pow(F.sin(F.pi() * x), F.lit(float(power))))


@transform
def absv(frame: DataFrame, x: Column, out: str) -> DataFrame:
    return frame.withColumn(out, F.abs(x))


@transform
def exp(frame: DataFrame, x: Column, out: str) -> DataFrame:
    return frame.withColumn(out, F.exp(x))


@transform
def power(frame: DataFrame, x: Column, out: str, gamma: float, direction: str = "pos") -> DataFrame:
    """x ** gamma ('pos') or (1 - x) ** gamma ('neg') on [0, 1]; null outside."""
    if gamma <= 0 or direction not in ("pos", "neg"):
        raise ValueError(f"power needs gamma > 0 and direction 'pos' or 'neg', not {gamma}, {direction!r}")
    return frame.withColumn(out, F.when(x.between(0, 1), F.pow(x if direction == "pos" else 1 - x, F.lit(float(gamma)))))


# Within one calendar day.


@transform
def OAD(frame: DataFrame, x: Column, out: str, reference_time: str = "0930") -> DataFrame:
    """The day's last value so far less its value at the reference time; null before that."""
    w = ordered("__day").rowsBetween(Window.unboundedPreceding, 0)
    filled = frame.withColumn("__day", day()).withColumn("__f", F.last(x, ignorenulls=True).over(w))
    at = F.date_format("ts", "HHmm") == reference_time
    return filled.withColumn(out, F.col("__f") - F.last(F.when(at & (F.second("ts") == 0), F.col("__f")), ignorenulls=True).over(w))


def _of_day(name: str, value: Callable[[Column, WindowSpec], Column]) -> None:
    def function(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        return frame.withColumn("__day", day()).withColumn(out, value(x, rows(window, "__day")))

    function.__name__ = name
    transform(function)


_of_day("intraSma", lambda x, w: F.avg(x).over(w))
_of_day("intraSum", lambda x, w: F.sum(x).over(w))


@transform
def intraCumSum(frame: DataFrame, x: Column, out: str) -> DataFrame:
    """Running sum of the day; null where x is."""
    return frame.withColumn("__day", day()).withColumn(out, F.when(x.isNotNull(), F.sum(x).over(ordered("__day").rowsBetween(Window.unboundedPreceding, 0))))


TRANSFORMS["intraCumSum_parallel"] = intraCumSum
