"""Transforms that carry a state from row to row, and transforms of a window's spectrum.

A series is cut into chunks of values that overlap by as many as the state remembers (its older share
is below double precision), so a long series is spread over many tasks. Rows keep all their columns on
the way, so nothing is joined back. Recursions run in blocks of closed form, spectra as running sums by frequency.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .frames import day, ordered
from .order import Frames, framed, ratio_of
from .rolling import TRANSFORMS, Window_, _rank, transform
from .states import STATES

CHUNK = 100_000
#: What is left of a state after its memory: below this share nothing of a double changes.
FORGOTTEN = 1e-18


def memory(alpha: float) -> int:
    """Rows after which exponential smoothing has forgotten."""
    return 1 if alpha >= 1 else math.ceil(math.log(FORGOTTEN) / math.log1p(-alpha))


def _with_states(rows: DataFrame, frame: DataFrame, out: str, keys: tuple[str, ...], function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``frame``'s columns and ``function`` of ``__x`` along each group of ``rows``; rows of a group that aren't its ``__own`` only lead in."""
    names = frame.columns

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("us", "ascending"), ("__n", "ascending")])
        found = function(part["__x"].to_numpy().astype(np.float64))
        return part.select(names).append_column(out, pa.array(found, pa.float64(), from_pandas=True)).filter(part["__own"])

    return rows.groupBy(*keys).applyInArrow(run, StructType([*frame.schema.fields, StructField(out, DoubleType())]))


def chunked(frame: DataFrame, x: Column, out: str, function: Callable[[np.ndarray], np.ndarray], rows: int, chunk: int = CHUNK) -> DataFrame:
    """Adds ``function`` of a series' values in order (NaN where null; NaN results are null); it depends on ``rows`` values before at most.

    Chunks count values, and nulls go with the value before them, so a gap costs no memory of the state.
    Chunks are no shorter than that memory, so each row is sent twice at most. Every row stays one row,
    those of one time and those of a null series too. Values are counted along the series, or by
    ``scan.placed``.
    """
    chunk = max(chunk, rows)
    valued = frame.withColumn("__x", F.nullif(x.cast("double"), F.lit(float("nan"))))
    so_far = F.col("__count") if "__count" in frame.columns else F.count("__x").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    counted = valued.withColumn("__n", so_far)
    first = F.floor(F.col("__n") / chunk)
    lead = F.when(F.col("__n") % chunk >= chunk - rows, F.array(first, first + 1)).otherwise(F.array(first))
    dealt = counted.withColumn("__chunk", F.explode(lead)).withColumn("__own", F.col("__chunk") == first)
    return _with_states(dealt, frame, out, ("series", "__chunk"), function)


@transform
def ewma(frame: DataFrame, x: Column, out: str, span: float) -> DataFrame:
    return chunked(frame, x, out, lambda v: STATES["ewma"](span=span).run(v), memory(2 / (span + 1)))


@transform
def intraEwma(frame: DataFrame, x: Column, out: str, span: float) -> DataFrame:
    """``ewma`` that begins anew each day."""
    daily = frame.withColumn("__x", x.cast("double")).withColumn("__n", F.lit(0)).withColumn("__own", F.lit(True)).withColumn("__day", day())
    return _with_states(daily, frame, out, ("series", "__day"), lambda v: STATES["ewma"](span=span).run(v))


# Spectra.


def _spectral(f: Frames, cutoff: float, interval: float, least: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over frequencies up to the cutoff of ``of`` the squared magnitudes; NaN where a window has a null cell or fewer than ``least`` rows.

    The transforms of all windows of one length come from running sums of the values turned by each frequency that
    counts, so a row costs these and not its window; where few windows have a length, each is transformed by itself.
    """
    out = np.full(len(f.x), np.nan)
    whole = (f.count == f.size) & (f.size >= max(least, 1))
    for n in np.unique(f.size[whole]).tolist():
        at = np.flatnonzero(whole & (f.size == n))
        k = np.flatnonzero(np.fft.rfftfreq(n, interval) <= cutoff)
        twice = np.where((k == 0) | (2 * k == n), 1.0, 2.0)  # a frequency and its conjugate
        if len(at) * n <= len(f.values):
            held = np.abs(np.fft.rfft(f.values[f.lo[at, None] + np.arange(n)], axis=1)[:, k]) ** 2
            out[at] = (of(held) * twice).sum(axis=1)
        else:
            total = np.zeros(len(at))
            for one, weight in zip(k.tolist(), twice.tolist(), strict=True):
                turned = np.concatenate([[0], np.cumsum(f.values * np.exp(-2j * np.pi * one / n * (np.arange(len(f.values)) % n)))])
                total += weight * of(np.abs(turned[f.hi[at]] - turned[f.lo[at]]) ** 2)
            out[at] = total
    return out


def _energy(f: Frames) -> np.ndarray:
    """Sum of all squared magnitudes of a window's transform, by Parseval's theorem; exactly 0 for zeros."""
    squares = np.concatenate([[0], np.cumsum(f.values**2)])
    some = np.concatenate([[0], np.cumsum(f.values != 0)])
    return np.where(some[f.hi] > some[f.lo], f.size * (squares[f.hi] - squares[f.lo]), 0.0)


@transform
def lowFreqEnergyRatio(frame: DataFrame, x: Column, out: str, window: Window_, cutoff_freq: float, sampling_interval: float = 1) -> DataFrame:
    """Share of the window's energy at frequencies up to the cutoff."""
    return framed(frame, out, window, {"x": x}, lambda f: ratio_of(_spectral(f["x"], cutoff_freq, sampling_interval, 1, lambda e: e), _energy(f["x"])))


@transform
def phaseTimesMagnitude(frame: DataFrame, x: Column, out: str, window: Window_, cutoff_freq: float, sampling_interval: float = 1) -> DataFrame:
    """Sum of phase times magnitude over those frequencies.

    Conjugate frequencies cancel each other, so what is left is that of 0 and of half the sampling rate, whose
    terms are real: pi times their size where they are negative. Adding the phases up instead would
    give rounding errors, and a whole turn where an imaginary part is rounded to 0.
    """

    def value(frames: dict[str, Frames]) -> np.ndarray:
        f = frames["x"]
        whole = (f.count == f.size) & (f.size >= 2)
        sign = np.where(np.arange(len(f.values)) % 2 == 0, 1.0, -1.0)
        plain, turned = (np.concatenate([[0], np.cumsum(v)]) for v in (f.values, f.values * sign))
        total = np.minimum(plain[f.hi] - plain[f.lo], 0) if cutoff_freq >= 0 else np.zeros(len(f.x))
        half = (turned[f.hi] - turned[f.lo]) * np.where(f.lo % 2 == 0, 1.0, -1.0)
        total = total + np.where((f.size % 2 == 0) & (0.5 / sampling_interval <= cutoff_freq), np.minimum(half, 0), 0.0)
        return np.where(whole, -np.pi * total, np.nan)

    return framed(frame, out, window, {"x": x}, value)


def freq_to_minutes(cutoff_freq: float) -> str:
    if cutoff_freq <= 0:
        raise ValueError("the cutoff must be positive")
    return f"{round(1 / cutoff_freq)}min"


def _with_slope(frame: DataFrame, x: Column, out: str, window: Window_, cutoff: float, interval: float, of: Callable[[Column], Column]) -> DataFrame:
    frame = frame.withColumn("xs", x)
    ratio_ = TRANSFORMS["lowFreqEnergyRatio"](frame, x="xs", out="er", window=window, cutoff_freq=cutoff, sampling_interval=interval)
    sloped = TRANSFORMS["slope"](ratio_, x="xs", out="sl", window=freq_to_minutes(cutoff))
    return sloped.withColumn(out, F.col("er") * of(F.col("sl"))).drop("xs", "er", "sl")


@transform
def lowFreqEnergyRatio_x_slope(frame: DataFrame, x: Column, out: str, window: Window_, cutoff_freq: float, sampling_interval: float = 1) -> DataFrame:
    return _with_slope(frame, x, out, window, cutoff_freq, sampling_interval, lambda s: s)


@transform
def lowFreqEnergyRatio_x_slpsign(frame: DataFrame, x: Column, out: str, window: Window_, cutoff_freq: float, sampling_interval: float = 1) -> DataFrame:
    return _with_slope(frame, x, out, window, cutoff_freq, sampling_interval, F.signum)


@transform
def lowFreqWithPosTrend(frame: DataFrame, x: Column, out: str, fft_window: Window_, pos_window: Window_, freq_cutoff: float, sampling_interval: float = 1) -> DataFrame:
    """Summed low-frequency magnitude, negative unless x is above more than half of its position window."""
    spectrum = framed(frame, "__amp", fft_window, {"x": x}, lambda f: _spectral(f["x"], freq_cutoff, sampling_interval, 2, np.sqrt))
    ranked = framed(spectrum, "__p", pos_window, {"x": x}, lambda f: _rank(f["x"], f["x"].x))
    return ranked.withColumn(out, F.col("__amp") * F.when(F.col("__p") > 0.5, 1.0).when(F.col("__p").isNotNull(), -1.0))


# Smoothers of technical analysis, by their public definitions (``states``). Rows without a value are skipped.


def _smoother(name: str, remembers: Callable[[int], int]) -> None:
    def added(frame: DataFrame, x: Column, out: str, window: int) -> DataFrame:
        return chunked(frame, x, out, lambda v: STATES[name](window=window).run(v), remembers(window))

    added.__name__ = name
    transform(added)


#: Values that a smoother looks back over, by its window.
REMEMBERS: dict[str, Callable[[int], int]] = {
    "ema_func": lambda n: 2 * n + memory(2 / (n + 1)),
    "dema_func": lambda n: 3 * n + 2 * memory(2 / (n + 1)),
    "t3_func": lambda n: 7 * n + 6 * memory(2 / (n + 1)),
    "kama_func": lambda n: n + memory((2 / 31) ** 2),
    "rsi_func": lambda n: 2 * n + memory(1 / n),
    "cmo_func": lambda n: 2 * n + memory(1 / n),
    "macd_func": lambda n: 3 * n + 9 + 2 * memory(2 / (n + 1)) + memory(0.2),
    "htTrendline_func": lambda _: 2000,
}
for _name, _remembers in REMEMBERS.items():
    _smoother(_name, _remembers)


# Sums over all values so far, by weights.


def convolved(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weights[j] * values[i - j] over the values there are: directly for few weights, else by overlapping blocks of transforms."""
    n, m = len(values), len(weights)
    if not n or not m:
        return np.zeros(n)
    if m <= 64:
        return np.convolve(values, weights)[:n]
    size = 1 << (4 * m - 1).bit_length()
    step, turned = size - m + 1, np.fft.rfft(weights, size)
    padded = np.concatenate([np.zeros(m - 1), values])
    blocks = [np.fft.irfft(np.fft.rfft(padded[a : a + size], size) * turned, size)[m - 1 : m - 1 + min(step, n - a)] for a in range(0, n, step)]
    return np.concatenate(blocks)


def weighted_so_far(frame: DataFrame, x: Column, out: str, weights: list[float], gap: int) -> DataFrame:
    """Adds the weighted sum of the latest values, the present one first; null for a null and for the first ``gap`` values."""
    held = np.array(weights)

    def run(values: np.ndarray) -> np.ndarray:
        out, at = np.full(len(values), np.nan), np.flatnonzero(~np.isnan(values))
        out[at[gap:]] = convolved(values[at], held)[gap:]
        return out

    return chunked(frame, x, out, run, max(len(weights), gap, 1))
