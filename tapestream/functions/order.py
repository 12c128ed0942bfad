"""Order statistics of sliding windows: quantiles and ranks in logarithmic time a row, whatever the window.

The values of a chunk of a series are put into a wavelet matrix: for each bit of their ranks, from the highest,
how many of the values before each place have a 0 there, the values being dealt stably by the bits
above. The k-th smallest value of any stretch, or how many of its values are below a bound, is found by
one step per bit, and numpy takes that step for all rows at once. Windows are stretches of the chunk,
so their length costs nothing but the rows that a chunk repeats from the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .frames import calendar_micros, ordered
from .scan import row_number

#: Rows of a chunk at row windows, and time of a chunk at calendar windows; at least, they hold their window.
CHUNK, SPAN = 100_000, "16d"


class Wavelet:
    """Order statistics of stretches of an array without NaN."""

    def __init__(self, values: np.ndarray):
        self.distinct, ranks = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.distinct) - 1).bit_length())
        self.zeros = np.zeros((self.bits, len(values) + 1), np.int32)
        for level in range(self.bits):
            ones = (ranks >> (self.bits - 1 - level)) & 1 == 1
            np.cumsum(~ones, out=self.zeros[level, 1:])
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of each stretch [lo, hi); it must hold so many."""
        lo, hi, k, rank = lo.copy(), hi.copy(), k.copy(), np.zeros(len(k), np.int64)
        for zeros in self.zeros:
            a, b = zeros[lo], zeros[hi]
            up = k >= b - a
            k -= np.where(up, b - a, 0)
            lo, hi = np.where(up, zeros[-1] + lo - a, a), np.where(up, zeros[-1] + hi - b, b)
            rank = rank * 2 + up
        return self.distinct[rank]

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, inclusive: bool) -> np.ndarray:
        """How many values of each stretch are below a bound, or equal to it too."""
        rank = np.searchsorted(self.distinct, bound, "right" if inclusive else "left")
        whole = rank >= 1 << self.bits  # all ranks are below
        count, a, b = np.where(whole, hi - lo, 0), lo, hi
        for level, zeros in enumerate(self.zeros):
            x, y = zeros[a], zeros[b]
            up = (rank >> (self.bits - 1 - level)) & 1 == 1
            count = count + np.where(up & ~whole, y - x, 0)
            a, b = np.where(up, zeros[-1] + a - x, x), np.where(up, zeros[-1] + b - y, y)
        return count


class Frames:
    """The windows [lo, hi) of the rows of a chunk, over one column of it; NaN stands for null."""

    def __init__(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.x, self.size = values, np.maximum(hi - lo, 0)
        present = ~np.isnan(values)
        seen = np.concatenate([[0], np.cumsum(present)])
        self.lo, self.hi = seen[lo], seen[np.maximum(lo, hi)]
        self.values, self.count = values[present], self.hi - self.lo

    @cached_property
    def tree(self) -> Wavelet:
        return Wavelet(self.values)

    def quantile(self, q: float) -> np.ndarray:
        """Linear between the two values beside it; NaN for windows without a value."""
        out, at = np.full(len(self.x), np.nan), np.flatnonzero(self.count > 0)
        if len(at):
            place = (self.count[at] - 1) * q
            under = np.floor(place).astype(np.int64)
            over = np.ceil(place).astype(np.int64)
            low, high = (self.tree.smallest(self.lo[at], self.hi[at], k) for k in (under, over))
            out[at] = np.where(under == over, low, (over - place) * low + (place - under) * high)
        return out

    def below(self, bound: np.ndarray, inclusive: bool = False) -> np.ndarray:
        """Values below a bound per row; none where the bound is NaN."""
        out, at = np.zeros(len(self.x), np.int64), np.flatnonzero((self.count > 0) & ~np.isnan(bound))
        if len(at):
            out[at] = self.tree.below(self.lo[at], self.hi[at], bound[at], inclusive)
        return out


def ratio_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0 or either NaN."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))


def _bounds(order: np.ndarray, group: np.ndarray, window: int | str, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of rows sorted by (group, order): the last ``window`` rows without the ``ahead`` latest, or the time (t - window, t]."""
    start = np.searchsorted(group, group, "left")
    if isinstance(window, int):
        hi = np.arange(len(order)) + 1 - ahead
        return np.minimum(np.maximum(start, np.arange(len(order)) + 1 - window), hi), hi
    width = calendar_micros(window)
    lo, hi = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for a, b in zip(*np.unique(start, return_counts=True), strict=True):
        own = order[a : a + b]
        lo[a : a + b], hi[a : a + b] = a + np.searchsorted(own, own - width, "right"), a + np.searchsorted(own, own, "right")
    return lo, hi


def framed(frame: DataFrame, out: str, window: int | str, inputs: dict[str, Column], value: Callable[[dict[str, Frames]], np.ndarray], by: Column | None = None, ahead: int = 0) -> DataFrame:
    """Adds ``value`` of each row's window to a frame; NaN becomes null.

    ``inputs`` are columns of doubles; ``value`` gets the windows over each of them by name. ``by`` keeps
    windows to rows of one value of it (a time of day), ``ahead`` leaves out the latest rows of a row window.
    Chunks are stretches of a series' rows, or of time, that begin with as much of the one before as a
    window is long; every row stays one row.
    """
    names, of = frame.columns, list(inputs)
    keyed = frame.withColumns({f"__in_{n}": F.nullif(c.cast("double"), F.lit(float("nan"))) for n, c in inputs.items()})
    keyed = keyed.withColumn("__by", F.lit(0) if by is None else by)
    if isinstance(window, int):
        chunk = max(CHUNK, window)
        group = [] if by is None else ["__by"]
        keyed = keyed.withColumn("__n", row_number(keyed) if by is None else F.row_number().over(ordered("__by")))
        keys, first, reach = ["series", *group, "__chunk"], F.floor(F.col("__n") / chunk), F.col("__n") % chunk > chunk - window
    else:
        width = calendar_micros(window)
        span = max(2 * width, calendar_micros(SPAN))
        keys, first, reach = ["series", "__chunk"], F.floor(F.col("us") / span), F.pmod(F.col("us"), F.lit(span)) > span - width
    dealt = keyed.withColumn("__chunk", F.explode(F.when(reach, F.array(first, first + 1)).otherwise(F.array(first)))).withColumn("__own", F.col("__chunk").eqNullSafe(first))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("__by", "ascending"), ("us", "ascending")])
        group = np.unique(part["__by"].to_numpy(), return_inverse=True)[1]
        bounds = _bounds(part["us"].fill_null(0).to_numpy(), group, window, ahead)
        found = value({n: Frames(part[f"__in_{n}"].to_numpy().astype(np.float64), *bounds) for n in of})
        return part.select(names).append_column(out, pa.array(found, pa.float64(), from_pandas=True)).filter(part["__own"])

    return dealt.groupBy(*keys).applyInArrow(run, StructType([*frame.schema.fields, StructField(out, DoubleType())]))
