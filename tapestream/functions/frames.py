"""Window frames and duration grammars that the transforms share.

A series frame has the columns ``series``, ``ts`` (no time zone) and ``us`` (microseconds, the order
of every window). Row frames count rows, null cells included, so frames are dense grids.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Microseconds of the units of calendar durations such as '30d' or '5min'.
MICROS = {"d": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000}
#: Seconds of the units of trading durations; a trading day has four hours.
TRADING_SECONDS = {"d": 14_400, "h": 3_600, "min": 60, "s": 1}


def _parts(text: str, units: dict[str, int]) -> int:
    found = re.findall(r"(\d+)(d|h|min|s)", text)
    if not found or "".join(n + u for n, u in found) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * units[u] for n, u in found)


def calendar_micros(text: str) -> int:
    return _parts(text.lower(), MICROS)


def trading_seconds(text: str) -> int:
    return _parts(text, TRADING_SECONDS)


def bars(period: str, freq: str = "1min") -> int:
    """Whole bars of ``freq`` in a trading duration; fewer than one is an error."""
    n = trading_seconds(period) // trading_seconds(freq)
    if n < 1:
        raise ValueError(f"{period!r} holds no bar of {freq!r}")
    return n


def timed(frame: DataFrame) -> DataFrame:
    """Adds ``us`` if it isn't there."""
    return frame if "us" in frame.columns else frame.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def ordered(*more: Column | str) -> WindowSpec:
    return Window.partitionBy("series", *more).orderBy("us")


def rows(n: int, *more: Column | str) -> WindowSpec:
    """The last ``n`` rows, the current one included."""
    return ordered(*more).rowsBetween(1 - n, 0)


def trailing(window: int | str, *more: Column | str) -> WindowSpec:
    """``rows`` for a number; for a calendar duration the time (t - window, t]."""
    return rows(window, *more) if isinstance(window, int) else ordered(*more).rangeBetween(1 - calendar_micros(window), 0)


def clock() -> Column:
    """Exact time of day."""
    return F.date_format("ts", "HH:mm:ss.SSSSSS")


def bucket(minutes: int) -> Column:
    """Time of day in steps of ``minutes`` within the hour."""
    return F.hour("ts") * 60 + F.floor(F.minute("ts") / minutes) * minutes


def day() -> Column:
    return F.to_date("ts")


def at_least(k: int, x: Column, frame: WindowSpec, value: Column) -> Column:
    """``value`` where the frame has ``k`` values that aren't null."""
    return F.when(F.count(x).over(frame) >= k, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def between_0_and_1(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
