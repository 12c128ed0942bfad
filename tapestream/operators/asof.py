"""As-of joins of large tables: each row with the last known row of another table, by key and time.

Both tables become rows of one, in which a value that is known at a time stands before the rows that ask at it. What
was last known is carried along by buckets of time (``functions.scan``): rows are shuffled once by key and
bucket, a key may be as hot and its history as long as it likes, and days without a change cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import calendar_micros
from ..functions.scan import running


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts", tolerance: str | None = None, span: str = "1d") -> DataFrame:
    """Rows of ``left`` with the other columns of the latest row of ``right`` at or before them, null without one.

    ``tolerance`` is the longest time back that counts, ``span`` the time of a bucket. One row of ``right`` for each key and time is
    expected; of more, any is taken. Null keys match each other; null times match nothing. ``right``'s time comes
    as ``<ts>_known``.
    """
    known = [c for c in right.columns if c not in (*keys, ts)]
    clash = sorted({*known, f"{ts}_known"} & {*left.columns})
    if clash:
        raise ValueError(f"both tables have {', '.join(clash)}")
    payload = F.struct(F.col(ts).alias(f"{ts}_known"), *known)
    series = F.struct(*keys).alias("series")
    time = F.unix_micros(F.col(ts).cast("timestamp")) * 2  # what is known at a time comes before what asks
    asks = left.select(series, (time + 1).alias("us"), F.struct("*").alias("row"))
    tells = right.where(F.col(ts).isNotNull()).select(series, time.alias("us"), payload.alias("tells"))
    together = asks.unionByName(tells, allowMissingColumns=True)
    carried = running(together, {}, {"held": F.col("tells")}, span=span).where("row is not null")
    fresh = F.col("us").isNotNull()
    if tolerance:
        fresh &= F.floor(F.col("us") / 2) - F.unix_micros(F.col(f"held.{ts}_known").cast("timestamp")) <= calendar_micros(tolerance)
    held = F.when(fresh, F.col("held"))
    return carried.select("row.*", *(held[c].alias(c) for c in (f"{ts}_known", *known)))
