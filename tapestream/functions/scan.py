"""Running values of long series: prefix scans in two passes over time buckets.

A window without a lower bound puts a series into one task. Here each (series, bucket of time) is a group
of its own; a small table of the buckets' totals is scanned for what comes before each of them, and
joined back on the same keys, so rows are shuffled once and one series spreads over as many tasks as it
has buckets. Buckets come from the rows' times alone: every pass and every repeated task sees the
same ones. Only the table of buckets has a window over a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import calendar_micros, ordered

#: Time of a bucket: a day of minute bars is some hundred rows.
SPAN = "1d"
BUCKET = "__bucket"


def bucketed(frame: DataFrame, span: str = SPAN) -> DataFrame:
    return frame.withColumn(BUCKET, F.floor(F.col("us") / calendar_micros(span)).cast("long"))


def _so_far(key: str):
    return Window.partitionBy(key).orderBy("us").rowsBetween(Window.unboundedPreceding, 0)


def running(frame: DataFrame, sums: dict[str, Column], lasts: dict[str, Column] | None = None, span: str = SPAN) -> DataFrame:
    """Adds running values of each series in the order of ``us``, the current row included.

    ``sums``: running sums (null before the first value), ``lasts``: the last value so far that isn't null. Rows of
    one time come in any order, as in a window; a null series is a series. A sum's rounding follows the buckets, so it is the same
    however the rows are dealt. The frame is read twice: once for the buckets' totals, once for the rows.
    """
    lasts = lasts or {}
    inputs = {f"__in_{name}": value for part in (sums, lasts) for name, value in part.items()}
    # series and bucket as one key that is never null: totals, window and join share its exchange
    rows = bucketed(frame.withColumns(inputs), span).withColumn("__at", F.struct("series", BUCKET))
    latest = [F.max_by(F.col(f"__in_{n}"), F.when(F.col(f"__in_{n}").isNotNull(), F.col("us"))).alias(f"__of_{n}") for n in lasts]
    totals = rows.groupBy("__at").agg(F.count("*").alias("__rows"), *(F.sum(f"__in_{n}").alias(f"__of_{n}") for n in sums), *latest)
    before = Window.partitionBy("__at.series").orderBy(f"__at.{BUCKET}").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__at", *(F.sum(f"__of_{n}").over(before).alias(f"__pre_{n}") for n in sums), *(F.last(f"__of_{n}", ignorenulls=True).over(before).alias(f"__pre_{n}") for n in lasts))
    held, w = rows.join(carry, "__at", "left"), _so_far("__at")
    own = {n: F.sum(f"__in_{n}").over(w) for n in sums}
    found = {n: F.coalesce(F.col(f"__pre_{n}") + v, F.col(f"__pre_{n}"), v) for n, v in own.items()}
    found |= {n: F.coalesce(F.last(f"__in_{n}", ignorenulls=True).over(w), F.col(f"__pre_{n}")) for n in lasts}
    return held.withColumns(found).drop("__at", BUCKET, *inputs, *(f"__pre_{n}" for n in found))


def placed(frame: DataFrame, *values: str, span: str = SPAN) -> DataFrame:
    """Makes a frame fit for series too long for one task: adds ``row`` (its number in the series, from 1) and, for each of ``values``, ``<name>#n`` (how many of its values so far aren't null).

    Transforms that cut a series into chunks take these numbers where a frame has them, instead of
    counting in a window over the whole series, and fills go by buckets (``held``). Number a frame once,
    before its transforms; write it first if it is costly, since it is read twice.
    """
    counted = {f"{v}#n": F.nullif(F.col(v).cast("double"), F.lit(float("nan"))).isNotNull().cast("long") for v in values}
    return running(frame, {"row": F.lit(1).cast("long"), **counted}, span=span)


def cumulative_sum(frame: DataFrame, x: str, out: str, span: str = SPAN) -> DataFrame:
    """Running sum of each series; null where x is."""
    return running(frame, {out: F.col(x)}, span=span).withColumn(out, F.when(F.col(x).isNotNull(), F.col(out)))


def filled(frame: DataFrame, x: str, out: str, span: str = SPAN) -> DataFrame:
    """The last value of x so far in each series."""
    return running(frame, {}, {out: F.col(x)}, span=span)


def row_number(frame: DataFrame) -> Column:
    """``row`` of a placed frame; counted along the series in another."""
    return F.col("row") if "row" in frame.columns else F.row_number().over(ordered())


def held(frame: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds the last ``value`` so far: by buckets in a placed frame, along the whole series in another."""
    if "row" in frame.columns:
        return filled(frame.withColumn("__held", value), "__held", out).drop("__held")
    return frame.withColumn(out, F.last(value, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def split(frame: DataFrame, look_back: int, chunk: int = 100_000) -> DataFrame:
    """Cuts the series of a placed frame into series of about ``chunk`` rows that begin with ``look_back`` rows of the one before.

    What transforms of no longer windows give on these, they give on the whole; ``rejoined`` takes the rows
    that only lead in away again. ``series`` holds (of, chunk) in between.
    """
    chunk = max(chunk, look_back)
    first = F.floor((F.col("row") - 1) / chunk)
    lead = F.when((F.col("row") - 1) % chunk >= chunk - look_back, F.array(first, first + 1)).otherwise(F.array(first))
    dealt = frame.withColumn("chunk", F.explode(lead)).withColumn("leads", F.col("chunk") != first)
    return dealt.withColumn("series", F.struct(F.col("series").alias("of"), "chunk")).drop("chunk")


def rejoined(frame: DataFrame) -> DataFrame:
    return frame.where(~F.col("leads")).withColumn("series", F.col("series.of")).drop("leads")
