"""Increments: latest values, upserts in batches, and a stream of events to a factor table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.frames import between_0_and_1, calendar_micros, clock, ratio, timed
from ..functions.imbalance import IMBALANCE
from ..operators.align import mismatches, upsert
from ..sources.versioned import FactorTable


def _trailing(frame: DataFrame, window: str, same_clock: bool) -> DataFrame:
    """Rows of each series within the window before its last time, with the last row's value."""
    frame = timed(frame).withColumn("c", clock())
    last = frame.groupBy("series").agg(F.max("us").alias("last"), F.max_by("value", "us").alias("x"), F.max_by("c", "us").alias("lc"), F.max("ts").alias("now"))
    rows = frame.join(last, "series").where(F.col("us") > F.col("last") - calendar_micros(window))
    return rows.where("c = lc") if same_clock else rows


def latest_zscore(frame: DataFrame, window: str) -> DataFrame:
    """The z-score of each series' last row only."""
    rows = _trailing(frame, window, False).groupBy("series", "now", "x").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return rows.select("series", F.col("now").alias("ts"), ratio(F.col("x") - F.col("m"), F.col("s")).alias("value"))


def latest_without_intraday_effect(frame: DataFrame, window: str = "30d") -> DataFrame:
    rows = _trailing(frame, window, True).groupBy("series", "now", "x").agg(F.avg("value").alias("m"))
    return rows.select("series", F.col("now").alias("ts"), (F.col("x") - F.col("m")).alias("value"))


def latest_quantile_scale(frame: DataFrame, window: str = "30d", min_periods: int = 1, quantile: float = 0.05) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(quantile), F.lit(1 - quantile)))
    rows = _trailing(frame, window, True).groupBy("series", "now", "x").agg(q.alias("q"), F.count("value").alias("n"))
    scaled = between_0_and_1(ratio(F.col("x") - F.col("q")[0], F.col("q")[1] - F.col("q")[0]))
    return rows.select("series", F.col("now").alias("ts"), F.when(F.col("n") >= min_periods, scaled).alias("value"))


class Inconsistent(RuntimeError):
    """An increment contradicts what is stored."""


def agreed(old: DataFrame, new: DataFrame, tolerance: float | None = None, debug: str | None = None) -> None:
    """Raises Inconsistent unless two tables agree on the rows they share.

    Sums of doubles depend on how rows are dealt, so rows may differ by ``tolerance``; none asks for equality.
    With ``debug``, the rows that differ are written there as Parquet before Inconsistent is raised.
    """
    found = mismatches(old, new)
    if tolerance is not None:
        found = found.where(F.col("old").isNull() | F.col("new").isNull() | (F.abs(F.col("old") - F.col("new")) > tolerance))
    first = found.orderBy("ts", "series").first()
    if first is not None:
        if debug:
            found.write.mode("overwrite").parquet(debug)
        raise Inconsistent(f"{found.count()} rows differ, the first at {first['ts']} of {first['series']}: {first['old']} and {first['new']}")


def updated(old: DataFrame, new: DataFrame, tolerance: float | None = None, debug: str | None = None) -> DataFrame:
    """``old`` with ``new`` upserted, after they agree on the rows they share (``agreed``)."""
    agreed(old, new, tolerance, debug)
    return upsert(old, new)


def minute_bars(events: DataFrame, delay: str = "10 minutes", step: str = "1 minute") -> DataFrame:
    """Bid and ask sums per step and symbol of a stream of (ts, symbol, side, value); late events beyond ``delay`` are left out."""
    late = events.withWatermark("ts", delay)
    sums = late.groupBy(F.window("ts", step), "symbol").agg(F.sum(F.when(F.col("side") == "bid", F.col("value"))).alias("bid"), F.sum(F.when(F.col("side") == "ask", F.col("value"))).alias("ask"))
    return sums.select(F.col("window.start").alias("ts"), "symbol", "bid", "ask")


def write_trailing(bars: DataFrame, history: str, target: str, transform: Callable[[DataFrame], DataFrame], window: str, checkpoint: str) -> StreamingQuery:
    """Keeps a factor table up to date: each batch of bars joins the history, and the last ``window`` is computed anew.

    Row windows don't run on streams, so they run per batch over what the new rows can change. History and target
    are versioned tables (``sources.versioned``): of the history only the folders of the window are opened, both stay
    at few folders, and a repeated batch changes neither. Transforms with a state need no history (``stateful``).
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark: SparkSession = rows.sparkSession
        first = rows.agg(F.min("ts")).first()[0]
        if first is None:
            return
        held = FactorTable(spark, history)
        held.commit(rows.withColumnRenamed("symbol", "series"), number)
        known = held.read(since=first - dt.timedelta(microseconds=calendar_micros(window))).withColumnRenamed("series", "symbol")
        FactorTable(spark, target).commit(transform(known).where(F.col("ts") >= F.lit(first)), number)

    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def latest_version(spark: SparkSession, target: str) -> DataFrame:
    """Rows of a table that ``write_trailing`` keeps."""
    return FactorTable(spark, target).read()


def both_sides(bids: DataFrame, asks: DataFrame, delay: str = "10 minutes", apart: str = "1 minute") -> DataFrame:
    """Bid and ask of two streams of (ts, symbol, value), joined by time and symbol: ts, symbol, bid, ask.

    A side that hasn't come ``apart`` after the watermark of the slower stream (its latest time less ``delay``) is null, as in
    the batch pair. What comes later than ``delay`` is left out, and so is its partner's chance to meet it.
    """
    left = bids.select(F.col("ts").alias("b_ts"), F.col("symbol").alias("b_symbol"), F.col("value").alias("bid")).withWatermark("b_ts", delay)
    right = asks.select(F.col("ts").alias("a_ts"), F.col("symbol").alias("a_symbol"), F.col("value").alias("ask")).withWatermark("a_ts", delay)
    near = F.expr(f"b_symbol = a_symbol and b_ts = a_ts and a_ts between b_ts - interval {apart} and b_ts + interval {apart}")
    joined = left.join(right, near, "full_outer")
    return joined.select(F.coalesce("b_ts", "a_ts").alias("ts"), F.coalesce("b_symbol", "a_symbol").alias("symbol"), "bid", "ask")


def weighted_pairs(weights: Callable[[], DataFrame], imb: str = "imb01") -> Callable[[DataFrame], DataFrame]:
    """A transform for ``write_trailing``: weighted imbalance per index of (ts, symbol, bid, ask).

    ``weights`` gives the static side (index_code, symbol, trade_date, weight) and is asked for each batch, so a new day's weights
    count from its first batch on. A pair that becomes complete later, or never, comes with a later batch; its time is made anew
    out of the history of pairs.
    """

    def transform(pairs: DataFrame) -> DataFrame:
        joined = pairs.withColumn("trade_date", F.to_date("ts")).join(weights(), ["symbol", "trade_date"])
        value = IMBALANCE[imb](F.col("bid"), F.col("ask"))
        there = F.when(value.isNotNull(), F.col("weight"))
        return joined.groupBy(F.col("index_code").alias("series"), "ts").agg(ratio(F.sum(value * F.col("weight")), F.sum(there)).alias("value"))

    return transform
