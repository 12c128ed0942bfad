"""Daily index weights from constituent history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def constituents(history: DataFrame, securities: DataFrame, index_symbol: str | None = None) -> DataFrame:
    """index_code, symbol, eff_date, weight: both ids of the history looked up among the securities.

    A constituent that isn't among them keeps a null symbol; an index that isn't is left out once
    ``index_symbol`` is asked for.
    """
    names = securities.select("security_id", F.concat_ws(".", "ticker_symbol", "exchange_cd").alias("code"), "ticker_symbol")
    index = names.select(F.col("security_id"), F.col("ticker_symbol").alias("index_code"))
    member = names.select(F.col("security_id").alias("cons_id"), F.col("code").alias("symbol"))
    rows = history.join(index, "security_id", "left").join(member, "cons_id", "left")
    if index_symbol is not None:
        rows = rows.where(F.col("index_code") == index_symbol)
    return rows.select("index_code", "symbol", "eff_date", F.col("weight").cast("double").alias("weight"))


def _days(spans: DataFrame, start: str, days: DataFrame, day: str) -> DataFrame:
    """The rows of ``spans`` on every date from ``start`` to the day before ``until`` (null: to the last of ``days``), as ``day``."""
    end = days.agg(F.to_date(F.max(day)).alias("__end"))
    held = spans.crossJoin(end).withColumn("__until", F.least(F.coalesce(F.date_sub("until", 1), F.col("__end")), "__end")).where(F.col(start) <= F.col("__until"))  # one row
    return held.withColumn(day, F.explode(F.sequence(F.to_date(start), "__until", F.expr("interval 1 day")))).drop("until", "__until", "__end")


def increment(old: DataFrame, new: DataFrame, key: str = "eff_date") -> DataFrame | None:
    """``old`` with the rows of ``new`` whose date it lacks, or None if it has all of them: nothing is to be built anew."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns)
    return None if fresh.isEmpty() else old.unionByName(fresh)


def daily_weights(members: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weights of each trading day from the latest effective date at or before it.

    A symbol that a later effective date of its index doesn't name has weight 0 from then on, so a
    day's rows are those of one effective date: its days joined with the calendar's, no pivot.
    """
    dates = members.select("index_code", "eff_date").distinct()
    until = dates.withColumn("until", F.lead("eff_date").over(Window.partitionBy("index_code").orderBy("eff_date")))
    days = _days(until, "eff_date", calendar, "trade_date").join(calendar, "trade_date")
    return days.join(members, ["index_code", "eff_date"]).select("index_code", "trade_date", "symbol", "weight")


def labelled_next_day(weights: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weights known on a trading day, under the date of the next one."""
    following = calendar.withColumn("next_date", F.lead("trade_date").over(Window.orderBy("trade_date")))  # a calendar is small
    return weights.join(following, "trade_date").where("next_date is not null").withColumn("trade_date", F.col("next_date")).drop("next_date")


def filled_days(weights: DataFrame) -> DataFrame:
    """Each symbol's weight on every calendar day between the first and last date, the latest one carried on."""
    ends = weights.groupBy("symbol").agg(F.min("trade_date").alias("a"))
    last = weights.agg(F.max("trade_date").alias("b"))
    grid = ends.crossJoin(F.broadcast(last)).select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("trade_date"))  # one row
    held = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(weights, ["symbol", "trade_date"], "left").withColumn("weight", F.last("weight", ignorenulls=True).over(held))


def weights_as_of(weights: DataFrame, days: DataFrame) -> DataFrame:
    """The weights of the latest date at or before each ``day``, per index."""
    dates = weights.select("index_code", "trade_date").distinct()
    spans = dates.withColumn("until", F.lead("trade_date").over(Window.partitionBy("index_code").orderBy("trade_date")))
    matched = days.join(_days(spans, "trade_date", days, "day"), "day")
    return matched.select("day", "index_code", "trade_date").join(weights, ["index_code", "trade_date"]).select("index_code", "day", "symbol", "weight")
