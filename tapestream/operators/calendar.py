"""Trading calendars, trading grids, and resampling in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import calendar_micros


def trading_days(calendar: DataFrame, first: str, last: str) -> DataFrame:
    return calendar.where(F.col("trade_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))


def _nearest(days: DataFrame, dates: DataFrame, at: Column, ahead: bool, key: str = "day") -> DataFrame:
    """Each ``key`` with the last of ``dates`` (trade_date) at or before the date ``at``, or the first at or after it if ``ahead``; null if there is none.

    Every trading day is spread over the calendar days it stands for, so this is an equi-join; a calendar
    has a few thousand rows a decade, which one window puts in order.
    """
    asked = days.select(key).distinct().withColumn("at", at)
    ends = asked.agg(F.min("at").alias("least"), F.max("at").alias("most"))
    in_order = Window.orderBy("trade_date")
    spans = dates.select("trade_date").distinct().withColumn("before", F.lag("trade_date").over(in_order)).withColumn("after", F.lead("trade_date").over(in_order)).crossJoin(ends)  # one row
    first = F.coalesce(F.date_add("before", 1), F.least("trade_date", "least")) if ahead else F.col("trade_date")
    last = F.col("trade_date") if ahead else F.coalesce(F.date_sub("after", 1), F.greatest("trade_date", "most"))
    held = spans.select("trade_date", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("at"))
    return asked.join(held, "at", "left").select(key, "trade_date")


def previous_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """The last trading day before each ``day``."""
    return _nearest(days, calendar, F.date_sub("day", 1), False)


def next_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    return _nearest(days, calendar, F.date_add("day", 1), True)


def trading_day_n_days_ago(days: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """The last trading day at or before ``day`` less n calendar days."""
    return _nearest(days, calendar, F.date_sub("day", n), False)


def last_trading_days_of_months(calendar: DataFrame) -> DataFrame:
    """Trading days whose next trading day is in another month; the calendar's last day isn't one."""
    following = F.lead("trade_date").over(Window.orderBy("trade_date"))
    return calendar.withColumn("n", following).where(F.trunc("n", "month") != F.trunc("trade_date", "month")).select("trade_date")


def futures_expiry(months: DataFrame, calendar: DataFrame) -> DataFrame:
    """Third Friday of each ``month`` (any day of it), moved to the next trading day if it is none."""
    first = F.trunc("month", "month")
    third_friday = F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 14)
    return _nearest(months, calendar, third_friday, True, "month").withColumnRenamed("trade_date", "expiry")


def contract_month(days: DataFrame, expiries: DataFrame) -> DataFrame:
    """YYMM of the contract that is current on the day after each ``day``: of the first expiry after it."""
    found = _nearest(days, expiries.select(F.col("expiry").alias("trade_date")).where("expiry is not null"), F.date_add("day", 1), True)
    return found.select("day", F.date_format("trade_date", "yyMM").alias("contract"))


def round_up(ms: Column, step: int) -> Column:
    """Milliseconds rounded up to a multiple of ``step``."""
    return F.ceil(ms / step) * step


def session_grid(days: DataFrame, step: str, morning: tuple[str, str] = ("09:30", "11:30"), afternoon: tuple[str, str] = ("13:00", "14:55")) -> DataFrame:
    """Times of the two sessions of each ``day``, labelled by the end of each step."""
    micros = calendar_micros(step)

    def times(session: tuple[str, str]) -> Column:
        begin, end = (F.unix_micros(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(t)))) for t in session)
        return F.when(begin + micros <= end, F.sequence(begin + micros, end, F.lit(micros))).otherwise(F.array().cast("array<bigint>"))

    return days.select("day", F.explode(F.concat(times(morning), times(afternoon))).alias("us")).select("day", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def in_session(ts: Column, sessions: tuple[tuple[int, int], ...] = ((570, 690), (780, 900))) -> Column:
    """Whether a time is within trading hours (minutes of the day, both ends included)."""
    minute = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    found = F.lit(False)
    for a, b in sessions:
        found = found | minute.between(a, b)
    return found


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def resample_right(frame: DataFrame, step: str, ts: str = "ts") -> DataFrame:
    """Means over (t - step, t], labelled t."""
    micros = calendar_micros(step)
    label = F.timestamp_micros((F.ceil(_micros(ts) / micros) * micros).cast("bigint")).cast("timestamp_ntz")
    return frame.groupBy("series", label.alias("ts")).agg(F.avg("value").alias("value"))


def resample_left(frame: DataFrame, step: str, ts: str = "ts") -> DataFrame:
    """Means over [t, t + step), labelled t."""
    micros = calendar_micros(step)
    label = F.timestamp_micros((F.floor(_micros(ts) / micros) * micros).cast("bigint")).cast("timestamp_ntz")
    return frame.groupBy("series", label.alias("ts")).agg(F.avg("value").alias("value"))


def as_frequency(frame: DataFrame, step: str) -> DataFrame:
    """Each series at every step between its first and last time, null where it had no row."""
    micros = calendar_micros(step)
    ends = frame.groupBy("series").agg(F.min(_micros("ts")).alias("a"), F.max(_micros("ts")).alias("b"))
    grid = ends.select("series", F.explode(F.sequence("a", "b", F.lit(micros))).alias("us")).select("series", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))
    return grid.join(frame, ["series", "ts"], "left")


def by_period(frame: DataFrame, period: str) -> DataFrame:
    """Means by calendar month or year."""
    return frame.groupBy("series", F.date_trunc(period, "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


def intraday_profile(frame: DataFrame) -> DataFrame:
    """Mean by clock minute and year."""
    return frame.groupBy("series", F.year("ts").alias("year"), F.date_format("ts", "HH:mm").alias("minute")).agg(F.avg("value").alias("value"))
