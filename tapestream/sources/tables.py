"""Text files, databases and status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import latest_per_key


def calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """trade_date of a file with the column TradingDay (yyyy-MM-dd or yyyyMMdd)."""
    day = F.regexp_replace("TradingDay", "-", "")
    return spark.read.csv(path, header=True, schema="TradingDay string").select(F.to_date(day, "yyyyMMdd").alias("trade_date")).distinct()


def weights_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("con_code").alias("symbol"), F.to_date(F.col("trade_date").cast("string"), "yyyyMMdd").alias("trade_date"), F.col("weight").cast("double").alias("weight"))


def number(text: F.Column | str) -> F.Column:
    """A number with thousands commas; null if it is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def option_interest_csv(spark: SparkSession, path: str) -> DataFrame:
    """ts, call, put and their imbalance."""
    rows = spark.read.csv(path, header=True)
    parsed = rows.select(F.to_timestamp("dt").cast("timestamp_ntz").alias("ts"), number("call_oi_sum").alias("call"), number("put_oi_sum").alias("put"), number("pc").alias("pc"))
    return parsed.withColumn("imbalance", F.try_divide(F.col("call") - F.col("put"), F.col("call") + F.col("put")))


def _inner_number(column: str) -> F.Column:
    return F.nullif(F.regexp_extract(column, r"([-+]?[0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")


def completeness(spark: SparkSession, path: str) -> DataFrame:
    """Latest completeness row of each symbol of a file without header whose numbers stand within text."""
    rows = spark.read.csv(path, schema="date string, symbol string, rate string, missing string")
    return latest_per_key(rows.select("date", "symbol", _inner_number("rate").alias("rate"), _inner_number("missing").alias("missing")), ["symbol"], "date")


def completeness_summary(stats: DataFrame) -> DataFrame:
    """Of incomplete rates: count, least, mean. Of missing increments: count, most, mean."""
    low, missing = F.when(F.col("rate") < 1, F.col("rate")), F.when(F.col("missing") > 0, F.col("missing"))
    return stats.agg(F.count(low).alias("n_incomplete"), F.min(low).alias("least_rate"), F.avg(low).alias("mean_rate"), F.count(missing).alias("n_missing"), F.max(missing).alias("most_missing"), F.avg(missing).alias("mean_missing"))


def database(spark: SparkSession, options: dict[str, str], query: str) -> DataFrame:
    """A query of a JDBC database; address, user and password come from the caller."""
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def first_with_rows(readers) -> DataFrame:
    """The first of several candidate tables (functions that read one) that has a row."""
    last = None
    for read in readers:
        last = read()
        if not last.isEmpty():
            return last
    return last


# Status and message tables. A table is its rows; each function returns the new rows to write.


def with_status(status: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (author, object, data_ts): the new one where there is one."""
    keys = ["author", "object", "data_ts"]
    return status.join(new.select(*keys), keys, "left_anti").unionByName(latest_per_key(new, keys, "timestamp"))


def status_since(status: DataFrame, author: str, object_: str, since) -> DataFrame:
    return status.where((F.col("author") == author) & (F.col("object") == object_) & (F.col("data_ts") >= F.lit(since)))


def is_ready(status: DataFrame, day) -> DataFrame:
    """One row: whether any status 1 is of ``day`` or later."""
    return status.agg(F.coalesce(F.max((F.to_date("data_ts") >= F.lit(day)) & (F.col("status") == 1)), F.lit(False)).alias("ready"))


def open_messages(messages: DataFrame, levels: list[str], among: bool = True) -> DataFrame:
    """Messages not alerted yet whose level is (or isn't) among ``levels``."""
    listed = F.col("level").isin(*levels)
    return messages.where((F.col("alerted") == 0) & (listed if among else ~listed))


def with_message(messages: DataFrame, author: str, level: str, title: str, msg: str) -> DataFrame:
    """Messages and one more, not alerted yet; its id is the next one (1 in an empty table)."""
    following = messages.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast(messages.schema["id"].dataType).alias("id"))
    new = {"author": author, "level": level, "title": title, "msg": msg, "alerted": 0}
    row = following.select(*(F.col("id") if f.name == "id" else F.lit(new.get(f.name)).cast(f.dataType).alias(f.name) for f in messages.schema))
    return messages.unionByName(row)


def alerted(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages with those of ``ids`` marked as alerted."""
    marked = ids.select("id").distinct().withColumn("__seen", F.lit(1))
    return messages.join(marked, "id", "left").withColumn("alerted", F.coalesce("__seen", "alerted")).select(*messages.columns)


def positions(table: DataFrame, account: str) -> DataFrame:
    """acname, stockdate, symbol, position of a wide table with one column per symbol."""
    values = [c for c in table.columns if c != "stockdate"]
    return table.select("stockdate", *(F.col(f"`{c}`").cast("double").alias(c) for c in values)).unpivot("stockdate", [F.col(f"`{c}`") for c in values], "symbol", "position").select(F.lit(account).alias("acname"), "stockdate", "symbol", "position")


def with_positions(held: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["acname", "stockdate", "symbol"]
    return held.join(new.select(*keys), keys, "left_anti").unionByName(new)
