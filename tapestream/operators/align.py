"""Alignment, set-like operations and increments of long factor tables (series, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def zero_to_null(x: Column) -> Column:
    return F.nullif(x.cast("double"), F.lit(0.0))


def without_empty_times(factor: DataFrame) -> DataFrame:
    """Drops the times at which no series has a value."""
    return factor.withColumn("__any", F.count("value").over(Window.partitionBy("ts"))).where("__any > 0").drop("__any")


def dense(factor: DataFrame) -> DataFrame:
    """Every series at every time, with nulls where there was no row."""
    times, series = factor.select("ts").distinct(), factor.select("series").distinct()
    return times.crossJoin(F.broadcast(series)).join(factor, ["ts", "series"], "left")  # the series of one factor are few


def renamed_suffixes(symbol: Column) -> Column:
    """Exchange suffixes of one vendor in the form of another. Fixed values."""
    return F.regexp_replace(F.regexp_replace(symbol, r"\.XSHE$", ".SZ"), r"\.XSHG$", ".SH")


def common_series(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables kept to the series that either has."""
    return a.join(b.select("series").distinct(), "series", "left_semi"), b.join(a.select("series").distinct(), "series", "left_semi")


def union_of_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both values on the union of times and series: series, ts, left, right."""
    return a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), ["series", "ts"], "full_outer")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (dense on its own grid, nulls included) replace those of ``old``."""
    return old.join(new.select("series", "ts"), ["series", "ts"], "left_anti").select("series", "ts", "value").unionByName(dense(new).select("series", "ts", "value"))


def append_missing(old: DataFrame, new: DataFrame, key: str = "eff_date") -> DataFrame:
    """Adds the rows of ``new`` whose key ``old`` doesn't have."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def mismatches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows in both whose values differ, a null differing from any value: series, ts, old, new. None means consistent."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["series", "ts"])
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("series", "ts", "old", "new")


def consistency(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: overlapping rows, mismatches, and the time of the first."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["series", "ts"])
    differs = ~F.col("old").eqNullSafe(F.col("new"))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(differs).alias("n_mismatches"), F.min(F.when(differs, F.col("ts"))).alias("first_mismatch"))


def latest_per_key(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")


def wide(factor: DataFrame, series: list[str] | None = None) -> DataFrame:
    """One column per series (the export shape); name the series to save the pass that finds them."""
    return factor.groupBy("ts").pivot("series", series).agg(F.first("value"))


def long(table: DataFrame, key: str = "ts", names: str = "series") -> DataFrame:
    """Rows of (key, series, value) from a wide table; NaN becomes null."""
    values = [c for c in table.columns if c != key]
    typed = table.select(key, *(F.col(f"`{c}`").cast("double").alias(c) for c in values))
    return typed.unpivot(key, [F.col(f"`{c}`") for c in values], names, "value").withColumn("value", F.nullif("value", F.lit(float("nan"))))


def described(a: DataFrame, b: DataFrame) -> DataFrame:
    """Count, mean, deviation and quartiles of the absolute differences of two factors; the quartiles are exact, and searched for at once."""
    both = union_of_series(a, b).select(F.abs(F.col("left") - F.col("right")).alias("d"))
    q = [F.lit(v).cast("double").alias(f"q{p}") for v, p in zip(quantiles(both, "d", [0.25, 0.5, 0.75]), (25, 50, 75), strict=True)]
    return both.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.min("d").alias("least"), F.max("d").alias("most")).select("n", "mean", "std", "least", *q, "most")


def priced(factor: DataFrame, prices: DataFrame, names: dict[str, str]) -> DataFrame:
    """Factor values beside the prices of the instrument that stands for each series."""
    pairs = F.create_map(*(F.lit(x) for item in names.items() for x in item))
    traded = factor.withColumn("instrument", F.try_element_at(pairs, F.col("series"))).where("instrument is not null")
    return prices.withColumnRenamed("series", "instrument").join(traded, ["instrument", "ts"], "left").select("ts", "instrument", "price", "value")


def histogram(rows: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """Counts per group in ``bins`` equal bins between the least and the largest value of all groups."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int"))  # one row
    return binned.where(F.col(value).isNotNull()).groupBy(group, "bin").agg(F.count("*").alias("n"))


def named_like(rows: DataFrame, column: str, pattern: str, unlike: str | None = None) -> DataFrame:
    """Rows whose name matches a pattern and not another."""
    found = rows.where(F.col(column).rlike(pattern))
    return found if unlike is None else found.where(~F.col(column).rlike(unlike))


def pattern_counts(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """How many rows have each first match of ``pattern`` in a column; rows without one aren't counted."""
    return rows.select(F.regexp_extract(column, pattern, 0).alias("match")).where("match <> ''").groupBy("match").agg(F.count("*").alias("n"))


def peaks(factor: DataFrame) -> DataFrame:
    """Each series' largest value and its first time."""
    best = F.max_by(F.struct("ts", "value"), F.struct(F.col("value"), -F.unix_micros(F.col("ts").cast("timestamp"))))
    return factor.where("value is not null").groupBy("series").agg(best.alias("p")).select("series", "p.ts", "p.value")
