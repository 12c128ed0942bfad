"""Panels in files: wide Parquet in, long tables out, and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators.align import wide
from ..operators.universe import clean_weights

#: Cells of a block of columns that become rows together.
BLOCK_CELLS = 500_000


def listed(spark: SparkSession, directory: str, pattern: str = "*.parquet") -> list[str]:
    """Names of the files or tables in a folder of any store Spark reads, without ``.parquet``, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{directory}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in found or [])


def indicators(spark: SparkSession, directory: str) -> list[str]:
    """Indicators that have both a Bid and an Ask file."""
    bid, ask = ({n.removeprefix(f"{side}_") for n in listed(spark, directory, f"{side}_*.parquet")} for side in ("Bid", "Ask"))
    return sorted(bid & ask)


def melted(table: DataFrame, key: str, names: str = "symbol", only: Sequence[str] | None = None, since=None, until=None) -> DataFrame:
    """Rows of (key, names, value) of a wide table with thousands of columns; NaN becomes null.

    Of a file only the columns ``only`` are read, and only stretches of it whose keys may lie from ``since`` on and before
    ``until``. Columns turn into rows in Arrow, a block of them at a time: neither a row's plan nor its code grows
    with their number, as an unpivot's does.
    """
    wanted = None if only is None else set(only)
    columns = [c for c in table.columns if c != key and (wanted is None or c in wanted)]
    kind = table.schema[key].dataType
    rows = table if since is None else table.where(F.col(key) >= F.lit(since).cast(kind))
    rows = rows if until is None else rows.where(F.col(key) < F.lit(until).cast(kind))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = batch.column(0), batch.num_rows
            step = max(1, BLOCK_CELLS // max(n, 1))
            for a in range(0, len(columns), step):
                part = columns[a : a + step]
                values = pa.concat_arrays([batch.column(1 + a + i).cast(pa.float64()) for i in range(len(part))])
                values = pc.if_else(pc.is_nan(values), None, values)
                named = pa.array(part).take(pa.array(np.repeat(np.arange(len(part)), n)))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([keys] * len(part)), named, values], [key, names, "value"])

    schema = StructType([table.schema[key], StructField(names, StringType()), StructField("value", DoubleType())])
    if not columns:
        return table.sparkSession.createDataFrame([], schema)
    numbered = (F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))  # names with dots don't go into mapInArrow
    return rows.select(F.col(f"`{key}`"), *numbered).mapInArrow(turned, schema)


def _side(spark: SparkSession, path: str, index: str, name: str, **only) -> DataFrame:
    table = melted(spark.read.parquet(path), index, **only)
    return table.select(F.col(index).cast("timestamp_ntz").alias("ts"), "symbol", F.col("value").alias(name))


def side_pair(spark: SparkSession, directory: str, indicator: str, index: str = "ts", symbols: Sequence[str] | None = None, since=None, until=None) -> DataFrame:
    """ts, symbol, bid, ask of one indicator, or of some symbols and times of it (``melted``); a file that can't be read is an error."""
    only = {"only": symbols, "since": since, "until": until}
    bid = _side(spark, f"{directory}/Bid_{indicator}.parquet", index, "bid", **only)
    return bid.join(_side(spark, f"{directory}/Ask_{indicator}.parquet", index, "ask", **only), ["ts", "symbol"], "full_outer")


def index_weights(spark: SparkSession, directory: str, codes: list[str], index: str = "trade_date") -> DataFrame:
    """index_code, trade_date, symbol, weight of wide files, one per index."""
    out = None
    for code in codes:
        part = melted(spark.read.parquet(f"{directory}/{code}.parquet"), index).select(F.lit(code).alias("index_code"), F.col(index).cast("date").alias("trade_date"), "symbol", F.col("value").alias("weight"))
        out = part if out is None else out.unionByName(part)
    return clean_weights(out)


def minute_weights(spark: SparkSession, directory: str, codes: list[str], suffix: str, index: str = "ts") -> DataFrame:
    """index_code, ts, symbol, weight of wide files named {index}_{suffix}; null cells stay, for fills."""
    out = None
    for code in codes:
        part = melted(spark.read.parquet(f"{directory}/{code}_{suffix}.parquet"), index).select(F.lit(code).alias("index_code"), F.col(index).cast("timestamp_ntz").alias("ts"), "symbol", F.col("value").alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def write_factors(factors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows (factor, series, ts, value) by factor, values in single precision."""
    factors.select("factor", "ts", "series", F.col("value").cast("float").alias("value")).write.partitionBy("factor").mode(mode).parquet(path)


def read_factor(spark: SparkSession, path: str, factor: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("factor") == factor).select("series", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"))


def write_wide(factor: DataFrame, path: str) -> None:
    """One factor with a column per series, as the files that were read."""
    wide(factor.withColumn("value", F.col("value").cast("float"))).write.mode("overwrite").parquet(path)
