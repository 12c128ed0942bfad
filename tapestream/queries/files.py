"""Queries that write panels derived from the given tables as files, and read them back by the sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import weights
from ..sources import panels, tables
from ..streaming import incremental
from . import panels as p

QUERIES = {}
ORACLE_SQL = {}


def scratch(spark) -> str:
    """A new folder where driver and executors both read and write; only a local master may leave ``spark.checkpoint.dir`` unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-panels-")
    return f"{shared}/tapestream/panels-{uuid.uuid4().hex}"


def _wide(rows, index, value, path):
    rows.groupBy(index).pivot("symbol").agg(F.first(value)).write.parquet(path)


def source_side_pair(spark, sf_dir):
    """Both sides of the hourly panel through wide files; the grid is dense then."""
    folder, rows = scratch(spark), p.hourly(spark, sf_dir)
    for side in ("bid", "ask"):
        _wide(rows, "ts", side, f"{folder}/{side.capitalize()}_value.parquet")
    (name,) = panels.indicators(spark, folder)
    return panels.side_pair(spark, folder, name).select("ts", "symbol", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"))


def source_index_weights(spark, sf_dir):
    """Daily weights through one wide file per index."""
    folder, rows = scratch(spark), p.weights(spark, sf_dir)
    for code in p.TARGETS:
        _wide(rows.where(F.col("index_code") == code), "trade_date", "weight", f"{folder}/{code}.parquet")
    return panels.index_weights(spark, folder, panels.listed(spark, folder))


def source_minute_weights(spark, sf_dir):
    """Weights of one's own through wide files, null cells included."""
    folder, rows = scratch(spark), p.minute_weights(spark, sf_dir)
    for code in p.TARGETS:
        _wide(rows.where(F.col("index_code") == code), "ts", "weight", f"{folder}/{code}_own.parquet")
    return panels.minute_weights(spark, folder, p.TARGETS, "own")


def source_factor(spark, sf_dir):
    """A factor through the sink, in single precision."""
    folder = scratch(spark)
    panels.write_factors(p.series(spark, sf_dir).withColumn("factor", F.lit("imb")), folder)
    return panels.read_factor(spark, folder, "imb").select("series", "ts", F.round("value", 6).alias("value"))


def source_side_pair_part(spark, sf_dir):
    """Some symbols and times of the panel: other columns and stretches of the files aren't read."""
    folder, rows = scratch(spark), p.hourly(spark, sf_dir)
    for side in ("bid", "ask"):
        _wide(rows, "ts", side, f"{folder}/{side.capitalize()}_value.parquet")
    symbols = [r[0] for r in rows.select("symbol").distinct().orderBy("symbol").limit(2).collect()]
    ends = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = ends[0] + (ends[1] - ends[0]) / 2
    return panels.side_pair(spark, folder, "value", symbols=symbols, since=middle).select("ts", "symbol", F.round("bid", 6).alias("bid"), F.round("ask", 6).alias("ask"))


def _csv(rows, folder, header=True):
    rows.write.option("header", header).csv(folder)
    return folder


def source_calendar_csv(spark, sf_dir):
    """Order dates through a calendar file."""
    days = p.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("TradingDay"))
    return tables.calendar_csv(spark, _csv(days, scratch(spark)))


def source_weights_csv(spark, sf_dir):
    rows = p.weights(spark, sf_dir).select(F.col("symbol").alias("con_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), "weight", "index_code")
    return tables.weights_csv(spark, _csv(rows, scratch(spark)))


def source_option_interest_csv(spark, sf_dir):
    """Sums of an hour's event values, written with thousands commas."""
    sums = p.hourly(spark, sf_dir).groupBy("ts").agg(F.round(F.sum("bid") * 100, 1).alias("b"), F.round(F.sum("ask") * 100, 1).alias("a"))
    rows = sums.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dt"), F.format_number("b", 1).alias("call_oi_sum"), F.format_number("a", 1).alias("put_oi_sum"), F.lit("none").alias("pc"))
    found = tables.option_interest_csv(spark, _csv(rows, scratch(spark)))
    return found.select("ts", F.round("call", 1).alias("call"), F.round("put", 1).alias("put"), "pc", F.round("imbalance", 6).alias("imbalance"))


def source_completeness_csv(spark, sf_dir):
    """Numbers within text, the latest row of each symbol."""
    rows = p.weights(spark, sf_dir).where("index_code = 'ALL'").select(F.date_format("trade_date", "yyyyMMdd").alias("date"), "symbol", F.concat(F.lit("rate "), F.col("weight").cast("int"), F.lit("%")), F.concat(F.lit("("), F.month("trade_date"), F.lit(")")))
    return tables.completeness(spark, _csv(rows, scratch(spark), header=False))


def source_debug_rows(spark, sf_dir):
    """The rows of an increment that contradict what is there, as the check leaves them in a file."""
    folder, old = scratch(spark), p.series(spark, sf_dir)
    new = old.withColumn("value", F.when(F.hour("ts") == 7, F.col("value") + 1).otherwise(F.col("value")))
    try:
        incremental.agreed(old, new, debug=folder)
    except incremental.Inconsistent:
        return spark.read.parquet(folder).select("series", "ts", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"))
    raise AssertionError("increments with other values agreed")


def source_constituents(spark, sf_dir):
    """Constituents with a new date added; an increment without a new date is none."""
    rows = p.weights(spark, sf_dir).withColumnRenamed("trade_date", "eff_date")
    old = rows.where(F.month("eff_date") != 3)
    if weights.increment(old, old) is not None:
        raise AssertionError("an increment without a new date was taken")
    return weights.increment(old, rows)


_GRID = "(SELECT * FROM (SELECT DISTINCT ts FROM {0}), (SELECT DISTINCT symbol FROM {0}))"
QUERIES |= {f.__name__: f for f in (source_side_pair, source_side_pair_part, source_index_weights, source_minute_weights, source_factor, source_calendar_csv, source_weights_csv, source_option_interest_csv, source_completeness_csv, source_debug_rows, source_constituents)}
ORACLE_SQL |= {
    "source_side_pair": f"WITH {p.HOURLY} SELECT g.ts, g.symbol, round(bid, 6) AS bid, round(ask, 6) AS ask FROM {_GRID.format('hourly')} g LEFT JOIN hourly h ON h.ts = g.ts AND h.symbol = g.symbol",
    "source_side_pair_part": f"WITH {p.HOURLY}, g AS (SELECT * FROM (SELECT DISTINCT ts FROM hourly), (SELECT DISTINCT symbol FROM hourly ORDER BY symbol LIMIT 2)) SELECT g.ts, g.symbol, round(bid, 6) AS bid, round(ask, 6) AS ask FROM g LEFT JOIN hourly h ON h.ts = g.ts AND h.symbol = g.symbol WHERE g.ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM hourly)",
    "source_calendar_csv": "SELECT DISTINCT o_orderdate::DATE AS trade_date FROM orders",
    "source_weights_csv": f"WITH {p.WEIGHTS} SELECT symbol, trade_date, weight FROM w",
    "source_option_interest_csv": f"WITH {p.HOURLY}, q AS (SELECT ts, round(sum(bid) * 100, 1) AS call, round(sum(ask) * 100, 1) AS put FROM hourly GROUP BY 1) SELECT ts, call, put, NULL::DOUBLE AS pc, round((call - put) / nullif(call + put, 0), 6) AS imbalance FROM q",
    "source_completeness_csv": f"WITH {p.WEIGHTS} SELECT strftime(max(trade_date), '%Y%m%d') AS date, symbol, arg_max(weight::INT, trade_date)::DOUBLE AS rate, month(max(trade_date))::DOUBLE AS missing FROM w WHERE index_code = 'ALL' GROUP BY symbol",
    "source_debug_rows": f"WITH {p.SERIES} SELECT series, ts, round(x, 6) + 0.0 AS old, round(x + 1, 6) + 0.0 AS new FROM s WHERE hour(ts) = 7 AND x IS NOT NULL",
    "source_constituents": f"WITH {p.WEIGHTS} SELECT index_code, trade_date AS eff_date, symbol, weight FROM w",
    "source_index_weights": f"WITH {p.WEIGHTS} SELECT index_code, trade_date, symbol, weight FROM w",
    "source_minute_weights": f"WITH {p.MINUTE_WEIGHTS} SELECT i AS index_code, g.ts, g.symbol, weight FROM {_GRID.format('mw')} g, (SELECT unnest(['W3', 'W2', 'ALL']) AS i) LEFT JOIN mw m ON m.ts = g.ts AND m.symbol = g.symbol AND index_code = i",
    "source_factor": f"WITH {p.SERIES} SELECT series, ts, round(x::FLOAT::DOUBLE, 6) + 0.0 AS value FROM s",
}
