"""Panels that the registered queries derive from the given tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.imbalance import IMBALANCE
from ..operators.aggregate import Setting

TARGETS = ["W3", "W2", "ALL"]
FIRST_VENUE = ("5", "6")
#: Amounts are shown in another currency: averages of cents lie on ties of a rounding too often.
RATE = 0.7182818


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol() -> Column:
    """A nation as a symbol; its first digit tells its venue."""
    return F.concat_ws("_", (F.col("n_nationkey") % 10).cast("string"), "n_name").alias("symbol")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator per hour and event type: bid from even users, ask from odd ones."""
    even = F.col("user_id") % 2 == 0
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("symbol")).agg(F.sum(F.when(even, F.col("value"))).cast("double").alias("bid"), F.sum(F.when(~even, F.col("value"))).cast("double").alias("ask"))


HOURLY = """hourly AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type AS symbol,
         sum(value) FILTER (user_id % 2 = 0)::DOUBLE AS bid, sum(value) FILTER (user_id % 2 <> 0)::DOUBLE AS ask
  FROM events GROUP BY 1, 2)"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator per week and nation: bid from finished orders, ask from open ones."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    price = F.col("o_totalprice").cast("double")
    return rows.groupBy(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts"), symbol()).agg(F.sum(F.when(F.col("o_orderstatus") == "F", price)).alias("bid"), F.sum(F.when(F.col("o_orderstatus") == "O", price)).alias("ask"))


WEEKLY = """weekly AS (
  SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, (n_nationkey % 10) || '_' || n_name AS symbol,
         sum(o_totalprice::DOUBLE) FILTER (o_orderstatus = 'F') AS bid, sum(o_totalprice::DOUBLE) FILTER (o_orderstatus = 'O') AS ask
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator per week and brand: bid from returned items, ask from accepted ones."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    amount = F.col("l_quantity").cast("double")
    return rows.groupBy(F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("p_brand").alias("symbol")).agg(F.sum(F.when(F.col("l_returnflag") == "R", amount)).alias("bid"), F.sum(F.when(F.col("l_returnflag") == "A", amount)).alias("ask"))


BRANDS = """brands AS (
  SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS ts, p_brand AS symbol,
         sum(l_quantity::DOUBLE) FILTER (l_returnflag = 'R') AS bid, sum(l_quantity::DOUBLE) FILTER (l_returnflag = 'A') AS ask
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def unit_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance of each brand and week moved to [0, 1]."""
    return brands(spark, sf_dir).select("ts", "symbol", ((IMBALANCE["imb01"](F.col("bid"), F.col("ask")) + 1) / 2).alias("x"))


UNIT_BRANDS = BRANDS + ", panel AS (SELECT ts, symbol, ((bid - ask) / nullif(bid + ask, 0) + 1) / 2 AS x FROM brands)"


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three nested indexes of nations by month: the nation's orders in that month, on each of its week starts."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.to_date(F.date_trunc("week", "o_orderdate"))
    counted = rows.groupBy(day.alias("trade_date"), symbol(), F.col("n_nationkey").alias("k")).agg(F.count("*").cast("double").alias("weight"))
    counted = counted.where((F.month("trade_date") + F.col("k")) % 25 != 0)
    codes = F.when(F.col("k") % 5 == 0, F.array(*map(F.lit, ("W3", "W2", "ALL")))).when(F.col("k") % 5 == 1, F.array(*map(F.lit, ("W2", "ALL")))).otherwise(F.array(F.lit("ALL")))
    return counted.select(F.explode(codes).alias("index_code"), "trade_date", "symbol", "weight")


WEIGHTS = """w AS (
  SELECT unnest(CASE WHEN k % 5 = 0 THEN ['W3', 'W2', 'ALL'] WHEN k % 5 = 1 THEN ['W2', 'ALL'] ELSE ['ALL'] END) AS index_code, trade_date, symbol, weight
  FROM (SELECT date_trunc('week', o_orderdate)::DATE AS trade_date, (n_nationkey % 10) || '_' || n_name AS symbol, n_nationkey AS k, count(*)::DOUBLE AS weight
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
  WHERE (month(trade_date) + k) % 25 <> 0)"""


def setting(spark: SparkSession, sf_dir: str) -> Setting:
    return Setting(weights(spark, sf_dir), TARGETS, "ALL", TARGETS, first_venue=FIRST_VENUE)


def minute_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of one's own per index, week and nation: orders of that week, for odd counts only."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = rows.groupBy(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("ts"), symbol()).agg(F.count("*").alias("n"))
    return counted.select(F.explode(F.array(*map(F.lit, TARGETS))).alias("index_code"), "ts", "symbol", F.when(F.col("n") % 2 == 1, F.col("n").cast("double")).alias("weight"))


MINUTE_WEIGHTS = """mw AS (
  SELECT unnest(['W3', 'W2', 'ALL']) AS index_code, ts, symbol, CASE WHEN n % 2 = 1 THEN n::DOUBLE END AS weight
  FROM (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, (n_nationkey % 10) || '_' || n_name AS symbol, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense grid of hours and event types with their imbalance: series, ts, value."""
    ind = hourly(spark, sf_dir).select(F.col("symbol").alias("series"), "ts", IMBALANCE["imb01"](F.col("bid"), F.col("ask")).alias("value"))
    grid = ind.select("ts").distinct().crossJoin(F.broadcast(ind.select("series").distinct()))  # the series of one factor are few
    return grid.join(ind, ["series", "ts"], "left")


SERIES = HOURLY + """, s AS (
  SELECT g.series, g.ts, (bid - ask) / nullif(bid + ask, 0) AS x
  FROM (SELECT * FROM (SELECT DISTINCT ts FROM hourly), (SELECT DISTINCT symbol AS series FROM hourly)) g
  LEFT JOIN hourly h ON h.ts = g.ts AND h.symbol = g.series)"""
