"""Queries of long series, increments, databases, exact quantiles and as-of joins over the given tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import scan
from ..functions.frames import timed
from ..functions.rolling import TRANSFORMS
from ..operators import asof, quantiles
from ..sources import jdbc, tables
from ..sources.versioned import FactorTable
from ..streaming import stateful
from . import panels as p
from .files import scratch

QUERIES = {}
ORACLE_SQL = {}


def _add(name, query, sql):
    QUERIES[name], ORACLE_SQL[name] = query, sql


_W = "(PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def scan_placed(s, d):
    """Numbers of rows and values along each series, by buckets."""
    return scan.placed(timed(p.series(s, d)), "value").select("series", "ts", "row", F.col("value#n").alias("n"))


def scan_cumulative_sum(s, d):
    return scan.cumulative_sum(timed(p.series(s, d)), "value", "out").select("series", "ts", F.round("out", 6).alias("value"))


def scan_filled(s, d):
    return scan.filled(timed(p.series(s, d)), "value", "out").select("series", "ts", F.round("out", 6).alias("value"))


def split_mean(s, d):
    """A moving mean over series that are cut into short ones."""
    parts = scan.split(scan.placed(timed(p.series(s, d)), "value"), 12, 50)
    return scan.rejoined(TRANSFORMS["mean"](parts, out="out", window=12)).select("series", "ts", F.round("out", 6).alias("value"))


def scan_placed_pct(s, d):
    """Relative changes of a frame that is numbered by buckets, filled by buckets."""
    return TRANSFORMS["pct_func"](scan.placed(timed(p.series(s, d)), "value"), out="out", window=3).select("series", "ts", F.round("out", 6).alias("value"))


_add("scan_placed", scan_placed, f"WITH {p.SERIES} SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) AS row, count(x) OVER {_W} AS n FROM s")
_add("scan_cumulative_sum", scan_cumulative_sum, f"WITH {p.SERIES} SELECT series, ts, CASE WHEN x IS NOT NULL THEN round(sum(x) OVER {_W}, 6) + 0.0 END AS value FROM s")
_add("scan_filled", scan_filled, f"WITH {p.SERIES} SELECT series, ts, round(last_value(x IGNORE NULLS) OVER {_W}, 6) + 0.0 AS value FROM s")
_add("split_mean", split_mean, f"WITH {p.SERIES} SELECT series, ts, round(avg(x) OVER (PARTITION BY series ORDER BY ts ROWS 11 PRECEDING), 6) + 0.0 AS value FROM s")
_add("scan_placed_pct", scan_placed_pct, f"WITH {p.SERIES}, q AS (SELECT *, lag(x, 3) OVER (PARTITION BY series ORDER BY ts) AS b FROM s) SELECT series, ts, round(last_value((x - b) / nullif(abs(b), 0) IGNORE NULLS) OVER {_W}, 6) + 0.0 AS value FROM q")


# Long windows of ranks.


def _long(name, parameters, sql):
    def query(s, d):
        return TRANSFORMS[name](p.series(s, d), out="out", **parameters).select("series", "ts", F.round("out", 6).alias("value"))

    _add(f"long_{name}", query, f"WITH {p.SERIES} {sql}")


_long("iqr", {"window": "30d"}, "SELECT series, ts, round(quantile_cont(x, 0.75) OVER w - quantile_cont(x, 0.25) OVER w, 6) + 0.0 AS value FROM s WINDOW w AS (PARTITION BY series ORDER BY ts RANGE BETWEEN to_microseconds(2591999999999) PRECEDING AND CURRENT ROW)")
_long("rlPctl", {"window": 400}, ", l AS (SELECT *, list(x) OVER w AS a, count(x) OVER w AS n FROM s WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 399 PRECEDING AND 1 PRECEDING)) SELECT series, ts, round(CASE WHEN n > 0 THEN coalesce(len(list_filter(a, lambda e: e <= x)), 0) / n END::DOUBLE, 6) + 0.0 AS value FROM l")


# Increments: what a table has after them equals the whole at once.

def _pieces(frame):
    """A series frame in three increments by fixed shares of its time."""
    ends = frame.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = [ends["a"] + (ends["b"] - ends["a"]) * k / 3 for k in (1, 2)]
    first, second = (F.lit(c).cast("timestamp_ntz") for c in cuts)
    return [frame.where(F.col("ts") < first), frame.where((F.col("ts") >= first) & (F.col("ts") < second)), frame.where(F.col("ts") >= second)]


def increments_ewma(s, d):
    """An exponential mean over increments that go on from the states before them, one of them given twice."""
    table, pieces = FactorTable(s, f"{scratch(s)}/states"), _pieces(p.series(s, d))
    for piece in (*pieces[:2], pieces[1], pieces[2]):
        stateful.update(table, piece, {"out": ("ewma", {"span": 4})})
    return table.read().select("series", "ts", F.round("out", 6).alias("value"))


def increments_cum_sum(s, d):
    table = FactorTable(s, f"{scratch(s)}/states")
    for k, piece in enumerate(_pieces(p.series(s, d))):
        stateful.update(table, piece, {"out": ("cumSum", {}), "day": ("intraCumSum", {})}, batch=k)
    return table.read().select("series", "ts", F.round("out", 6).alias("value"), F.round("day", 6).alias("day"))


def increments_table(s, d):
    """Commits that overlap, merged on read: the later row of a time stays."""
    table, frame = FactorTable(s, f"{scratch(s)}/factor", fanout=3), p.series(s, d)
    for k in range(5):
        table.commit(frame.where((F.hour("ts") + F.dayofyear("ts")) % 5 >= k).select("series", "ts", (F.col("value") + k).alias("value")), batch=k)
    return table.read().select("series", "ts", F.round("value", 6).alias("value"))


_EWMA = """, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM s), r AS (
  SELECT series, ts, i, coalesce(x, 0)::DOUBLE AS total, (x IS NOT NULL)::INT::DOUBLE AS weight, x::DOUBLE AS held FROM n WHERE i = 1
  UNION ALL
  SELECT n.series, n.ts, n.i, r.total * 0.6 + coalesce(n.x, 0), r.weight * 0.6 + (n.x IS NOT NULL)::INT, CASE WHEN n.x IS NULL THEN r.held ELSE (r.total * 0.6 + n.x) / (r.weight * 0.6 + 1) END
  FROM r JOIN n ON n.series = r.series AND n.i = r.i + 1)"""
_add("increments_ewma", increments_ewma, f"WITH RECURSIVE {p.SERIES}{_EWMA} SELECT series, ts, round(held, 6) + 0.0 AS value FROM r")
_add("increments_cum_sum", increments_cum_sum, f"WITH {p.SERIES} SELECT series, ts, CASE WHEN x IS NOT NULL THEN round(sum(x) OVER {_W}, 6) + 0.0 END AS value, CASE WHEN x IS NOT NULL THEN round(sum(x) OVER (PARTITION BY series, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0.0 END AS day FROM s")
_add("increments_table", increments_table, f"WITH {p.SERIES} SELECT series, ts, round(x + (hour(ts) + dayofyear(ts)) % 5, 6) + 0.0 AS value FROM s")


# Exact quantiles and as-of joins.


def exact_quantiles(s, d):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.quantiles(p.table(s, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v")), "v", shares)
    return s.createDataFrame(list(zip(shares, found, strict=True)), "share double, value double").select("share", F.round("value", 4).alias("value"))


def asof_events(s, d):
    """Each event with the value of the latest event before it of its user's that was above 100."""
    events = p.table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"))
    known = events.where("value > 100").groupBy("user_id", "ts").agg(F.max("value").alias("known"))
    return asof.as_of(events.drop("value"), known, ["user_id"]).select("event_id", "known", "ts_known")


def asof_events_tolerance(s, d):
    events = p.table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value"))
    known = events.where("value > 100").groupBy("user_id", "ts").agg(F.max("value").alias("known"))
    return asof.as_of(events.drop("value"), known, ["user_id"], tolerance="6h").select("event_id", "known")


_ASOF = "WITH e AS (SELECT event_id, user_id, ts::TIMESTAMP AS ts, value::DOUBLE AS value FROM events), k AS (SELECT user_id, ts AS ts_known, max(value) AS known FROM e WHERE value > 100 GROUP BY 1, 2), j AS (SELECT event_id, ts, known, ts_known FROM e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts_known)"
_add("exact_quantiles", exact_quantiles, "SELECT share::DOUBLE AS share, round(value, 4) AS value FROM (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.9, 1.0]) AS share, unnest(quantile_cont(l_extendedprice::DOUBLE, [0.0, 0.01, 0.25, 0.5, 0.9, 1.0])) AS value FROM lineitem)")
_add("asof_events", asof_events, f"{_ASOF} SELECT event_id, known, ts_known FROM j")
_add("asof_events_tolerance", asof_events_tolerance, f"{_ASOF} SELECT event_id, CASE WHEN ts - ts_known <= INTERVAL 6 HOURS THEN known END AS known FROM j")


# Databases: an embedded one within the session's JVM, so only for a local master; on a cluster, name a server.


def _database(s, *ddl):
    if not s.sparkContext.master.startswith("local[") and s.sparkContext.master != "local":
        raise ValueError("this query's database is in the driver's memory; on a cluster use a database server")
    s.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)
    db = jdbc.Database(f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    db.execute(s, *ddl)
    return db


def jdbc_scan(s, d):
    """Customers written to a database and read back in ranges of their keys."""
    db = _database(s, "CREATE TABLE customers (k BIGINT, nation INT, balance DOUBLE)")
    p.table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").cast("double").alias("balance")).write.jdbc(db.url, "customers", mode="append", properties=db.properties)
    return db.first_with_rows(s, ["SELECT k, nation, balance FROM customers WHERE k < 0", "SELECT k, nation, balance FROM customers WHERE balance > 0"], column="k", partitions=4)


def jdbc_status(s, d):
    """Status rows upserted in two overlapping batches, the second of them twice."""
    db = _database(s, "CREATE TABLE daily_update (author VARCHAR(40), object VARCHAR(10), data_ts TIMESTAMP, status INT, updated BIGINT, PRIMARY KEY (author, object, data_ts))")
    rows = p.table(s, d, "orders").select(F.col("o_orderpriority").alias("author"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").cast("timestamp").alias("data_ts"), (F.col("o_orderkey") % 2).cast("int").alias("status"), F.col("o_orderkey").cast("long").alias("timestamp"))
    for share in ("timestamp % 3 <> 0", "timestamp % 3 = 0", "timestamp % 3 = 0"):
        jdbc.write_status(db, rows.where(share))
    return db.scan(s, "SELECT author, object, data_ts, status FROM daily_update").withColumn("data_ts", F.col("data_ts").cast("timestamp_ntz"))


def jdbc_messages(s, d):
    """Messages sent twice, and those of one level marked."""
    db = _database(s, "CREATE TABLE daily_update_msg (id INT GENERATED ALWAYS AS IDENTITY, message_key VARCHAR(40) UNIQUE, author VARCHAR(40), level VARCHAR(10), title VARCHAR(40), msg VARCHAR(40), alerted INT)")
    rows = p.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("message_key"), F.lit("me").alias("author"), F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("title"), F.lit("text").alias("msg"))
    for _ in range(2):
        jdbc.send_messages(db, rows)
    seen = db.scan(s, "SELECT id FROM daily_update_msg WHERE level = 'O'").select(F.col("id").cast("int").alias("id"))
    jdbc.mark_alerted(db, seen)
    return db.scan(s, "SELECT level, title, alerted FROM daily_update_msg").groupBy("level", "title", "alerted").agg(F.count("*").alias("n"))


def jdbc_positions(s, d):
    """Positions of a wide table, written twice."""
    db = _database(s, "CREATE TABLE trade_positions (acname VARCHAR(10), stockdate DATE, symbol VARCHAR(20), position DOUBLE, inserted TIMESTAMP, PRIMARY KEY (acname, stockdate, symbol))")
    events = p.table(s, d, "events").groupBy(F.to_date("ts").alias("stockdate")).pivot("event_type").agg(F.round(F.sum(F.col("value").cast("double")), 4))
    for _ in range(2):
        jdbc.write_positions(db, tables.positions(events, "acc"))
    return db.scan(s, "SELECT acname, stockdate, symbol, position FROM trade_positions")


_ST = "st AS (SELECT o_orderpriority AS author, o_orderstatus AS object, o_orderdate::TIMESTAMP AS data_ts, (o_orderkey % 2)::INT AS status, o_orderkey AS t FROM orders)"
_add("jdbc_scan", jdbc_scan, "SELECT c_custkey::BIGINT AS k, c_nationkey::INT AS nation, c_acctbal::DOUBLE AS balance FROM customer WHERE c_acctbal > 0")
_add("jdbc_status", jdbc_status, f"WITH {_ST} SELECT author, object, data_ts, arg_max(status, (CASE WHEN t % 3 = 0 THEN 1 ELSE 0 END, t)) AS status FROM st GROUP BY 1, 2, 3")
_add("jdbc_messages", jdbc_messages, "SELECT o_orderstatus AS level, o_orderpriority AS title, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS alerted, count(*) AS n FROM orders GROUP BY 1, 2, 3")
_add("jdbc_positions", jdbc_positions, "WITH g AS (SELECT ts::DATE AS stockdate, event_type AS symbol, round(sum(value::DOUBLE), 4) AS position FROM events GROUP BY 1, 2) SELECT 'acc' AS acname, d.stockdate, y.symbol, position FROM (SELECT DISTINCT stockdate FROM g) d CROSS JOIN (SELECT DISTINCT symbol FROM g) y LEFT JOIN g ON g.stockdate = d.stockdate AND g.symbol = y.symbol")
