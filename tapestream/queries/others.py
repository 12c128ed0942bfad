"""Queries of alignment, calendars, resampling, weights, increments, plans and status tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import TRANSFORMS
from ..operators import align, calendar, weights
from ..plans import planner, spec
from ..sources import tables
from ..sources.versioned import FactorTable
from ..streaming import incremental
from . import aggregates
from . import panels as p
from .files import scratch

QUERIES = {}
ORACLE_SQL = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _value(df, digits=6):
    return df.withColumn("value", F.round("value", digits))


# Alignment and sets.


def _odd(spark, d):
    """The series at hours that aren't multiples of four, values above 0.9 missing."""
    return p.series(spark, d).where(F.hour("ts") % 4 != 0).withColumn("value", F.when(F.col("value") <= 0.9, F.col("value")))


_ODD = p.SERIES + ", odd AS (SELECT series, ts, CASE WHEN x <= 0.9 THEN x END AS x FROM s WHERE hour(ts) % 4 <> 0)"
_add("align_zero_to_null", lambda s, d: p.weekly(s, d).select("ts", "symbol", F.round(align.zero_to_null(F.floor(F.col("bid") / 200000)), 6).alias("value")), f"WITH {p.WEEKLY} SELECT ts, symbol, round(nullif(floor(bid / 200000)::DOUBLE, 0), 6) AS value FROM weekly")
_add("align_without_empty_times", lambda s, d: _value(align.without_empty_times(_odd(s, d))).select("series", "ts", "value"), f"WITH {_ODD} SELECT series, ts, round(x, 6) + 0.0 AS value FROM odd WHERE ts IN (SELECT ts FROM odd WHERE x IS NOT NULL)")
_add("align_dense", lambda s, d: _value(align.dense(_odd(s, d).where("value > 0"))).select("series", "ts", "value"), f"WITH {_ODD}, k AS (SELECT * FROM odd WHERE x > 0) SELECT g.series, g.ts, round(x, 6) + 0.0 AS value FROM (SELECT * FROM (SELECT DISTINCT ts FROM k), (SELECT DISTINCT series FROM k)) g LEFT JOIN k USING (series, ts)")
_add("align_renamed_suffixes", lambda s, d: p.table(s, d, "supplier").select("s_suppkey", align.renamed_suffixes(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ".XSHE").otherwise(".XSHG"))).alias("symbol")), "SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.SZ' ELSE '.SH' END AS symbol FROM supplier")
_add("align_common_series", lambda s, d: _value(align.common_series(p.series(s, d), _odd(s, d).where("series < 'p'"))[0]).select("series", "ts", "value"), f"WITH {_ODD} SELECT series, ts, round(x, 6) + 0.0 AS value FROM s WHERE series IN (SELECT series FROM odd WHERE series < 'p')")
_add("align_union_of_series", lambda s, d: align.union_of_series(p.series(s, d).where("series > 'c'"), _odd(s, d)).select("series", "ts", F.round("left", 6).alias("left_value"), F.round("right", 6).alias("right_value")), f"WITH {_ODD} SELECT series, ts, round(a.x, 6) + 0.0 AS left_value, round(b.x, 6) + 0.0 AS right_value FROM (SELECT * FROM s WHERE series > 'c') a FULL JOIN odd b USING (series, ts)")
_add("align_upsert", lambda s, d: _value(align.upsert(p.series(s, d), _odd(s, d))).select("series", "ts", "value"), f"WITH {_ODD} SELECT series, ts, round(x, 6) + 0.0 AS value FROM odd UNION ALL SELECT series, ts, round(x, 6) + 0.0 FROM s ANTI JOIN odd USING (series, ts)")
_add("align_append_missing", lambda s, d: align.append_missing(p.table(s, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderdate"), p.table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate"), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate NOT IN (SELECT o_orderdate FROM orders WHERE o_orderkey % 3 = 0)")
_add("align_mismatches", lambda s, d: align.mismatches(p.series(s, d), _odd(s, d)).select("series", "ts", F.round("old", 6).alias("old_value"), F.round("new", 6).alias("new_value")), f"WITH {_ODD} SELECT series, ts, round(s.x, 6) + 0.0 AS old_value, round(odd.x, 6) + 0.0 AS new_value FROM s JOIN odd USING (series, ts) WHERE s.x IS DISTINCT FROM odd.x")
_add("align_consistency", lambda s, d: align.consistency(p.series(s, d), _odd(s, d)), f"WITH {_ODD} SELECT count(*) AS n_rows, count(*) FILTER (s.x IS DISTINCT FROM odd.x) AS n_mismatches, min(ts) FILTER (s.x IS DISTINCT FROM odd.x) AS first_mismatch FROM s JOIN odd USING (series, ts)")
_add("align_latest_per_key", lambda s, d: align.latest_per_key(p.table(s, d, "events").withColumn("at", F.struct("ts", "event_id")), ["user_id"], "at").select("user_id", "event_id"), "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
_TYPES = ["click", "purchase", "view"]
_add("align_wide", lambda s, d: align.wide(p.hourly(s, d).select("ts", F.col("symbol").alias("series"), F.round("bid", 4).alias("value")), _TYPES), f"WITH {p.HOURLY} SELECT ts, " + ", ".join(f"max(round(bid, 4)) FILTER (symbol = '{t}') AS {t}" for t in _TYPES) + " FROM hourly GROUP BY ts")
_add("align_long", lambda s, d: align.long(align.wide(p.hourly(s, d).select("ts", F.col("symbol").alias("series"), F.round("bid", 4).alias("value")), _TYPES)), f"WITH {p.HOURLY} SELECT t.ts, series, round(bid, 4) AS value FROM (SELECT * FROM (SELECT DISTINCT ts FROM hourly), (SELECT unnest({_TYPES}) AS series)) t LEFT JOIN hourly h ON h.ts = t.ts AND h.symbol = series")
_add("align_described", lambda s, d: align.described(p.series(s, d), TRANSFORMS["mean"](p.series(s, d), out="m", window=3).select("series", "ts", F.col("m").alias("value"))).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75", "least", "most"))), f"WITH {p.SERIES}, d AS (SELECT abs(x - avg(x) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS d FROM s) SELECT count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(quantile_cont(d, 0.25), 6) AS q25, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.75), 6) AS q75, round(min(d), 6) AS least, round(max(d), 6) AS most FROM d")
_add("align_priced", lambda s, d: _value(align.priced(p.series(s, d), p.hourly(s, d).select("ts", F.concat(F.lit("F_"), "symbol").alias("series"), F.round("bid", 4).alias("price")), {t: f"F_{t}" for t in _TYPES})), f"WITH {p.SERIES} SELECT h.ts, 'F_' || symbol AS instrument, round(bid, 4) AS price, round(x, 6) + 0.0 AS value FROM hourly h LEFT JOIN s ON s.ts = h.ts AND s.series = h.symbol AND s.series IN ({', '.join(repr(t) for t in _TYPES)})")
_add("align_histogram", lambda s, d: align.histogram(p.table(s, d, "events"), "event_type", "value", 8), "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_type, least(floor((value - lo) / ((hi - lo) / 8)), 7)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1, 2")

_add("align_named_like", lambda s, d: align.named_like(p.table(s, d, "part"), "p_type", "^S.*", "BRASS|COPPER").select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^S.*') AND NOT regexp_matches(p_type, 'BRASS|COPPER')")
_add("align_pattern_counts", lambda s, d: align.pattern_counts(p.table(s, d, "customer"), "c_name", "0[0-9]$"), "SELECT regexp_extract(c_name, '0[0-9]$') AS match, count(*) AS n FROM customer WHERE regexp_matches(c_name, '0[0-9]$') GROUP BY 1")
_add("align_peaks", lambda s, d: _value(align.peaks(p.series(s, d))).select("series", "ts", "value"), f"WITH {p.SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY x DESC, ts) AS k FROM s WHERE x IS NOT NULL) SELECT series, ts, round(x, 6) + 0.0 AS value FROM k WHERE k = 1")

# Calendar: the trading days are those on which orders were placed and whose number isn't a multiple of 3.


def _calendar(s, d):
    return p.table(s, d, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct().where("day(trade_date) % 3 <> 0")


def _days(s, d):
    return p.table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


_CAL = "cal AS (SELECT DISTINCT o_orderdate::DATE AS trade_date FROM orders WHERE day(o_orderdate) % 3 <> 0), days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)"
_add("calendar_between", lambda s, d: calendar.trading_days(_calendar(s, d), "1996-03-05", "1997-02-11"), f"WITH {_CAL} SELECT trade_date FROM cal WHERE trade_date BETWEEN DATE '1996-03-05' AND DATE '1997-02-11'")
_add("calendar_previous", lambda s, d: calendar.previous_trading_day(_days(s, d), _calendar(s, d)), f"WITH {_CAL} SELECT day, max(trade_date) AS trade_date FROM days LEFT JOIN cal ON trade_date < day GROUP BY day")
_add("calendar_next", lambda s, d: calendar.next_trading_day(_days(s, d), _calendar(s, d)), f"WITH {_CAL} SELECT day, min(trade_date) AS trade_date FROM days LEFT JOIN cal ON trade_date > day GROUP BY day")
_add("calendar_days_ago", lambda s, d: calendar.trading_day_n_days_ago(_days(s, d), _calendar(s, d), 5), f"WITH {_CAL} SELECT day, max(trade_date) AS trade_date FROM days LEFT JOIN cal ON trade_date <= day - 5 GROUP BY day")
_add("calendar_month_ends", lambda s, d: calendar.last_trading_days_of_months(_calendar(s, d)), f"WITH {_CAL} SELECT trade_date FROM (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS n FROM cal) WHERE date_trunc('month', n) <> date_trunc('month', trade_date)")


def _months(s, d):
    return _days(s, d).select(F.trunc("day", "month").alias("month")).distinct()


_EXPIRY = f"{_CAL}, months AS (SELECT DISTINCT date_trunc('month', day)::DATE AS month FROM days), fridays AS (SELECT month, (month + ((5 - isodow(month) + 7) % 7)::INT + 14)::DATE AS friday FROM months), expiries AS (SELECT month, min(trade_date) AS expiry FROM fridays LEFT JOIN cal ON trade_date >= friday GROUP BY month)"
_add("calendar_expiry", lambda s, d: calendar.futures_expiry(_months(s, d), _calendar(s, d)), f"WITH {_EXPIRY} SELECT * FROM expiries")
_add("calendar_contract", lambda s, d: calendar.contract_month(_days(s, d), calendar.futures_expiry(_months(s, d), _calendar(s, d))), f"WITH {_EXPIRY} SELECT day, strftime(min(expiry), '%y%m') AS contract FROM days LEFT JOIN expiries ON expiry > day GROUP BY day")
_add("calendar_session_grid", lambda s, d: calendar.session_grid(_days(s, d), "30min"), f"WITH {_CAL} SELECT day, (day + to_minutes(m))::TIMESTAMP AS ts FROM days, (SELECT unnest(range(600, 691, 30)) AS m UNION ALL SELECT unnest(range(810, 896, 30))) t")
_add("calendar_in_session", lambda s, d: p.table(s, d, "events").where(calendar.in_session(F.col("ts"))).select("event_id"), "SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) + second(ts) / 60 BETWEEN 570 AND 690 OR hour(ts) * 60 + minute(ts) + second(ts) / 60 BETWEEN 780 AND 900")
_add("calendar_round_up", lambda s, d: p.table(s, d, "events").select("event_id", calendar.round_up(F.unix_millis(F.col("ts").cast("timestamp")), 3000).cast("long").alias("ms")), "SELECT event_id, (ceil((epoch_us(ts) // 1000) / 3000) * 3000)::BIGINT AS ms FROM events")


def _points(s, d):
    return p.table(s, d, "events").select(F.col("event_type").alias("series"), "ts", (F.col("value").cast("double") * p.RATE).alias("value"))


_add("resample_right", lambda s, d: _value(calendar.resample_right(_points(s, d), "15min")), f"SELECT event_type AS series, make_timestamp((ceil(epoch_us(ts) / 900000000) * 900000000)::BIGINT) AS ts, round(avg(value::DOUBLE * {p.RATE}::DOUBLE), 6) AS value FROM events GROUP BY 1, 2")
_add("resample_left", lambda s, d: _value(calendar.resample_left(_points(s, d), "30min")), f"SELECT event_type AS series, time_bucket(INTERVAL 30 MINUTES, ts)::TIMESTAMP AS ts, round(avg(value::DOUBLE * {p.RATE}::DOUBLE), 6) AS value FROM events GROUP BY 1, 2")
_add("resample_as_frequency", lambda s, d: _value(calendar.as_frequency(calendar.resample_left(_points(s, d), "30min"), "30min")), f"WITH r AS (SELECT event_type AS series, time_bucket(INTERVAL 30 MINUTES, ts)::TIMESTAMP AS ts, avg(value::DOUBLE * {p.RATE}::DOUBLE) AS v FROM events GROUP BY 1, 2), g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTES)) AS ts FROM r GROUP BY series) SELECT g.series, g.ts, round(v, 6) AS value FROM g LEFT JOIN r USING (series, ts)")
_add("resample_by_period", lambda s, d: _value(calendar.by_period(p.table(s, d, "orders").select(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), (F.col("o_totalprice").cast("double") * p.RATE).alias("value")), "month"), 4), f"SELECT o_orderstatus AS series, date_trunc('month', o_orderdate)::TIMESTAMP AS ts, round(avg(o_totalprice::DOUBLE * {p.RATE}::DOUBLE), 4) AS value FROM orders GROUP BY 1, 2")
_add("resample_intraday_profile", lambda s, d: _value(calendar.intraday_profile(_points(s, d))), f"SELECT event_type AS series, year(ts)::INT AS year, strftime(ts, '%H:%M') AS minute, round(avg(value::DOUBLE * {p.RATE}::DOUBLE), 6) AS value FROM events GROUP BY 1, 2, 3")

# Weights: regions are indexes, nations their constituents, with an effective date each quarter.


def _history(s, d):
    orders, customer = p.table(s, d, "orders"), p.table(s, d, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).where("(c_nationkey + quarter(o_orderdate)) % 7 <> 0")
    nation = F.broadcast(p.table(s, d, "nation"))  # 25 rows
    return rows.join(nation, rows.c_nationkey == nation.n_nationkey).groupBy((F.col("n_regionkey") + 1000).cast("long").alias("security_id"), F.col("n_nationkey").cast("long").alias("cons_id"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("eff_date")).agg(F.count("*").cast("double").alias("weight"))


def _securities(s, d):
    nations = p.table(s, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("long").alias("security_id"), F.col("n_name").alias("ticker_symbol"), F.lit("XSHG").alias("exchange_cd"))
    return nations.unionByName(p.table(s, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("security_id"), F.col("r_name").alias("ticker_symbol"), F.lit("IDX").alias("exchange_cd")))


_HIST = """h AS (SELECT n_regionkey + 1000 AS sid, n_nationkey AS cid, date_trunc('quarter', o_orderdate)::DATE AS eff_date, count(*)::DOUBLE AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE (c_nationkey + quarter(o_orderdate)) % 7 <> 0 GROUP BY 1, 2, 3
), members AS (SELECT r_name AS index_code, CASE WHEN cid <> 3 THEN n_name || '.XSHG' END AS symbol, eff_date, weight FROM h JOIN region ON r_regionkey + 1000 = sid JOIN nation ON n_nationkey = cid)"""
_add("weights_constituents", lambda s, d: weights.constituents(_history(s, d), _securities(s, d)), f"WITH {_HIST} SELECT * FROM members")
_DAILY = f"{_HIST}, {_CAL}, spans AS (SELECT index_code, eff_date, lead(eff_date) OVER (PARTITION BY index_code ORDER BY eff_date) AS until FROM (SELECT DISTINCT index_code, eff_date FROM members)), daily AS (SELECT m.index_code, trade_date, symbol, weight FROM spans s JOIN cal ON trade_date >= s.eff_date AND (until IS NULL OR trade_date < until) JOIN members m ON m.index_code = s.index_code AND m.eff_date = s.eff_date)"
_add("weights_daily", lambda s, d: weights.daily_weights(weights.constituents(_history(s, d), _securities(s, d)), _calendar(s, d)), f"WITH {_DAILY} SELECT * FROM daily")
_add("weights_next_day", lambda s, d: weights.labelled_next_day(weights.daily_weights(weights.constituents(_history(s, d), _securities(s, d), "ASIA"), _calendar(s, d)), _calendar(s, d)), f"WITH {_DAILY} SELECT index_code, n AS trade_date, symbol, weight FROM daily d JOIN (SELECT trade_date AS t, lead(trade_date) OVER (ORDER BY trade_date) AS n FROM cal) ON t = d.trade_date WHERE n IS NOT NULL AND index_code = 'ASIA'")
_add("weights_filled_days", lambda s, d: weights.filled_days(p.weights(s, d).where("index_code = 'W3'").select("symbol", "trade_date", "weight")), f"WITH {p.WEIGHTS}, k AS (SELECT symbol, trade_date, weight FROM w WHERE index_code = 'W3'), g AS (SELECT symbol, unnest(generate_series(min(trade_date), (SELECT max(trade_date) FROM k), INTERVAL 1 DAY))::DATE AS trade_date FROM k GROUP BY symbol) SELECT symbol, trade_date, last_value(weight IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date) AS weight FROM g LEFT JOIN k USING (symbol, trade_date)")
_add("weights_as_of", lambda s, d: weights.weights_as_of(p.weights(s, d), _calendar(s, d).where("day(trade_date) = 17").withColumnRenamed("trade_date", "day")), f"WITH {p.WEIGHTS}, {_CAL}, k AS (SELECT trade_date AS day FROM cal WHERE day(trade_date) = 17), l AS (SELECT index_code, day, max(trade_date) AS t FROM k JOIN (SELECT DISTINCT index_code, trade_date FROM w) ON trade_date <= day GROUP BY 1, 2) SELECT l.index_code, day, symbol, weight FROM l JOIN w ON w.index_code = l.index_code AND w.trade_date = t")

# Latest values, against the whole transform.
_LAST = f"WITH {p.SERIES}, l AS (SELECT series, max(ts) AS last, arg_max_null(x, ts) AS lx FROM s GROUP BY series)"
_add("latest_zscore", lambda s, d: _value(incremental.latest_zscore(p.series(s, d), "3d")), _LAST + " SELECT s.series, last AS ts, round((any_value(lx) - avg(x)) / nullif(stddev_samp(x), 0), 6) + 0.0 AS value FROM s JOIN l USING (series) WHERE ts > last - INTERVAL 3 DAYS GROUP BY 1, 2")
_add("latest_without_intraday_effect", lambda s, d: _value(incremental.latest_without_intraday_effect(p.series(s, d), "12d")), _LAST + " SELECT s.series, last AS ts, round(any_value(lx) - avg(x), 6) + 0.0 AS value FROM s JOIN l USING (series) WHERE ts > last - INTERVAL 12 DAYS AND ts::TIME = last::TIME GROUP BY 1, 2")
_add("latest_quantile_scale", lambda s, d: _value(incremental.latest_quantile_scale(p.series(s, d), "12d", 3)), _LAST + " SELECT s.series, last AS ts, CASE WHEN count(x) >= 3 AND any_value(lx) IS NOT NULL AND quantile_cont(x, 0.95) > quantile_cont(x, 0.05) THEN round(greatest(0, least(1, (any_value(lx) - quantile_cont(x, 0.05)) / (quantile_cont(x, 0.95) - quantile_cont(x, 0.05)))), 6) END AS value FROM s JOIN l USING (series) WHERE ts > last - INTERVAL 12 DAYS AND ts::TIME = last::TIME GROUP BY 1, 2")
_add("increment_updated", lambda s, d: _value(incremental.updated(p.series(s, d).where("ts < '2024-01-20'"), p.series(s, d).where("ts >= '2024-01-15'"), 1e-9)).select("series", "ts", "value"), f"WITH {p.SERIES} SELECT series, ts, round(x, 6) + 0.0 AS value FROM s")

# A whole spec: two aggregations, two layers.
SPEC = {
    "target_indexes": p.TARGETS, "index_all": "ALL", "index_seq": p.TARGETS,
    "aggregation": {"w": {"aggregation": "wavg_imb", "imb": "imb01"}, "side": {"aggregation": "avg_side"}},
    "ts": {"mean": {"window": [3, 6]}}, "ts_second_layer": {"absv": {"base_ts": ["mean"], "params": {}}},
}


def _shown(made):
    """Amounts in another currency."""
    amount = F.round(F.col("value") * p.RATE, 3)
    return made.withColumn("value", F.when(F.col("factor").contains("side"), amount).otherwise(F.round("value", 6)))


def plan_generated(s, d):
    return _shown(planner.generated(p.weekly(s, d), p.setting(s, d), spec.parsed(SPEC), "week"))


def plan_extended(s, d):
    """The factors up to mid 1997, then those from 1997 on out of half a year before."""
    week, setting, parsed = p.weekly(s, d), p.setting(s, d), spec.parsed(SPEC)
    old = planner.generated(week.where("ts < '1997-07-01'"), setting, parsed, "week")
    return _shown(planner.extended(old, week, setting, parsed, "week", "1997-01-01", "180d", tolerance=1e-5))


def plan_advanced(s, d):
    """The factors in three increments that read no history, one of them given twice."""
    week, setting, parsed = p.weekly(s, d), p.setting(s, d), spec.parsed(SPEC)
    table = FactorTable(s, f"{scratch(s)}/plan")
    for k, (since, until) in ((0, ("1900-01-01", "1995-02-01")), (1, ("1995-02-01", "1997-07-01")), (1, ("1995-02-01", "1997-07-01")), (2, ("1997-07-01", "2100-01-01"))):
        planner.advanced(table, week.where((F.col("ts") >= since) & (F.col("ts") < until)), setting, parsed, "week", batch=k)
    return _shown(planner.table_rows(table, parsed))


_LAYERS = {"org": "x", "mean_w3": "m3", "mean_w6": "m6", "org-absv": "abs(x)", "mean_w3-absv": "abs(m3)", "mean_w6-absv": "abs(m6)"}
_SIDES = aggregates._weighted(aggregates._RANGE[0])
_PLAN = f"""WITH {p.WEEKLY}, {p.WEIGHTS}, sides AS ({_SIDES}), f AS (
  SELECT 'week-w' AS name, series, ts, {aggregates._IMB01} AS x FROM ({aggregates._weighted("SELECT * FROM w", aggregates._WMEAN)})
  UNION ALL SELECT 'week-side_Bid', series, ts, bid FROM sides UNION ALL SELECT 'week-side_Ask', series, ts, ask FROM sides
), g AS (
  SELECT name, series, ts, x FROM (SELECT DISTINCT name, ts FROM f WHERE x IS NOT NULL) JOIN (SELECT DISTINCT name, series FROM f) USING (name) LEFT JOIN f USING (name, series, ts)
), m AS (
  SELECT *, avg(x) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(x) OVER (o ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m6 FROM g WINDOW o AS (PARTITION BY name, series ORDER BY ts)
) SELECT factor, series, ts, CASE WHEN contains(factor, 'side') THEN round(x * {p.RATE}::DOUBLE, 3) ELSE round(x, 6) END + 0.0 AS value FROM ({" UNION ALL ".join(f"SELECT name || '-{k}' AS factor, series, ts, {v} AS x FROM m" for k, v in _LAYERS.items())})"""


def plan_paths(s, d):
    steps = {"a": spec._steps("mean", {"window": [3]}), "b": spec._steps("absv", {}), "c": spec._steps("rmax", {"window": [4]})}
    nodes = planner.along_paths(p.series(s, d).select(F.lit("f").alias("factor"), "series", "ts", "value"), [["a", "b"], ["a", "c"]], steps)
    return _value(nodes["a_TS_b"].unionByName(nodes["a_TS_c"]))


_add("plan_generated", plan_generated, _PLAN)
_add("plan_extended", plan_extended, _PLAN)
_add("plan_advanced", plan_advanced, _PLAN)
_add("plan_paths", plan_paths, f"WITH {p.SERIES}, a AS (SELECT series, ts, avg(x) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM s) SELECT 'f-mean_w3-absv' AS factor, series, ts, round(abs(m), 6) + 0.0 AS value FROM a UNION ALL SELECT 'f-mean_w3-rmax_w4', series, ts, round(max(m) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) + 0.0 FROM a")

# Status and message tables, from orders.


def _status(s, d):
    return p.table(s, d, "orders").select(F.col("o_orderpriority").alias("author"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").cast("timestamp_ntz").alias("data_ts"), (F.col("o_orderkey") % 2).cast("int").alias("status"), F.col("o_orderkey").alias("timestamp"))


_STATUS = "st AS (SELECT o_orderpriority AS author, o_orderstatus AS object, o_orderdate::TIMESTAMP AS data_ts, (o_orderkey % 2)::INT AS status, o_orderkey AS timestamp FROM orders)"
_add("status_upsert", lambda s, d: tables.with_status(align.latest_per_key(_status(s, d).where("timestamp % 5 <> 0"), ["author", "object", "data_ts"], "timestamp"), _status(s, d).where("timestamp % 5 = 0")), f"WITH {_STATUS}, old AS (SELECT author, object, data_ts, arg_max(status, timestamp) AS status, max(timestamp) AS timestamp FROM st WHERE timestamp % 5 <> 0 GROUP BY 1, 2, 3), new AS (SELECT author, object, data_ts, arg_max(status, timestamp) AS status, max(timestamp) AS timestamp FROM st WHERE timestamp % 5 = 0 GROUP BY 1, 2, 3) SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (author, object, data_ts)")
_add("status_since", lambda s, d: tables.status_since(_status(s, d), "1-URGENT", "F", "1996-01-01").select("data_ts", "status", "timestamp"), f"WITH {_STATUS} SELECT data_ts, status, timestamp FROM st WHERE author = '1-URGENT' AND object = 'F' AND data_ts >= TIMESTAMP '1996-01-01'")
_add("status_ready", lambda s, d: tables.is_ready(_status(s, d), "2001-07-01"), f"WITH {_STATUS} SELECT coalesce(bool_or(data_ts::DATE >= DATE '2001-07-01' AND status = 1), false) AS ready FROM st")


def _messages(s, d):
    return p.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("level"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).alias("alerted"))


_MESSAGES = "ms AS (SELECT o_orderkey AS id, o_orderstatus AS level, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS alerted FROM orders)"
_add("messages_insert", lambda s, d: tables.with_message(_messages(s, d), "me", "P", "late", "text"), f"WITH {_MESSAGES} SELECT * FROM ms UNION ALL BY NAME SELECT max(id) + 1 AS id, 'P' AS level, 0 AS alerted FROM ms")
_add("messages_open", lambda s, d: tables.open_messages(_messages(s, d), ["F", "P"]), f"WITH {_MESSAGES} SELECT * FROM ms WHERE alerted = 0 AND level IN ('F', 'P')")
_add("messages_open_not", lambda s, d: tables.open_messages(_messages(s, d), ["F", "P"], among=False), f"WITH {_MESSAGES} SELECT * FROM ms WHERE alerted = 0 AND level NOT IN ('F', 'P')")
_add("messages_alerted", lambda s, d: tables.alerted(_messages(s, d), _messages(s, d).where("level = 'O'").select("id")), f"WITH {_MESSAGES} SELECT id, level, CASE WHEN level = 'O' THEN 1 ELSE alerted END AS alerted FROM ms")
_add("completeness_summary", lambda s, d: tables.completeness_summary(p.table(s, d, "lineitem").select((1 - F.col("l_discount").cast("double")).alias("rate"), (F.col("l_linenumber") - 2).cast("double").alias("missing"))).select("n_incomplete", F.round("least_rate", 6).alias("least_rate"), F.round("mean_rate", 6).alias("mean_rate"), "n_missing", "most_missing", F.round("mean_missing", 6).alias("mean_missing")), "WITH t AS (SELECT 1 - l_discount::DOUBLE AS rate, (l_linenumber - 2)::DOUBLE AS missing FROM lineitem) SELECT count(*) FILTER (rate < 1) AS n_incomplete, round(min(rate) FILTER (rate < 1), 6) AS least_rate, round(avg(rate) FILTER (rate < 1), 6) AS mean_rate, count(*) FILTER (missing > 0) AS n_missing, max(missing) FILTER (missing > 0) AS most_missing, round(avg(missing) FILTER (missing > 0), 6) AS mean_missing FROM t")
