"""Queries of the time-series transforms over the hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import bars, calendar_micros
from ..functions.rolling import TRANSFORMS
from . import panels as p

QUERIES = {}
ORACLE_SQL = {}


def _frame(window, by="series"):
    if isinstance(window, int):
        return f"(PARTITION BY {by} ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"(PARTITION BY {by} ORDER BY ts RANGE BETWEEN to_microseconds({calendar_micros(window) - 1}) PRECEDING AND CURRENT ROW)"


def _query(transform, parameters, unit):
    def query(spark, sf_dir):
        frame = p.series(spark, sf_dir)
        if unit:
            frame = frame.withColumn("value", (F.col("value") + 1) / 2)
        return TRANSFORMS[transform](frame, x="value", out="out", **parameters).select("series", "ts", F.round("out", 6).alias("value"))

    return query


def _add(name, parameters, sql, ctes="", source="s", windows=None, transform=None, unit=False):
    """Registers ts_<name>; ``windows`` names frames that ``sql`` uses."""
    QUERIES[f"ts_{name}"] = _query(transform or name, parameters, unit)
    named = " WINDOW " + ", ".join(f"{k} AS {v}" for k, v in windows.items()) if windows else ""
    base = p.SERIES.replace("AS x", "AS x0") + ", s AS (SELECT series, ts, (x0 + 1) / 2 AS x FROM s0)" if unit else p.SERIES
    base = base.replace(", s AS (\n  SELECT g.series", ", s0 AS (\n  SELECT g.series") if unit else base
    ORACLE_SQL[f"ts_{name}"] = f"WITH {base}{ctes} SELECT series, ts, round(({sql})::DOUBLE, 6) + 0.0 AS value FROM {source}{named}"


_Z = "(x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0)"
_EQUAL = "min(x) OVER w = max(x) OVER w"
for _n, _w in (("", 12), ("_time", "2d")):
    _ws = {"w": _frame(_w)}
    _add(f"mean{_n}", {"window": _w}, "avg(x) OVER w", windows=_ws, transform="mean")
    _add(f"std{_n}", {"window": _w}, "stddev_samp(x) OVER w", windows=_ws, transform="std")
    _add(f"rmin{_n}", {"window": _w}, "min(x) OVER w", windows=_ws, transform="rmin")
    _add(f"rmax{_n}", {"window": _w}, "max(x) OVER w", windows=_ws, transform="rmax")
    _add(f"skew{_n}", {"window": _w}, f"CASE WHEN count(x) OVER w >= 3 THEN CASE WHEN {_EQUAL} THEN 0 ELSE skewness(x) OVER w END END", windows=_ws, transform="skew")
    _add(f"kurt{_n}", {"window": _w}, f"CASE WHEN count(x) OVER w >= 4 THEN CASE WHEN {_EQUAL} THEN -3 ELSE kurtosis(x) OVER w END END", windows=_ws, transform="kurt")
    _add(f"iqr{_n}", {"window": _w}, "quantile_cont(x, 0.75) OVER w - quantile_cont(x, 0.25) OVER w", windows=_ws, transform="iqr")
    _add(f"slope{_n}", {"window": _w}, "CASE WHEN count(x) OVER w = count(*) OVER w AND count(*) OVER w >= 2 THEN regr_slope(x, rn) OVER w * count(*) OVER w END", ", r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts)::DOUBLE AS rn FROM s)", "r", _ws, "slope")
_add("zscore", {"period_str": "3d"}, _Z, windows={"w": _frame("3d")})
_add("zscore_fxwd", {"period_str": "1d", "freq": "10min"}, _Z, windows={"w": _frame(bars("1d", "10min"))})
_add("zsc", {"period_str": "2h", "freq": "5min"}, _Z, windows={"w": _frame(bars("2h", "5min"))})
_add("dod", {"n": 2}, "s.x / nullif(o.x, 0)", source="(SELECT s.series, s.ts, s.x, o.x AS ox FROM s LEFT JOIN s o ON o.series = s.series AND o.ts = s.ts - INTERVAL 2 DAYS)".replace("s.x, o.x AS ox", "s.x, o.x AS ox"))
ORACLE_SQL["ts_dod"] = ORACLE_SQL["ts_dod"].replace("s.x / nullif(o.x, 0)", "x / nullif(ox, 0)")
_add("dod_three_minutes", {"n": 1}, "x / nullif(m, 0)", ", a AS (SELECT *, (lag(x) OVER o + x + lead(x) OVER o) / 3 AS m3 FROM s WINDOW o AS (PARTITION BY series ORDER BY ts))", "(SELECT s.series, s.ts, s.x, a.m3 AS m FROM s LEFT JOIN a ON a.series = s.series AND a.ts = s.ts - INTERVAL 1 DAY)")
_add("rsi", {"period": 6}, "CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END", f""", d AS (SELECT *, x - lag(x) OVER (PARTITION BY series ORDER BY ts) AS d FROM s
), m AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0 END AS down FROM d
), q AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN avg(up) OVER w END AS g, CASE WHEN count(*) OVER w >= 6 THEN avg(down) OVER w END AS l FROM m WINDOW w AS {_frame(6)})""", "q")

# Values of a window as a list.
_LISTED = ", a AS (SELECT *, list(x) OVER w AS a, max(x) OVER w - min(x) OVER w AS spread FROM s WINDOW w AS {frame})"
_STEPS = _LISTED + """, d AS (SELECT *, list_filter(list_transform(range(2, len(a) + 1), lambda i: a[i] - a[i - 1]), lambda v: v IS NOT NULL) AS d FROM a
), k AS (SELECT *, list_transform(d, lambda v: sign(v)::DOUBLE) AS sg, len(d) AS k FROM d)"""
for _n, _w in (("", 10), ("_time", "6h")):
    _c = _STEPS.format(frame=_frame(_w))
    _add(f"trendContinuation{_n}", {"window": _w}, "CASE WHEN k >= 2 THEN len(list_filter(sg, lambda v: v = sg[1])) / k * sg[1] END", _c, "k", transform="trendContinuation")
    _add(f"trendReversalRate{_n}", {"window": _w}, "CASE WHEN k >= 2 THEN (CASE WHEN sg[k] < 0 THEN -1 ELSE 1 END) * (1 + len(list_filter(range(2, k + 1), lambda i: sg[i] <> sg[i - 1]))) / (k - 1) END", _c, "k", transform="trendReversalRate")
    _add(f"meanTrendDirectionConsistency{_n}", {"window": _w}, "CASE WHEN k >= 2 THEN list_avg(sg) END", _c, "k", transform="meanTrendDirectionConsistency")
    _p = [f"(len(list_filter(sg, lambda v: v = {v})) / k)" for v in (-1, 0, 1)]
    _add(f"trendDirectionEntropy{_n}", {"window": _w}, "CASE WHEN k >= 2 THEN " + " + ".join(f"CASE WHEN {q} > 0 THEN -{q} * log2({q} + 1e-9) ELSE 0 END" for q in _p) + " END", _c, "k", transform="trendDirectionEntropy")
    _add(f"trendStrengthRatio{_n}", {"window": _w}, "CASE WHEN k >= 2 THEN spread / (list_stddev_pop(d) + 1e-9) * sign(list_sum(d)) END", _c, "k", transform="trendStrengthRatio")
_RANK = f""", v AS (SELECT *, list(x) OVER l AS a, avg(x) OVER h AS v, count(x) OVER l AS c, row_number() OVER o AS rn, lag(x, 3) OVER o AS back, max(x) OVER l AS hi, min(x) OVER l AS lo
  FROM s WINDOW l AS {_frame(12)}, h AS {_frame(3)}, o AS (PARTITION BY series ORDER BY ts)
), r AS (SELECT *, CASE WHEN len(a) >= 2 AND c >= 1 THEN len(list_filter(a, lambda e: e < v)) / len(a) END AS r FROM v)"""
_two = {"short_window": 3, "long_window": 12}
_add("relativePercentileChange", _two, "r - lag(r) OVER (PARTITION BY series ORDER BY ts)", _RANK, "r")
_add("layeredPercentileTrend", _two, "r * sign(x - back)", _RANK, "r")
_add("relativeExtremeTrend", _two, "CASE WHEN len(a) >= 2 THEN (v - lo) / (hi - lo + 1e-9) * sign(x - back) END", _RANK, "r")
_add("shortLongTrendInteraction", _two, "CAST(NULL AS DOUBLE)")
_add("trendInteraction", _two, f"avg(st) OVER {_frame(12)} * (x - lag(x, 11) OVER (PARTITION BY series ORDER BY ts))", ", t AS (SELECT *, x - lag(x, 3) OVER (PARTITION BY series ORDER BY ts) AS st FROM s)", "t")
_add("percentileTrendAcceleration", _two, "r - len(list_filter(a, lambda e: e < pm)) / len(a)", _RANK + ", b AS (SELECT *, list_avg(CASE WHEN len(a) > 3 THEN a[len(a) - 3:len(a) - 1] ELSE a[1:len(a) - 1] END) AS pm FROM r)", "b")

# Windows of one time of day.
_CLOCK = ", c AS (SELECT *, ts::TIME AS c FROM s)"
_BUCKET = ", c AS (SELECT *, hour(ts) * 60 + minute(ts) // 5 * 5 AS c FROM s)"
_b = {"window": "12d", "min_periods": 3}
_bw = {"w": _frame("12d", "series, c")}
_CLIP = "CASE WHEN count(x) OVER w >= {k} AND x IS NOT NULL THEN greatest(0, least(1, (x - quantile_cont(x, {q}) OVER w) / nullif(quantile_cont(x, {r}) OVER w - quantile_cont(x, {q}) OVER w, 0))) END"


def _clip(k, q=0.05, span="(quantile_cont(x, {r}) OVER w - quantile_cont(x, {q}) OVER w)", of="x"):
    low, high = f"quantile_cont({of}, {q}) OVER w", f"quantile_cont({of}, {1 - q}) OVER w"
    value = f"({of} - {low}) / nullif({high} - {low}, 0)"
    return f"CASE WHEN count({of}) OVER w >= {k} AND {of} IS NOT NULL AND ({high} - {low}) <> 0 THEN greatest(0, least(1, {value})) END"


_add("rollingRemoveIntradayEffect", {"window": "12d"}, "x - avg(x) OVER w", _CLOCK, "c", _bw)
_add("rollingMinuteQuantileScale", _b, _clip(3), _CLOCK, "c", _bw)
for _t in ("rollingAggMinuteMinMaxScale", "aggMinmax"):
    _add(_t, _b, _clip(3), _BUCKET, "c", _bw)
_UP_TO = "CASE WHEN n >= 3 THEN {f} * coalesce(len(list_filter(a, lambda e: e {op} x)), 0) / len(a) END"
_IN_BUCKET = _BUCKET + f", l AS (SELECT *, list(x) OVER w AS a, count(x) OVER w AS n FROM c WINDOW w AS {_bw['w']})"
_add("rollingAggMinutePercentile", _b, _UP_TO.format(f="100.0::DOUBLE", op=">="), _IN_BUCKET, "l")
for _t in ("rollingAggMinutePctl", "aggPctl"):
    _add(_t, _b, _UP_TO.format(f="1", op="<="), _IN_BUCKET, "l")
for _t in ("rollingMinuteZScore", "aggZsc"):
    _add(_t, _b, f"CASE WHEN count(x) OVER w >= 3 THEN {_Z} END", _BUCKET, "c", _bw)
for _t in ("rollingMinuteDeMean", "aggDmean"):
    _add(_t, _b, "CASE WHEN count(x) OVER w >= 3 THEN x - avg(x) OVER w END", _BUCKET, "c", _bw)
for _t in ("aggDivMean", "aggDivMean_parallel"):
    _add(_t, _b, "CASE WHEN count(x) OVER w >= 3 THEN x / nullif(avg(x) OVER w, 0) END", _BUCKET, "c", _bw)

for _n, _w in (("", 20), ("_time", "1d")):
    _add(f"minmax{_n}", {"window": _w}, _clip(10), windows={"w": _frame(_w)}, transform="minmax")
_add("minmax_scale", {"window": 16, "min_periods": 5}, _clip(5), windows={"w": _frame(16)})
_add("minmax_scale_numba_parallel", {}, "CASE WHEN count(f) OVER w >= 10 THEN greatest(0, least(1, (f - quantile_cont(f, 0.05) OVER w) / (quantile_cont(f, 0.95) OVER w - quantile_cont(f, 0.05) OVER w + 1e-12))) END", ", f AS (SELECT *, coalesce(x, 0)::FLOAT::DOUBLE AS f FROM s)", "f", {"w": _frame(20)})
_add("rlPctl", {"window": 12}, "CASE WHEN n > 0 THEN coalesce(len(list_filter(a, lambda e: e <= x)), 0) / n END", ", l AS (SELECT *, list(x) OVER w AS a, count(x) OVER w AS n FROM s WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))", "l")


def _half(of, low, high):
    return f"CASE WHEN count({of}) OVER w >= 5 THEN ({of} - quantile_cont({of}, {low}) OVER w) / nullif(quantile_cont({of}, {high}) OVER w - quantile_cont({of}, {low}) OVER w, 0) END"


_add("minmaxSep", {"window": 20, "min_periods": 5}, "CASE WHEN v IS NOT NULL THEN greatest(0, least(1, v)) END", f", h AS (SELECT *, CASE WHEN x > 0 THEN x END AS up, CASE WHEN x < 0 THEN x END AS dn FROM s), q AS (SELECT *, CASE WHEN x > 0 THEN 0.5 + 0.5 * ({_half('up', 0.05, 0.95)}) WHEN x < 0 THEN 0.5 * ({_half('dn', 0.95, 0.05)}) END AS v FROM h WINDOW w AS {_frame(20)})", "q")
_add("bimodal_sin", {"power": 3}, "1 - pow(sin(pi() * x), 3)", unit=True)
_add("absv", {}, "abs(x)")
_add("exp", {}, "exp(x)")
_add("power", {"gamma": 1.5}, "CASE WHEN x BETWEEN 0 AND 1 THEN pow(x, 1.5) END", unit=True)
_add("power_neg", {"gamma": 2.0, "direction": "neg"}, "CASE WHEN x BETWEEN 0 AND 1 THEN pow(1 - x, 2) END", unit=True, transform="power")

_DAY = ", d AS (SELECT *, ts::DATE AS day FROM s)"
_add("OAD", {"reference_time": "0900"}, "f - last_value(ref IGNORE NULLS) OVER u", _DAY + ", f AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY series, day ORDER BY ts) AS f FROM d), g AS (SELECT *, CASE WHEN strftime(ts, '%H%M') = '0900' THEN f END AS ref FROM f)", "g", {"u": "(PARTITION BY series, day ORDER BY ts)"})
_add("intraSma", {"window": 5}, "avg(x) OVER w", _DAY, "d", {"w": _frame(5, "series, day")})
_add("intraSum", {"window": 5}, "sum(x) OVER w", _DAY, "d", {"w": _frame(5, "series, day")})
for _t in ("intraCumSum", "intraCumSum_parallel"):
    _add(_t, {}, "CASE WHEN x IS NOT NULL THEN sum(x) OVER w END", _DAY, "d", {"w": "(PARTITION BY series, day ORDER BY ts)"})
