"""Queries of imbalances, cross-sectional reducers and aggregators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cross_section
from ..functions.imbalance import IMBALANCE
from ..functions.rolling import TRANSFORMS
from ..operators import aggregate, universe
from . import panels as p

QUERIES = {}
ORACLE_SQL = {}

# Imbalances of the hourly panel.
_IMB = {
    "imb01": "(bid - ask) / nullif(bid + ask, 0)", "imb02": "abs(bid - ask) / nullif(abs(bid) + abs(ask), 0)", "imb03": "ask / nullif(bid, 0)",
    "imb04": "(ask - bid) / nullif(greatest(ask, bid), 0)", "imb05": "(abs(ask) - abs(bid)) / nullif(abs(ask) + abs(bid), 0)", "imb06": "ask - bid",
    "imb07": "(ask - bid) / nullif(abs(ask) + abs(bid), 0)", "imb08": "(ask + bid) / 2", "imb09": "(bid - ask) / nullif(ask + bid, 0)", "imb10": "bid - ask", "add": "bid + ask",
}


def _imbalance(name):
    def query(spark, sf_dir):
        b, a = F.col("bid"), F.col("ask")
        value = IMBALANCE[name](b, a, a, b) if name == "imb09" else IMBALANCE[name](b, a)
        return p.hourly(spark, sf_dir).select("ts", "symbol", F.round(value, 6).alias("value"))

    return query


for _name, _sql in _IMB.items():
    QUERIES[f"imb_{_name}"] = _imbalance(_name)
    ORACLE_SQL[f"imb_{_name}"] = f"WITH {p.HOURLY} SELECT ts, symbol, round({_sql}, 6) + 0.0 AS value FROM hourly"

# Reducers of the brands' weekly values.
_M = "(SELECT *, avg(x) OVER (PARTITION BY ts) AS m FROM panel)"
_BREADTH = "(count(*) FILTER (x > 0) - count(*) FILTER (x < 0)) / nullif(count(x), 0)"
_HHI = "sum(x * x) / nullif(sum(abs(x)), 0) ^ 2"
_HHIP = "sum(x * x) FILTER (x > 0) / nullif(sum(x) FILTER (x > 0), 0) ^ 2"
_HHIN = "sum(x * x) FILTER (x < 0) / nullif(sum(-x) FILTER (x < 0), 0) ^ 2"
_CS = {
    "csmean": "avg(x)", "cssum": "coalesce(sum(x), 0)", "cs_adjusted_cv": "1 - stddev_pop(abs(x - 0.5)) / (avg(abs(x - 0.5)) + 1e-10)",
    "cs_direction_consistency": "(count(*) FILTER (x > 0.5) - count(*) FILTER (x < 0.5)) / count(*)", "cs_polarization": "avg(abs(x - 0.5))",
    "cs_concentration": "1 - avg(abs(x - m)) / 0.5", "cs_direction": "(avg(x) - 0.5) * 2", "cs_consensus_strength": "avg(x - 0.5) * 2",
    "cs_skewness": "CASE WHEN var_pop(x) > 0 THEN (avg(x^3) - 3 * avg(x) * avg(x^2) + 2 * avg(x)^3) / stddev_pop(x)^3 END", "cs_kurtosis": "kurtosis_pop(x) + 3",
    "cs_gini": "CASE WHEN coalesce(sum(x), 0) <= 0 THEN 0 ELSE (count(x) + 1 - 2 * sum(x * (nx - rk + 1)) / sum(x)) / count(x) END", "cs_iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "cs_mad": "avg(abs(x - m))", "cs_consensus_index": "(avg(x) - 0.5) / 0.5 * (1 - avg(abs(x - m)) / 0.5)", "cs_above_threshold": "count(*) FILTER (x > 0.5) / count(*)", "cs_below_threshold": "count(*) FILTER (x < 0.5) / count(*)",
    "cs_breadth": _BREADTH, "cs_hhi": _HHI, "cs_hhi_positive": _HHIP, "cs_hhi_negative": _HHIN, "cs_breadth_positive": "count(*) FILTER (x > 0) / nullif(count(x), 0)", "cs_breadth_negative": "count(*) FILTER (x < 0) / nullif(count(x), 0)",
    "cs_diffusion_positive": f"count(*) FILTER (x > 0) / nullif(count(x), 0) * (1 - {_HHIP})", "cs_diffusion_negative": f"count(*) FILTER (x < 0) / nullif(count(x), 0) * (1 - {_HHIN})",
}
_SIGNED = {n for n in _CS if "breadth" in n or "hhi" in n or "diffusion" in n}
_RANKED = "(SELECT *, count(x) OVER (PARTITION BY ts) AS nx, row_number() OVER (PARTITION BY ts ORDER BY x NULLS LAST) AS rk FROM panel)"


def _reducer(name):
    def query(spark, sf_dir):
        panel = p.unit_brands(spark, sf_dir)
        if name in _SIGNED:
            panel = panel.withColumn("x", F.col("x") * 2 - 1)
        return cross_section.reduce_cross_section(panel, name, ["ts"], {"value": "x"}).select("ts", F.round("value", 6).alias("value"))

    return query


def _cs_sql(name, sql):
    source = _M if name in cross_section.TWO_PASS else _RANKED if name == "cs_gini" else "panel"
    return f"WITH {p.UNIT_BRANDS.replace('+ 1) / 2 AS x', '+ 0) / 1 AS x') if name in _SIGNED else p.UNIT_BRANDS} SELECT ts, round(({sql})::DOUBLE, 6) + 0.0 AS value FROM {source} GROUP BY ts"


for _name, _sql in _CS.items():
    QUERIES[_name if _name.startswith("cs_") else f"cs_{_name[2:]}"] = _reducer(_name)
    ORACLE_SQL[_name if _name.startswith("cs_") else f"cs_{_name[2:]}"] = _cs_sql(_name, _sql)

QUERIES["cs_entropy"] = _reducer("cs_entropy")
ORACLE_SQL["cs_entropy"] = f"""WITH {p.UNIT_BRANDS}, bins AS (
  SELECT ts, unnest(range(10)) AS b FROM (SELECT DISTINCT ts FROM panel)
), counts AS (
  SELECT b.ts, b, count(x) AS c FROM bins b LEFT JOIN panel q ON q.ts = b.ts AND x BETWEEN 0 AND 1 AND least(floor(x * 10), 9) = b GROUP BY ALL
), shares AS (
  SELECT ts, c / nullif(sum(c) OVER (PARTITION BY ts), 0) + 1e-10 AS s FROM counts
), normed AS (
  SELECT ts, s / sum(s) OVER (PARTITION BY ts) AS s FROM shares
) SELECT ts, round(-sum(s * ln(s)), 6) + 0.0 AS value FROM normed GROUP BY ts"""


def cs_hhi_weighted(spark, sf_dir):
    panel = p.brands(spark, sf_dir)
    return cross_section.hhi_weighted(panel, ["ts"], "bid", "ask").select("ts", F.round("value", 6).alias("value"))


QUERIES["cs_hhi_weighted"] = cs_hhi_weighted
ORACLE_SQL["cs_hhi_weighted"] = f"WITH {p.BRANDS}, panel AS (SELECT ts, CASE WHEN ask > 0 THEN bid / ask END AS x FROM brands) SELECT ts, round({_HHI}, 6) + 0.0 AS value FROM panel GROUP BY ts"

# Aggregators of the nations' weekly panel.
_BASE = f"WITH {p.WEEKLY}, {p.WEIGHTS}, {p.MINUTE_WEIGHTS}"
_T = "(SELECT unnest(['W3', 'W2', 'ALL']) AS target)"
#: (index_code, trade_date, symbol, weight) of each target by depth.
_RANGE = {
    0: "SELECT index_code, trade_date, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY index_code, trade_date) AS weight FROM w",
    1: "SELECT DISTINCT target AS index_code, trade_date, symbol, 1.0::DOUBLE AS weight FROM w JOIN (VALUES ('W3', 'W3'), ('W3', 'W2'), ('W2', 'W2'), ('W2', 'ALL'), ('ALL', 'ALL')) m(target, code) ON code = index_code",
    "all": """SELECT target AS index_code, trade_date, symbol, 1.0::DOUBLE / n AS weight FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM w WHERE index_code = 'ALL') b
              JOIN (SELECT unnest(['W3', 'W2', 'ALL']) AS target) t ON NOT EXISTS (
                SELECT 1 FROM w o JOIN (VALUES ('W2', 'W3'), ('ALL', 'W3'), ('ALL', 'W2')) m(t2, code) ON code = o.index_code WHERE t2 = target AND o.trade_date = b.trade_date AND o.symbol = b.symbol)""",
}
_RAW_ALL = _RANGE["all"].replace("1.0::DOUBLE / n AS weight", "weight")
_IMB01 = "(bid - ask) / nullif(bid + ask, 0)"


def _final(inner, imb=_IMB01, digits=6):
    return f"SELECT ts, series, round({imb}, {digits}) + 0.0 AS value FROM ({inner})"


def _weighted(weights, reduce="avg({x} * weight)", where=""):
    return f"SELECT ts, index_code AS series, {reduce.format(x='bid')} AS bid, {reduce.format(x='ask')} AS ask FROM weekly JOIN ({weights}) u ON ts::DATE = trade_date AND weekly.symbol = u.symbol {where} GROUP BY 1, 2"


_WMEAN = "sum(weight * {x}) / nullif(sum(weight) FILTER ({x} IS NOT NULL), 0)"



def _rounded(df, digits=6):
    return df.select("ts", "series", F.round("value", digits).alias("value"))


def _amount(column, digits=3):
    return F.round(F.col(column) * p.RATE, digits).alias(column)


def _agg(name, make, sql):
    QUERIES[f"agg_{name}"] = lambda spark, sf_dir: make(p.weekly(spark, sf_dir), p.setting(spark, sf_dir), lambda: p.minute_weights(spark, sf_dir))
    ORACLE_SQL[f"agg_{name}"] = f"{_BASE} {sql}"


def _depths(values, name):
    return [(d, name if d == 0 else f"{name}_{'board' if d == 'all' else f'depth{d}'}") for d in values]


def _mean_depth(inner, value=_IMB01):
    return f"""SELECT ts, target AS series, round(avg(value), 6) + 0.0 AS value FROM (SELECT ts, series, {value} AS value FROM ({inner}))
               JOIN (VALUES ('W3', 'W3'), ('W3', 'W2'), ('W2', 'W2'), ('W2', 'ALL'), ('ALL', 'ALL')) m(target, code) ON code = series GROUP BY 1, 2"""


_STOCK = f"(SELECT ts, symbol, {_IMB01} AS v FROM weekly)"


def _stock_mean(weights):
    return f"SELECT ts, index_code AS series, sum(weight * v) / nullif(sum(weight) FILTER (v IS NOT NULL), 0) AS v FROM {_STOCK} k JOIN ({weights}) u ON ts::DATE = trade_date AND k.symbol = u.symbol GROUP BY 1, 2"


for _d, _n in _depths((0, 1, "all"), "avg_imb"):
    _agg(_n, lambda ind, s, _, d=_d: _rounded(aggregate.avg_imb(ind, s, depth=d)), _final(_weighted(_RANGE[_d])))
for _d, _n in _depths((0, 1, "all"), "avg_side"):
    _agg(_n, lambda ind, s, _, d=_d: aggregate.avg_side(ind, s, depth=d).select("ts", "series", _amount("bid"), _amount("ask")), f"SELECT ts, series, round(bid * {p.RATE}::DOUBLE, 3) + 0.0 AS bid, round(ask * {p.RATE}::DOUBLE, 3) + 0.0 AS ask FROM ({_weighted(_RANGE[_d])})")
for _x, _c in (("SH", "IN ('5', '6')"), ("SZ", "NOT IN ('5', '6')")):
    _agg(f"avg_imb_{_x.lower()}", lambda ind, s, _, x=_x: _rounded(aggregate.avg_imb(ind, s, exchange=x)), _final(_weighted(_RANGE[0], where=f"WHERE weekly.symbol[1] {_c}")))
for _i, _q in (("imb06", "ask - bid"), ("imb08", "(ask + bid) / 2")):
    _agg(f"avg_{_i}", lambda ind, s, _, i=_i: aggregate.avg_imb(ind, s, i).select("ts", "series", _amount("value")), _final(_weighted(_RANGE[0]), f"({_q}) * {p.RATE}::DOUBLE", 3))
for _d, _n in _depths((0, 1, "all"), "sum_imb"):
    _agg(_n, lambda ind, s, _, d=_d: _rounded(aggregate.sum_imb(ind, s, depth=d)), _final(_weighted(_RANGE[_d], "coalesce(sum({x} * weight), 0)")))
_agg("wavg_imb", lambda ind, s, _: _rounded(aggregate.wavg_imb(ind, s)), _final(_weighted("SELECT * FROM w", _WMEAN)))
_agg("wavg_imb_depth1", lambda ind, s, _: _rounded(aggregate.wavg_imb(ind, s, depth=1)), _mean_depth(_weighted("SELECT * FROM w", _WMEAN)))
_agg("wavg_imb_board", lambda ind, s, _: _rounded(aggregate.wavg_imb(ind, s, depth="all")), _final(_weighted(_RAW_ALL, _WMEAN)))
_agg("imb_wavg", lambda ind, s, _: _rounded(aggregate.imb_wavg(ind, s)), _final(_stock_mean("SELECT * FROM w"), "v"))
_agg("imb_wavg_depth1", lambda ind, s, _: _rounded(aggregate.imb_wavg(ind, s, depth=1)), _mean_depth(_stock_mean("SELECT * FROM w"), "v"))
_agg("imb_wavg_board", lambda ind, s, _: _rounded(aggregate.imb_wavg(ind, s, depth="all")), _final(_stock_mean(_RAW_ALL), "v"))
for _d, _n in _depths((0, 1, "all"), "imb_avg"):
    _agg(_n, lambda ind, s, _, d=_d: _rounded(aggregate.imb_avg(ind, s, depth=d)), _final(_stock_mean(f"SELECT index_code, trade_date, symbol, 1.0::DOUBLE AS weight FROM ({_RANGE[_d]})"), "v"))
_agg("imb_csf", lambda ind, s, _: _rounded(aggregate.imb_csf(ind, s)), _final(_stock_mean("SELECT * FROM w"), "v"))
_agg("imb_csf_hhi", lambda ind, s, _: _rounded(aggregate.imb_csf(ind, s, cs="cs_hhi")), f"""SELECT ts, series, round(sum(x * x) / nullif(sum(abs(x)), 0) ^ 2, 6) + 0.0 AS value FROM (
  SELECT ts, index_code AS series, v * weight AS x FROM {_STOCK} k JOIN w u ON ts::DATE = trade_date AND k.symbol = u.symbol) GROUP BY 1, 2""")
_agg("norm_wavg_imb", lambda ind, s, _: _rounded(aggregate.norm_wavg_imb(ind, s)), _final(f"SELECT ts, index_code AS series, sum(weight * b) / nullif(sum(weight) FILTER (b IS NOT NULL), 0) AS bid, sum(weight * a) / nullif(sum(weight) FILTER (a IS NOT NULL), 0) AS ask FROM (SELECT ts, symbol, bid / nullif(bid + ask, 0) AS b, ask / nullif(bid + ask, 0) AS a FROM weekly) k JOIN (SELECT r.index_code, r.trade_date, r.symbol, o.weight FROM ({_RANGE[0]}) r JOIN w o ON o.index_code = 'ALL' AND o.trade_date = r.trade_date AND o.symbol = r.symbol) u ON ts::DATE = trade_date AND k.symbol = u.symbol GROUP BY 1, 2"))
_MINUTE = "SELECT ts, mw.index_code AS series, {b} AS bid, {a} AS ask FROM weekly JOIN mw USING (ts, symbol) {where} GROUP BY 1, 2"
_IN_RANGE = "WHERE EXISTS (SELECT 1 FROM w r WHERE r.index_code = mw.index_code AND r.trade_date = ts::DATE AND r.symbol = weekly.symbol)"
_agg("selfwavg_imb", lambda ind, s, m: _rounded(aggregate.selfwavg_imb(ind, s, m())), _final(_MINUTE.format(b=_WMEAN.format(x="bid"), a=_WMEAN.format(x="ask"), where="")))
_agg("selfwavg_imb_depth0", lambda ind, s, m: _rounded(aggregate.selfwavg_imb(ind, s, m(), depth=0)), _final(_MINUTE.format(b=_WMEAN.format(x="bid"), a=_WMEAN.format(x="ask"), where=_IN_RANGE)))
_agg("selfavg_imb", lambda ind, s, m: _rounded(aggregate.selfavg_imb(ind, s, m())), _final(_MINUTE.format(b="avg(bid)", a="avg(ask)", where="WHERE weight > 0")))
_agg("subset_wavg_imb", lambda ind, s, m: _rounded(aggregate.subset_wavg_imb(ind, s, m())), f"""SELECT ts, index_code AS series, round((coalesce(sum(bid * r.weight) FILTER (m.weight > 0), 0) - coalesce(sum(ask * r.weight) FILTER (m.weight > 0), 0)) / nullif(coalesce(sum(bid * r.weight), 0) + coalesce(sum(ask * r.weight), 0), 0), 6) + 0.0 AS value
  FROM (SELECT index_code, trade_date, symbol, 1.0::DOUBLE AS weight FROM w) r JOIN weekly k ON k.ts::DATE = r.trade_date AND k.symbol = r.symbol LEFT JOIN (SELECT index_code AS code, ts AS mts, symbol AS msymbol, weight FROM mw) m ON code = index_code AND mts = ts AND msymbol = k.symbol GROUP BY 1, 2""")
_FLOW = f"SELECT ts, index_code AS series, (bid - ask) * weight AS x FROM weekly JOIN ({_RANGE[0]}) u ON ts::DATE = trade_date AND weekly.symbol = u.symbol"
for _c, _q in (("cs_breadth", _BREADTH), ("cs_hhi", _HHI), ("cs_diffusion_positive", _CS["cs_diffusion_positive"])):
    _agg(f"fund_flow_{_c[3:]}", lambda ind, s, _, c=_c: _rounded(aggregate.fund_flow_metrics(ind, s, c)), f"SELECT ts, series, round(({_q})::DOUBLE, 6) + 0.0 AS value FROM ({_FLOW}) GROUP BY 1, 2")
_agg("avg_scale_imb", lambda ind, s, _: _rounded(aggregate.avg_scale_imb(ind, s, lambda f, x, out: TRANSFORMS["mean"](f, x=x, out=out, window=4))), _final(f"SELECT ts, series, avg(bid) OVER f AS bid, avg(ask) OVER f AS ask FROM ({_weighted(_RANGE[0])}) WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"))
_agg("venue_weights", lambda ind, s, _: universe.on_venue(universe.equal_weights(s.weights), "SH", s.first_venue).select("index_code", "trade_date", "symbol", F.round("weight", 6).alias("weight")), f"SELECT index_code, trade_date, symbol, round(weight, 6) AS weight FROM ({_RANGE[0]}) WHERE symbol[1] IN ('5', '6')")
_agg("lagged_weights", lambda ind, s, _: universe.lagged(s.weights).select("index_code", "trade_date", "symbol", "weight"), "SELECT w.index_code, nd AS trade_date, symbol, weight FROM w JOIN (SELECT *, lead(trade_date) OVER (PARTITION BY index_code ORDER BY trade_date) AS nd FROM (SELECT DISTINCT index_code, trade_date FROM w)) d ON d.index_code = w.index_code AND d.trade_date = w.trade_date WHERE nd IS NOT NULL")
_agg("filled_weights", lambda ind, s, m: universe.filled_minute_weights(m(), limit=3, least=2.0, mean_of=2).select("index_code", "ts", "symbol", F.round("weight", 6).alias("weight")), """SELECT index_code, ts, symbol, CASE WHEN a >= 2 THEN round(a, 6) END AS weight FROM (
  SELECT *, CASE WHEN count(f) OVER w2 >= 2 THEN avg(f) OVER w2 END AS a FROM (SELECT *, last_value(weight IGNORE NULLS) OVER (PARTITION BY index_code, symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f FROM mw)
  WINDOW w2 AS (PARTITION BY index_code, symbol ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))""")

# Venues and other reducers of the weighted aggregators.
_VENUE = {"SH": "symbol[1] IN ('5', '6')", "SZ": "symbol[1] NOT IN ('5', '6')"}


def _scaled_sides(weights, reduce, b="bid", a="ask", source="weekly"):
    """Both sides times weights of mean 1 over the cells with a value, reduced."""
    rows = f"SELECT k.ts, index_code AS series, {b} AS bid, {a} AS ask, weight FROM {source} k JOIN ({weights}) u ON ts::DATE = trade_date AND k.symbol = u.symbol"
    parts = [f"{x} * weight * count({x}) OVER g / nullif(sum(weight) FILTER ({x} IS NOT NULL) OVER g, 0) AS {x}" for x in ("bid", "ask")]
    return f"SELECT ts, series, {reduce.format(x='bid')} AS bid, {reduce.format(x='ask')} AS ask FROM (SELECT ts, series, {', '.join(parts)} FROM ({rows}) WINDOW g AS (PARTITION BY ts, series)) GROUP BY 1, 2"


_IQR = "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"
_HHI_OF = "(sum({x} * {x}) / nullif(sum(abs({x})), 0) ^ 2)"
_SHARES = "(SELECT ts, symbol, bid / nullif(bid + ask, 0) AS bid, ask / nullif(bid + ask, 0) AS ask FROM weekly)"
_BOARD = "SELECT r.index_code, b.trade_date, b.symbol, b.weight FROM w b JOIN w r ON r.trade_date = b.trade_date AND r.symbol = b.symbol WHERE b.index_code = 'ALL' AND r.weight > 0"


def _minute_sides(where, reduce):
    rows = f"SELECT k.ts, index_code AS series, bid, ask, weight FROM weekly k JOIN mw m ON m.ts = k.ts AND m.symbol = k.symbol {where}"
    parts = [f"{x} * weight * count({x}) OVER g / nullif(sum(weight) FILTER ({x} IS NOT NULL) OVER g, 0) AS {x}" for x in ("bid", "ask")]
    return f"SELECT ts, series, {reduce.format(x='bid')} AS bid, {reduce.format(x='ask')} AS ask FROM (SELECT ts, series, {', '.join(parts)} FROM ({rows}) WINDOW g AS (PARTITION BY ts, series)) GROUP BY 1, 2"


def _in_range():
    return "WHERE EXISTS (SELECT 1 FROM w r WHERE r.index_code = m.index_code AND r.trade_date = k.ts::DATE AND r.symbol = k.symbol AND r.weight > 0)"


for _x, _c in _VENUE.items():
    _w, _l = f"SELECT * FROM w WHERE {_c}", _x.lower()
    _agg(f"wavg_imb_{_l}", lambda ind, s, _, x=_x: _rounded(aggregate.wavg_imb(ind, s, exchange=x)), _final(_weighted(_w, _WMEAN)))
    _agg(f"wavg_imb_depth1_{_l}", lambda ind, s, _, x=_x: _rounded(aggregate.wavg_imb(ind, s, depth=1, exchange=x)), _mean_depth(_weighted(_w, _WMEAN)))
    _agg(f"imb_wavg_{_l}", lambda ind, s, _, x=_x: _rounded(aggregate.imb_wavg(ind, s, exchange=x)), _final(_stock_mean(_w), "v"))
    _agg(f"imb_wavg_board_{_l}", lambda ind, s, _, x=_x: _rounded(aggregate.imb_wavg(ind, s, depth="all", exchange=x)), _final(_stock_mean(f"SELECT * FROM ({_RAW_ALL}) WHERE {_c}"), "v"))
    _agg(f"sum_imb_{_l}", lambda ind, s, _, x=_x: _rounded(aggregate.sum_imb(ind, s, exchange=x)), _final(_weighted(_RANGE[0].replace("FROM w", f"FROM w WHERE {_c}"), "coalesce(sum({x} * weight), 0)")))
    _agg(f"norm_wavg_imb_{_l}", lambda ind, s, _, x=_x: _rounded(aggregate.norm_wavg_imb(ind, s, exchange=x)), _final(f"SELECT ts, index_code AS series, {_WMEAN.format(x='bid')} AS bid, {_WMEAN.format(x='ask')} AS ask FROM {_SHARES} k JOIN (SELECT * FROM ({_BOARD}) WHERE {_c}) u ON ts::DATE = trade_date AND k.symbol = u.symbol GROUP BY 1, 2"))
    _agg(f"selfwavg_imb_{_l}", lambda ind, s, m, x=_x: _rounded(aggregate.selfwavg_imb(ind, s, m(), depth=0, exchange=x)), _final(_MINUTE.format(b=_WMEAN.format(x="bid"), a=_WMEAN.format(x="ask"), where=f"{_IN_RANGE} AND weekly.{_c}")))
    _agg(f"selfavg_imb_{_l}", lambda ind, s, m, x=_x: _rounded(aggregate.selfavg_imb(ind, s, m(), depth=0, exchange=x)), _final(_MINUTE.format(b="avg(bid)", a="avg(ask)", where=f"{_IN_RANGE} AND weight > 0 AND weekly.{_c}")))
_agg("wavg_imb_iqr", lambda ind, s, _: _rounded(aggregate.wavg_imb(ind, s, cs="cs_iqr")), _final(_scaled_sides("SELECT * FROM w", _IQR)))
_agg("wavg_imb_depth1_hhi", lambda ind, s, _: _rounded(aggregate.wavg_imb(ind, s, depth=1, cs="cs_hhi")), _mean_depth(_scaled_sides("SELECT * FROM w", _HHI_OF)))
_agg("imb_wavg_iqr", lambda ind, s, _: _rounded(aggregate.imb_wavg(ind, s, cs="cs_iqr")), _final(_scaled_sides("SELECT * FROM w", _IQR, "v", "v", _STOCK), "bid"))
_agg("imb_avg_hhi", lambda ind, s, _: _rounded(aggregate.imb_avg(ind, s, cs="cs_hhi")), _final(_scaled_sides("SELECT index_code, trade_date, symbol, 1.0::DOUBLE AS weight FROM w", _HHI_OF, "v", "v", _STOCK), "bid"))
_agg("sum_imb_mean", lambda ind, s, _: _rounded(aggregate.sum_imb(ind, s, cs="csmean")), _final(_weighted(_RANGE[0])))
_agg("norm_wavg_imb_hhi", lambda ind, s, _: _rounded(aggregate.norm_wavg_imb(ind, s, cs="cs_hhi")), _final(_scaled_sides(_BOARD, _HHI_OF, source=_SHARES)))
_agg("selfwavg_imb_hhi", lambda ind, s, m: _rounded(aggregate.selfwavg_imb(ind, s, m(), depth=0, cs="cs_hhi")), _final(_minute_sides(_in_range(), _HHI_OF)))
_agg("selfavg_imb_iqr", lambda ind, s, m: _rounded(aggregate.selfavg_imb(ind, s, m(), depth=0, cs="cs_iqr")), _final(_minute_sides(_in_range() + " AND m.weight > 0", _IQR).replace("bid, ask, weight FROM", "bid, ask, 1.0::DOUBLE AS weight FROM")))
_agg("imb_csf_above", lambda ind, s, _: _rounded(aggregate.imb_csf(ind, s, cs=("cs_above_threshold", {"threshold": 0.25}))), _final(_scaled_sides("SELECT * FROM w", "(count(*) FILTER ({x} > 0.25) / count(*))", "v", "v", _STOCK), "bid"))
