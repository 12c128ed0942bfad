"""Queries of technical transforms over the hourly price-like series, and of those that carry a state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import technical
from ..functions.rolling import TRANSFORMS
from . import panels as p

QUERIES = {}
ORACLE_SQL = {}


def prices(spark, sf_dir):
    """Mean event value per hour and type, the last known one carried on: a dense positive series."""
    events = p.table(spark, sf_dir, "events")
    known = events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("series")).agg(F.avg(F.col("value").cast("double") * p.RATE).alias("v"), F.count("*").cast("double").alias("n"))
    grid = known.select("ts").distinct().crossJoin(F.broadcast(known.select("series").distinct()))  # five types
    so_far = Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(known, ["ts", "series"], "left")
    return rows.select("series", "ts", F.last("v", ignorenulls=True).over(so_far).alias("value"), F.last("n", ignorenulls=True).over(so_far).alias("other")).where("value is not null")


PRICES = f"""known AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type AS series, avg(value::DOUBLE * {p.RATE}::DOUBLE) AS v, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2
), grid AS (
  SELECT g.ts, g.series, v, n FROM (SELECT * FROM (SELECT DISTINCT ts FROM known), (SELECT DISTINCT series FROM known)) g LEFT JOIN known k ON k.ts = g.ts AND k.series = g.series
), s AS (
  SELECT * FROM (SELECT series, ts, last_value(v IGNORE NULLS) OVER o AS x, last_value(n IGNORE NULLS) OVER o AS y FROM grid WINDOW o AS (PARTITION BY series ORDER BY ts)) WHERE x IS NOT NULL)"""


def _query(transform, parameters):
    x = "other" if transform == "regression_beta" else "value"
    return lambda spark, sf_dir: TRANSFORMS[transform](prices(spark, sf_dir), x=x, out="out", **parameters).select("series", "ts", (F.round("out", 6) + 0.0).alias("value"))


def _rows(n, end="CURRENT ROW"):
    return f"(PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND {end})"


_O = "(PARTITION BY series ORDER BY ts)"
_R = f"(SELECT *, row_number() OVER {_O} - 1 AS i FROM s)"
_SLOPE = "regr_slope(x, i::DOUBLE) OVER w"


def _add(name, parameters, sql=None, source=_R, windows=None, ctes="", transform=None):
    QUERIES[f"ta_{name}"] = _query(transform or name, parameters)
    if sql:
        named = " WINDOW " + ", ".join(f"{k} AS {v}" for k, v in windows.items()) if windows else ""
        ORACLE_SQL[f"ta_{name}"] = f"WITH {PRICES}{ctes} SELECT series, ts, round(({sql})::DOUBLE, 6) + 0.0 AS value FROM {source}{named}"


_W = {"w": _rows(10)}


def _whole(sql):
    return f"CASE WHEN count(x) OVER w >= 10 THEN {sql} END"


_n = {"window": 10}
_add("treg_func", _n, _whole(f"avg(x) OVER w + {_SLOPE} * 4.5"), windows=_W)
_add("regag_func", _n, _whole(f"degrees(atan({_SLOPE}))"), windows=_W)
_add("itc_func", _n, _whole(f"avg(x) OVER w - {_SLOPE} * 4.5"), windows=_W)
_add("slope_func", _n, _whole(_SLOPE), windows=_W)
_add("tsf_func", _n, _whole(f"avg(x) OVER w + {_SLOPE} * 5.5"), windows=_W)
_add("std_func", _n, _whole("stddev_pop(x) OVER w"), windows=_W)
_add("var_func", _n, _whole("var_pop(x) OVER w"), windows=_W)
_add("mean_std_func", _n, "avg(x) OVER w / nullif(stddev_samp(x) OVER w, 0)", windows=_W)
_add("xMeanStd_func", _n, "(x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0)", windows=_W)
_add("skew_func", _n, "CASE WHEN count(x) OVER w >= 3 THEN CASE WHEN min(x) OVER w = max(x) OVER w THEN 0 ELSE skewness(x) OVER w END END", windows=_W)
_add("kurt_func", _n, "CASE WHEN count(x) OVER w >= 4 THEN CASE WHEN min(x) OVER w = max(x) OVER w THEN -3 ELSE kurtosis(x) OVER w END END", windows=_W)
_add("apo_func", _n, _whole("avg(x) OVER h - avg(x) OVER w"), windows=_W | {"h": _rows(5)})
_add("entropy_func", _n, _whole("ln(sum(x) OVER w) - sum(x * ln(x)) OVER w / sum(x) OVER w"), windows=_W)
_add("mom_func", _n, f"x - lag(x, 10) OVER {_O}")
_add("diff_func", _n, f"x - lag(x, 10) OVER {_O}")
_add("rocp_func", _n, f"(x - lag(x, 10) OVER {_O}) / nullif(lag(x, 10) OVER {_O}, 0)")
_add("DoubleDiff_func", _n, f"x - 2 * lag(x, 10) OVER {_O} + lag(x, 20) OVER {_O}")
_add("pct_func", _n, f"last_value(q IGNORE NULLS) OVER {_O}", f"(SELECT *, (x - lag(x, 10) OVER {_O}) / nullif(abs(lag(x, 10) OVER {_O}), 0) AS q FROM s)")
_add("beta_func", {"rtn": "other", "window": 10}, "CASE WHEN count(rx) OVER w >= 10 THEN covar_pop(ry, rx) OVER w / nullif(var_pop(rx) OVER w, 0) END", f"(SELECT *, x / nullif(lag(x) OVER {_O}, 0) - 1 AS rx, y / nullif(lag(y) OVER {_O}, 0) - 1 AS ry FROM s)", _W)
_add("regression_beta", {"factor": "value", "window": 30}, "regr_slope(y, x) OVER w", windows={"w": "(PARTITION BY series ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"})


def _ma(n):
    return f"CASE WHEN i = 0 THEN x WHEN i < {n} THEN (sum(x) OVER {_O} - first_value(x) OVER {_O}) / i ELSE avg(x) OVER {_rows(n)} END"


_add("ma_func", _n, _ma(10))
_HELD = f"last_value(c IGNORE NULLS) OVER {_O}"
_MAS = f", m AS (SELECT *, round({_ma(6)}, 9) AS m6, round({_ma(12)}, 9) AS m12, round({_ma(24)}, 9) AS m24 FROM {_R}), l AS (SELECT *, lag(m6) OVER {_O} AS l6, lag(m12) OVER {_O} AS l12, lag(m24) OVER {_O} AS l24 FROM m)"
_add("MACDMa_func", {"window": 24}, _HELD, f"(SELECT *, CASE WHEN m12 < m24 AND l12 >= l24 THEN -1 WHEN m12 > m24 AND l12 <= l24 THEN 1 END AS c FROM l)", ctes=_MAS)
_add("TripleMa_func", {"window": 24}, _HELD, "(SELECT *, CASE WHEN m6 < m24 AND m12 < m24 AND l6 >= l24 AND l12 >= l24 THEN -1 WHEN m6 > m24 AND m12 > m24 AND l6 <= l24 AND l12 <= l24 THEN 1 END AS c FROM l)", ctes=_MAS)
_BANDS = f""", b AS (SELECT *, CASE WHEN i < 10 THEN (sum(x) OVER {_O} - first_value(x) OVER {_O}) / nullif(i, 0) ELSE avg(x) OVER {_rows(10)} END AS m0,
  CASE WHEN i < 10 THEN sqrt(greatest(0, (sum(x * x) OVER {_O} - first_value(x * x) OVER {_O}) / nullif(i, 0) - ((sum(x) OVER {_O} - first_value(x) OVER {_O}) / nullif(i, 0)) ^ 2)) ELSE stddev_pop(x) OVER {_rows(10)} END AS d0 FROM {_R}
), e AS (SELECT *, CASE WHEN i >= 2 THEN m0 END AS m, CASE WHEN i >= 2 THEN d0 END AS d FROM b
), f AS (SELECT *, CASE WHEN x <= m - 2 * d THEN -1 WHEN x >= m + 2 * d THEN 1 END AS g FROM e
), h AS (SELECT *, last_value(g IGNORE NULLS) OVER {_O} AS st FROM f
), j AS (SELECT *, CASE WHEN g IS NOT NULL THEN g WHEN (st = 1 AND x <= m) OR (st = -1 AND x >= m) THEN 0 END AS q FROM h
), r AS (SELECT *, CASE WHEN (q = 1 AND x < 0) OR (q = -1 AND x > 0) THEN 0 ELSE q END AS c FROM j)"""
_add("bbands_func", _n, _HELD, "r", ctes=_BANDS)
_FFD = technical.ffd_weights(0.4, 1e-3)


def _ffd(shift):
    w = _FFD[shift:]
    return f"CASE WHEN i >= 10 THEN list_dot_product(list_reverse(list(x) OVER {_rows(len(w))}), ({w}::DOUBLE[])[1:least(i + 1, {len(w)})]) END"


_add("fracdiff", {"d": 0.4, "thres": 1e-3}, _ffd(0))
_add("fracdiff_shift", {"d": 0.4, "thres": 1e-3, "shift": 1}, _ffd(1), transform="fracdiff")
_add("termtrend_add", {"window": 48, "tfunc": "slope_func"}, f"(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0)", "t", ctes=(_T := f", t AS (SELECT *, CASE WHEN count(x) OVER w1 >= 48 THEN regr_slope(x, i::DOUBLE) OVER w1 END AS a, CASE WHEN count(x) OVER w2 >= 24 THEN regr_slope(x, i::DOUBLE) OVER w2 END AS b, CASE WHEN count(x) OVER w3 >= 12 THEN regr_slope(x, i::DOUBLE) OVER w3 END AS c FROM {_R} WINDOW w1 AS {_rows(48)}, w2 AS {_rows(24)}, w3 AS {_rows(12)})"))
_add("termtrend_winr", {"window": 48, "tfunc": "slope_func"}, "(coalesce(sign(a), 0) + coalesce(sign(b), 0) + coalesce(sign(c), 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0)", "t", ctes=_T)
_UP = " + ".join(f"greatest(coalesce({c}, 0), 0)" for c in "abc")
_DOWN = " + ".join(f"greatest(-coalesce({c}, 0), 0)" for c in "abc")
_add("termtrend_plr", {"window": 48, "tfunc": "slope_func"}, f"(({_UP}) - ({_DOWN})) / nullif(({_UP}) + ({_DOWN}), 0)", "t", ctes=_T)

_ALL = technical.ffd_weights(0.4)


def _ffd_all(shift):
    w = _ALL[shift:]
    return f"CASE WHEN i >= 10 THEN list_dot_product(list_reverse(list(x) OVER {_rows(len(w))}), ({w}::DOUBLE[])[1:least(i + 1, {len(w)})]) END AS f{shift}"


_FS = f", f AS (SELECT *, {_ffd_all(0)}, {_ffd_all(1)}, {_ffd_all(10)} FROM {_R})"
_MEAN5 = "CASE WHEN count({0}) OVER w >= 5 THEN avg({0}) OVER w END"
_add("fracdiff_ma", {"d": 0.4, "window": 5}, _MEAN5.format("f0"), "f", {"w": _rows(5)}, _FS)
_add("fracdiff_rev", {"d": 0.4, "window": 5}, "-" + f"({_MEAN5.format('f1')})", "f", {"w": _rows(5)}, _FS)
_add("fracdiff_marev", {"d": 0.4, "window": 5}, f"({_MEAN5.format('f0')}) - 2 * f1 + f10", "f", {"w": _rows(5)}, _FS)


def _ewm(span):
    """Of a list ``a`` of the values so far, none of them null."""
    keep = 1 - 2 / (span + 1)
    return f"list_sum(list_transform(range(1, len(a) + 1), lambda k: a[k] * pow({keep!r}::DOUBLE, len(a) - k))) / list_sum(list_transform(range(0, len(a)), lambda k: pow({keep!r}::DOUBLE, k)))"


_add("ewma", {"span": 8}, _ewm(8), f"(SELECT *, list(x) OVER {_O} AS a FROM s)")
_add("intraEwma", {"span": 4}, _ewm(4), "(SELECT *, list(x) OVER (PARTITION BY series, ts::DATE ORDER BY ts) AS a FROM s)")

# States: recursive CTEs over the row number, one step at a time.
_STEPS = f"r AS MATERIALIZED (SELECT * FROM {_R})"


def _smoothed(name, source, value, n, first, alpha=None):
    """CTEs: exponential smoothing ``h`` of a column from its row ``first`` on, which starts with the mean of ``n`` values."""
    return f"""{name}_m AS MATERIALIZED (SELECT series, i, {value} AS v, avg({value}) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM {source}
), {name} AS MATERIALIZED (WITH RECURSIVE z AS (
  SELECT series, i, m AS h FROM {name}_m WHERE i = {first + n - 1}
  UNION ALL SELECT q.series, q.i, z.h + {alpha or 2 / (n + 1)!r}::DOUBLE * (q.v - z.h) FROM z JOIN {name}_m q ON q.series = z.series AND q.i = z.i + 1
) SELECT * FROM z)"""


def _ema(n):
    """CTEs: ``h`` of every row, the first ones smoothed with the rows there are."""
    early = f"(sum(x) OVER {_O} - x) / i"
    return _smoothed(f"ema{n}_s", "r", "x", n, 0) + f", ema{n} AS MATERIALIZED (SELECT series, ts, i, x, CASE WHEN i = 0 THEN x WHEN i < {n} THEN {early} + 2.0::DOUBLE / (i + 1) * (x - {early}) ELSE h END AS h FROM r LEFT JOIN ema{n}_s USING (series, i))"


def _kama(n):
    path = f"sum(abs(x - b)) OVER {_rows(n)}"
    return f"""kama{n}_e AS MATERIALIZED (SELECT *, CASE WHEN p > 0 THEN least(abs(x - l) / p, 1) ELSE 1 END AS e FROM (SELECT *, {path} AS p, lag(x, {n}) OVER {_O} AS l FROM (SELECT *, lag(x) OVER {_O} AS b FROM r))
), kama{n} AS MATERIALIZED (SELECT r.series, r.ts, r.i, r.x, CASE WHEN r.i >= {n} THEN z.h END AS h FROM r LEFT JOIN (WITH RECURSIVE z AS (
  SELECT series, i, x AS h FROM r WHERE i = {n - 1}
  UNION ALL SELECT q.series, q.i, z.h + pow(e * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) * (q.x - z.h) FROM z JOIN kama{n}_e q ON q.series = z.series AND q.i = z.i + 1
) SELECT * FROM z) z ON z.series = r.series AND z.i = r.i)"""


def _wilder(n):
    steps = f"w_d AS MATERIALIZED (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM (SELECT *, x - lag(x) OVER {_O} AS d FROM r))"
    up, down = _smoothed("w_u", "w_d", "up", n, 1, 1 / n), _smoothed("w_l", "w_d", "dn", n, 1, 1 / n)
    return f"{steps}, {up}, {down}, wilder AS MATERIALIZED (SELECT r.series, r.ts, r.i, u.h AS up, d.h AS dn FROM r LEFT JOIN w_u u ON u.series = r.series AND u.i = r.i LEFT JOIN w_l d ON d.series = r.series AND d.i = r.i)"


def _state(name, parameters, sql, source, *ctes):
    _add(name, parameters, sql, source, ctes=", " + ", ".join((_STEPS, *ctes)))


_state("ema_func", _n, "h", "ema10", _ema(10))
_state("dema_func", _n, "2 * a.h - b.h", "r LEFT JOIN d1 a USING (series, i) LEFT JOIN d2 b USING (series, i)", _smoothed("d1", "r", "x", 10, 0), _smoothed("d2", "d1", "h", 10, 9))
_state(
    "t3_func", {"window": 4}, "-0.343::DOUBLE * e6.h + 2.499::DOUBLE * e5.h - 6.069::DOUBLE * e4.h + 4.913::DOUBLE * e3.h",
    "r " + " ".join(f"LEFT JOIN e{k} USING (series, i)" for k in (3, 4, 5, 6)), *(_smoothed(f"e{k}", f"e{k - 1}" if k > 1 else "r", "h" if k > 1 else "x", 4, 3 * (k - 1)) for k in range(1, 7)),
)
_state("kama_func", _n, "h", "kama10", _kama(10))
_state("rsi_func", _n, "CASE WHEN up + dn > 0 THEN 100 * up / (up + dn) WHEN up IS NOT NULL THEN 0 END", "wilder", _wilder(10))
_state("cmo_func", _n, "CASE WHEN up + dn > 0 THEN 100 * (up - dn) / (up + dn) WHEN up IS NOT NULL THEN 0 END", "wilder", _wilder(10))
_state("macd_func", {"window": 12}, "h", "r LEFT JOIN mg USING (series, i)", _smoothed("m1", "r", "x", 12, 0), _smoothed("m2", "r", "x", 6, 6), "md AS MATERIALIZED (SELECT m1.series, m1.i, m2.h - m1.h AS d FROM m1 JOIN m2 USING (series, i))", _smoothed("mg", "md", "d", 9, 11))


def _hilbert(of, rate):
    return f"(0.0962::DOUBLE * {of}[1] + 0.5769::DOUBLE * {of}[3] - 0.5769::DOUBLE * {of}[5] - 0.0962::DOUBLE * {of}[7]) * {rate}"


# Lists hold the seven newest values, newest first; all are zero before row 9.
_ZEROS = "[0.0, 0, 0, 0, 0, 0, 0]::DOUBLE[]"
_state(
    "htTrendline_func", _n, "CASE WHEN i >= 63 THEN (4 * t + 3 * lag(t) OVER o + 2 * lag(t, 2) OVER o + lag(t, 3) OVER o) / 10 END", "(SELECT r.*, t FROM r LEFT JOIN ht z USING (series, i)) WINDOW o AS (PARTITION BY series ORDER BY i)",
    f"""sm AS MATERIALIZED (SELECT *, list(sm) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s7, list(x) OVER {_rows(50)} AS x50 FROM (
  SELECT *, CASE WHEN i >= 3 THEN (4 * x + 3 * lag(x) OVER {_O} + 2 * lag(x, 2) OVER {_O} + lag(x, 3) OVER {_O}) / 10 ELSE x END AS sm FROM r)
), ht AS MATERIALIZED (WITH RECURSIVE z AS (
  SELECT series, i, {_ZEROS} AS d, {_ZEROS} AS q, {_ZEROS} AS n, 0.0::DOUBLE AS i2, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS re, 0.0::DOUBLE AS im, 0.0::DOUBLE AS p, 0.0::DOUBLE AS t FROM r WHERE i = 8
  UNION ALL SELECT series, i, d, q, n, i2, q2, re, im, p, list_avg(x50[greatest(1, len(x50) - greatest(1, floor(p + 0.5)::INT) + 1):]) AS t FROM (
    SELECT *, 0.2 * least(greatest(f, 6.0), 50.0) + 0.8 * p0 AS p FROM (
      SELECT *, CASE WHEN p0 <> 0 THEN least(greatest(g, 0.67 * p0), 1.5 * p0) ELSE g END AS f FROM (
        SELECT *, CASE WHEN im <> 0 AND re <> 0 THEN 2 * pi() / atan(im / re) ELSE p0 END AS g FROM (
          SELECT *, 0.2 * (i2 * j2 + q2 * k2) + 0.8 * re0 AS re, 0.2 * (i2 * k2 - q2 * j2) + 0.8 * im0 AS im FROM (
            SELECT *, 0.2 * (n[1] - {_hilbert('q', 'rate')}) + 0.8 * j2 AS i2, 0.2 * (q[1] + {_hilbert('n', 'rate')}) + 0.8 * k2 AS q2 FROM (
              SELECT *, list_prepend({_hilbert('d', 'rate')}, q0[1:6]) AS q, list_prepend(d[4], n0[1:6]) AS n FROM (
                SELECT *, list_prepend({_hilbert('s', 'rate')}, d0[1:6]) AS d FROM (
                  SELECT m.series, m.i, m.x50, list_reverse(m.s7) AS s, z.d AS d0, z.q AS q0, z.n AS n0, z.i2 AS j2, z.q2 AS k2, z.re AS re0, z.im AS im0, z.p AS p0, 0.075 * z.p + 0.54 AS rate
                  FROM z JOIN sm m ON m.series = z.series AND m.i = z.i + 1
                ))))))))
) SELECT * FROM z)""",
)

# Signals of two or three averages.
def _signals(*averages):
    """m<n> and l<n>: rounded averages of a row and of the row before; rs: strength."""
    names = [f"m{n}" for n, _ in averages]
    joined = " ".join(f"JOIN {of} AS m{n}_ USING (series, i)" for n, of in averages)
    return f"sg AS MATERIALIZED (SELECT r.series, r.ts, r.i, {', '.join(f'round(m{n}_.h, 9) AS m{n}' for n, _ in averages)} FROM r {joined}), sl AS (SELECT *, {', '.join(f'lag({m}) OVER {_O} AS l{m[1:]}' for m in names)} FROM sg)"


_MACD = "(SELECT *, CASE WHEN m12 < m24 AND l12 >= l24 THEN -1 WHEN m12 > m24 AND l12 <= l24 THEN 1 END AS c FROM sl)"
_DOUBLE = "(SELECT sl.*, CASE WHEN m12 < m24 AND l12 >= l24 AND rs > 30 THEN -1 WHEN m12 > m24 AND l12 <= l24 AND rs < 70 THEN 1 END AS c FROM sl JOIN (SELECT series, i, CASE WHEN up + dn > 0 THEN 100 * up / (up + dn) WHEN up IS NOT NULL THEN 0 END AS rs FROM wilder) USING (series, i))"
_TRIPLE = "(SELECT *, CASE WHEN m6 < m24 AND m12 < m24 AND l6 >= l24 AND l12 >= l24 THEN -1 WHEN m6 > m24 AND m12 > m24 AND l6 <= l24 AND l12 <= l24 THEN 1 END AS c FROM sl)"
_state("DoubleMa_func", {"window": 24}, _HELD, _DOUBLE, *(f"ma{n} AS MATERIALIZED (SELECT *, {_ma(n)} AS h FROM r)" for n in (12, 24)), _signals((12, "ma12"), (24, "ma24")), _wilder(24))
for _kind, _cte in (("Ema", _ema), ("Kama", _kama)):
    _k = _kind.lower()
    _state(f"MACD{_kind}_func", {"window": 24}, _HELD, _MACD, _cte(12), _cte(24), _signals((12, f"{_k}12"), (24, f"{_k}24")))
    _state(f"Double{_kind}_func", {"window": 24}, _HELD, _DOUBLE, _cte(12), _cte(24), _signals((12, f"{_k}12"), (24, f"{_k}24")), _wilder(24))
    _state(f"Triple{_kind}_func", {"window": 24}, _HELD, _TRIPLE, _cte(6), _cte(12), _cte(24), _signals((6, f"{_k}6"), (12, f"{_k}12"), (24, f"{_k}24")))

# Families against their history.
_NOW, _THEN = (48, 24, 12), (624, 312, 156, 78)
_FAMILIES = f", xh AS (SELECT *, lag(x, 48) OVER {_O} AS h FROM {_R}), fm AS (SELECT series, ts, " + ", ".join(f"CASE WHEN count({v}) OVER w{n} >= {n} THEN regr_slope({v}, i::DOUBLE) OVER w{n} END AS {v}{n}" for v, ns in (("x", _NOW), ("h", _THEN)) for n in ns) + " FROM xh WINDOW " + ", ".join(f"w{n} AS {_rows(n)}" for n in _NOW + _THEN) + ")"


def _combined(columns, of="{c}"):
    total = " + ".join(f"coalesce({of.format(c=c)}, 0)" for c in columns)
    return f"({total}) / nullif({' + '.join(f'({c} IS NOT NULL)::INT' for c in columns)}, 0)"


def _balanced(columns):
    up, down = (" + ".join(f"greatest(coalesce({sign}{c}, 0), 0)" for c in columns) for sign in ("", "-"))
    return f"(({up}) - ({down})) / nullif(({up}) + ({down}), 0)"


for _kind, _of in (("add", _combined), ("winr", lambda columns: _combined(columns, "sign({c})")), ("plr", _balanced)):
    _now, _then = _of([f"x{n}" for n in _NOW]), _of([f"h{n}" for n in _THEN])
    _add(f"termtrend_rev{_kind}", {"window": 48, "tfunc": "slope_func", "bars_a_day": 24}, "(a - b) / nullif(abs(a) + abs(b), 0)", f"(SELECT *, {_now} AS a, {_then} AS b FROM fm)", ctes=_FAMILIES)

# Spectra of the frame's list, term by term.
_SPECTRUM = f", l AS (SELECT *, list(x) OVER {_rows(16)} AS a, row_number() OVER {_O}::DOUBLE AS rn FROM s)"


def _over_low(cutoff, of):
    """Sum over the frequencies up to the cutoff of an expression in re and im."""
    part = "list_sum(list_transform(range(0, len(a)), lambda j: a[j + 1] * {f}(2 * pi() * ((j * k) % len(a)) / len(a))))"
    return f"list_sum(list_transform(list_filter(range(0, len(a)), lambda k: least(k, len(a) - k) / len(a) <= {cutoff}), lambda k: {of.format(re=part.format(f='cos'), im='-' + part.format(f='sin'))}))"


def _energy(cutoff):
    return f"{_over_low(cutoff, 'pow({re}, 2) + pow({im}, 2)')} / nullif(len(a) * list_sum(list_transform(a, lambda v: v * v)), 0)"


_add("lowFreqEnergyRatio", {"window": 16, "cutoff_freq": 0.1}, _energy(0.1), "l", ctes=_SPECTRUM)
_add("phaseTimesMagnitude", {"window": 16, "cutoff_freq": 0.1}, "CASE WHEN len(a) >= 2 THEN " + _over_low(0.1, "CASE WHEN (k = 0 OR 2 * k = len(a)) AND {re} < 0 THEN -pi() * {re} ELSE 0 END") + " END", "l", ctes=_SPECTRUM)
_LATE = ", e AS (SELECT *, " + _energy(0.002) + " AS er, CASE WHEN count(x) OVER w = count(*) OVER w AND count(*) OVER w >= 2 THEN regr_slope(x, rn) OVER w * count(*) OVER w END AS sl FROM l WINDOW w AS (PARTITION BY series ORDER BY ts RANGE BETWEEN to_microseconds(29999999999) PRECEDING AND CURRENT ROW))"
_add("lowFreqEnergyRatio_x_slope", {"window": 16, "cutoff_freq": 0.002}, "er * sl", "e", ctes=_SPECTRUM + _LATE)
_add("lowFreqEnergyRatio_x_slpsign", {"window": 16, "cutoff_freq": 0.002}, "er * sign(sl)", "e", ctes=_SPECTRUM + _LATE)
_POSITION = ", p AS (SELECT *, list(x) OVER (PARTITION BY series ORDER BY ts RANGE BETWEEN to_microseconds(259199999999) PRECEDING AND CURRENT ROW) AS b FROM l)"
_add("lowFreqWithPosTrend", {"fft_window": 16, "pos_window": "3d", "freq_cutoff": 0.1}, "CASE WHEN len(a) >= 2 AND len(b) >= 2 THEN " + _over_low(0.1, "sqrt(pow({re}, 2) + pow({im}, 2))") + " * CASE WHEN len(list_filter(b, lambda v: v < x)) / len(b) > 0.5 THEN 1 ELSE -1 END END", "p", ctes=_SPECTRUM + _POSITION)
