"""Order statistics of windows, and prefix scans, against plain loops and the windows they stand for."""

import datetime as dt
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapestream.functions import order, recursive, scan
from tapestream.functions.frames import timed
from tapestream.functions.rolling import TRANSFORMS

from .test_transforms import NOISY, START, WALK, close, frame, run


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.floats(-5, 5)), min_size=1, max_size=60), st.integers(1, 70), st.floats(0, 1))
def test_frames_like_numpy(values, window, q):
    x = np.array([np.nan if v is None else v for v in values], float)
    hi = np.arange(len(x)) + 1
    lo = np.maximum(0, hi - window)
    f = order.Frames(x, lo, hi)
    found, below, up_to = f.quantile(q), f.below(x), f.below(x, inclusive=True)
    for i in range(len(x)):
        held = x[lo[i] : hi[i]]
        held = held[~np.isnan(held)]
        assert f.count[i] == len(held) and f.size[i] == hi[i] - lo[i]
        assert np.isnan(found[i]) if not len(held) else found[i] == pytest.approx(np.quantile(held, q), abs=1e-12)
        assert (below[i], up_to[i]) == ((held < x[i]).sum(), (held <= x[i]).sum())


def test_long_windows_cost_no_more():
    rng = np.random.default_rng(3)
    x = rng.normal(size=60_000)
    took = {}
    for window in (240, 7200):
        hi = np.arange(len(x)) + 1
        began = time.perf_counter()
        order.Frames(x, np.maximum(0, hi - window), hi).quantile(0.05)
        took[window] = time.perf_counter() - began
    assert took[7200] < 2 * took[240] + 0.05


RANKED = [
    ("iqr", {"window": 9}), ("iqr", {"window": "11min"}), ("minmax", {"window": 14, "min_periods": 3}), ("minmax", {"window": "15min", "min_periods": 3}), ("minmaxSep", {"window": 12, "min_periods": 2}),
    ("rlPctl", {"window": 8}), ("aggPctl", {"window": "2h", "min_periods": 1}), ("rollingAggMinutePercentile", {"window": 4}), ("rollingMinuteQuantileScale", {"window": "3h"}),
    ("percentileTrendAcceleration", {"short_window": 3, "long_window": 10}), ("relativePercentileChange", {"short_window": 3, "long_window": 10}), ("minmax_scale_numba_parallel", {}),
]


@pytest.mark.parametrize("name,parameters", RANKED)
def test_chunks_change_no_rank(spark, monkeypatch, name, parameters):
    df = frame(spark, NOISY * 3).union(frame(spark, NOISY[::-1], series="b"))
    whole = run(df, name, **parameters)
    monkeypatch.setattr(order, "CHUNK", 16)
    monkeypatch.setattr(order, "SPAN", "20min")
    close(run(df, name, **parameters), whole)
    assert len(whole) == df.count()


def test_ranks_of_ties_and_odd_rows(spark):
    df = frame(spark, [2, 2, None, 1, 2, float("nan"), 0])
    close(run(df, "rlPctl", window=3), [None, 1, 0, 0, 1, 0, 0])
    close(run(df, "aggPctl", window="1h", interval=60), [1, 1, 0, 1 / 4, 4 / 5, 0, 1 / 7])
    close(run(df, "iqr", window=2), [0, 0, 0, 0, 0.5, 0, 0])
    nulls = df.union(df.select(F.lit(None).cast("string"), "ts", "value"))
    assert TRANSFORMS["minmax"](nulls, window=3, min_periods=1).count() == 14
    assert TRANSFORMS["iqr"](df.limit(0), window=3).collect() == []


def _gapped(spark):
    return frame(spark, NOISY * 4, dt.timedelta(hours=5)).union(frame(spark, [None, *NOISY], dt.timedelta(minutes=7), series="b")).union(frame(spark, [None, None], series=None)).repartition(5)


def test_scans_like_windows(spark):
    df = timed(_gapped(spark))
    w = "over (partition by series order by ts rows unbounded preceding)"
    expected = df.selectExpr("series", "ts", f"row_number() over (partition by series order by ts) as row", f"count(value) {w} as n", f"sum(value) {w} as s", f"last(value, true) {w} as f", f"case when value is not null then sum(value) {w} end as c")
    found = scan.running(df, {"row": F.lit(1).cast("long"), "n": F.col("value").isNotNull().cast("long"), "s": F.col("value")}, {"f": F.col("value")})
    found = scan.filled(scan.cumulative_sum(found, "value", "c"), "value", "g")
    a = {(r.series, r.ts): r for r in found.collect()}
    rows = expected.collect()
    assert len(rows) == len(a)
    for r in rows:
        own = a[r.series, r.ts]
        assert (own.row, own.n, own.f, own.g) == (r.row, r.n, r.f, r.f)
        close([own.s, own.c], [r.s, r.c])
    assert scan.placed(df.limit(0), "value").collect() == []


def test_scans_put_no_series_into_one_task(spark):
    """Only the table of buckets has a window over a series; the rows' windows are by bucket."""
    plan = scan.placed(timed(_gapped(spark)), "value")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "+- Window [" in line]
    assert len(windows) == 2 and sum("__at" in line.split("windowspecdefinition")[-1].split(",")[0] or "__at#" in line for line in windows) >= 1


@pytest.mark.parametrize("name,parameters", [("ewma", {"span": 5}), ("ema_func", {"window": 4}), ("kama_func", {"window": 5}), ("t3_func", {"window": 3}), ("macd_func", {"window": 8}), ("bbands_func", {"window": 9}), ("ma_func", {"window": 6}), ("pct_func", {"window": 3}), ("MACDEma_func", {"window": 12}), ("minmax", {"window": 14, "min_periods": 3}), ("slope", {"window": 5}), ("treg_func", {"window": 6}), ("termtrend_add", {"window": 24, "tfunc": "mom_func"})])
def test_placed_frames_give_the_same(spark, monkeypatch, name, parameters):
    df = frame(spark, [*WALK, None, *WALK[::-1]], dt.timedelta(hours=3)).union(frame(spark, NOISY, dt.timedelta(hours=3), series="b"))
    whole = run(df, name, **parameters)
    monkeypatch.setattr(order, "CHUNK", 16)
    monkeypatch.setattr(recursive.chunked, "__defaults__", (50,))
    placed = scan.placed(timed(df), "value").drop("us")
    out = TRANSFORMS[name](placed, **parameters)
    assert set(out.columns) == {*placed.columns, "out"}
    close([r.out for r in out.orderBy("series", "ts").collect()], whole, 1e-7)


@pytest.mark.parametrize("name,parameters", [("mean", {"window": 9}), ("std", {"window": 9}), ("mom_func", {"window": 4}), ("xMeanStd_func", {"window": 7}), ("slope", {"window": 5}), ("trendReversalRate", {"window": 6})])
def test_split_series_give_the_same(spark, name, parameters):
    df = frame(spark, NOISY * 3, dt.timedelta(hours=3)).union(frame(spark, NOISY, dt.timedelta(hours=3), series="b"))
    whole = run(df, name, **parameters)
    parts = scan.split(scan.placed(timed(df), "value"), 12, 20)
    assert parts.select("series").distinct().count() > 20
    out = scan.rejoined(TRANSFORMS[name](parts, **parameters))
    close([r.out for r in out.orderBy("series", "ts").collect()], whole)


def test_one_long_series_in_many_tasks(spark):
    """Half a million rows of one series by buckets: no task has more than a few of them."""
    rows = spark.range(500_000).select(F.lit("a").alias("series"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id"))).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    placed = scan.placed(timed(rows), "value")
    assert placed.agg(F.max("row"), F.max("value#n"), F.count_distinct("row")).first() == (500_000, 500_000, 500_000)
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 400_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), max_size=700), st.integers(1, 300))
def test_convolutions(values, m):
    weights = np.linspace(1, -0.5, m)
    expected = [sum(weights[j] * values[i - j] for j in range(min(m, i + 1))) for i in range(len(values))]
    assert np.allclose(recursive.convolved(np.array(values, float), weights), expected, atol=1e-8)


def test_fracdiff_of_long_windows(spark, monkeypatch):
    """Thousands of weights, in chunks, with gaps."""
    from tapestream.functions import technical

    rng = np.random.default_rng(5)
    values = [None if rng.random() < 0.1 else float(v) for v in 50 + np.cumsum(rng.normal(size=3000))]
    weights = np.array(technical.ffd_weights(0.3, 1e-5, 1500))
    held = np.array([v for v in values if v is not None])
    expected = iter([None] * 10 + [float(weights[: i + 1] @ held[max(0, i + 1 - len(weights)) : i + 1][::-1]) for i in range(10, len(held))])
    monkeypatch.setattr(recursive.chunked, "__defaults__", (100,))
    close(run(frame(spark, values), "fracdiff", d=0.3, lim=1500), [None if v is None else next(expected) for v in values])


@pytest.mark.parametrize("window", [16, "20min"])
def test_spectra_like_transforms_of_each_window(spark, monkeypatch, window):
    rng = np.random.default_rng(6)
    values = [*rng.normal(size=150), None, *rng.normal(size=70), *[0.0] * 40, *rng.normal(size=60)]
    df, n = frame(spark, values), 16 if window == 16 else 20
    monkeypatch.setattr(order, "CHUNK", 90)
    found = {name: run(df, name, window=window, cutoff_freq=cut) for name, cut in (("lowFreqEnergyRatio", 0.15), ("phaseTimesMagnitude", 0.5))}
    for i in range(len(values)):
        held = values[max(0, i + 1 - n) : i + 1]
        ratio_, phase = found["lowFreqEnergyRatio"][i], found["phaseTimesMagnitude"][i]
        if None in held:
            assert ratio_ is None and phase is None
            continue
        f, at = np.fft.fft(held), np.fft.fftfreq(len(held))
        energy = (np.abs(f) ** 2).sum()
        assert ratio_ is None if energy == 0 else ratio_ == pytest.approx((np.abs(f[np.abs(at) <= 0.15]) ** 2).sum() / energy, abs=1e-9)
        real = [f[0].real] + ([f[len(held) // 2].real] if len(held) % 2 == 0 else [])
        assert phase is None if len(held) < 2 else phase == pytest.approx(-np.pi * sum(min(r, 0) for r in real), abs=1e-8)
