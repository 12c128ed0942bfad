"""Transforms against pandas and plain loops on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestream.functions import recursive, technical
from tapestream.functions.frames import bars, calendar_micros, trading_seconds
from tapestream.functions.rolling import TRANSFORMS
from tapestream.functions.states import STATES

START = dt.datetime(2024, 1, 1)
SCHEMA = "series string, ts timestamp_ntz, value double"


def frame(spark, values, step=dt.timedelta(minutes=1), series="a"):
    return spark.createDataFrame([(series, START + i * step, None if v is None else float(v)) for i, v in enumerate(values)], SCHEMA)


def run(df, name, **parameters):
    return [r.out for r in TRANSFORMS[name](df, **parameters).orderBy("series", "ts").collect()]


def close(found, expected, tolerance=1e-9):
    expected = [None if e is None or e != e else e for e in expected]
    assert [f is None for f in found] == [e is None for e in expected]
    assert all(abs(f - e) <= tolerance * max(1, abs(e)) for f, e in zip(found, expected) if e is not None)


RNG = np.random.default_rng(7)
NOISY = [None if RNG.random() < 0.15 else float(v) for v in RNG.normal(size=120)]
WALK = (100 + np.cumsum(RNG.normal(size=200))).tolist()


def test_durations():
    assert calendar_micros("1d12h") == 36 * 3600 * 10**6 and calendar_micros("5min") == 300 * 10**6
    assert trading_seconds("1d") == 14400 and bars("1d", "5min") == 48
    for bad in ("", "5", "5x", "min"):
        with pytest.raises(ValueError):
            calendar_micros(bad)
    with pytest.raises(ValueError):
        bars("1min", "5min")


def test_known_moments(spark):
    df = frame(spark, [1, 5, 2, 8, 3, 9])
    assert run(df, "skew", window=5)[-1] == pytest.approx(0.16219348626914912)
    assert run(df, "kurt", window=5)[-1] == pytest.approx(-2.5008671522719403)
    flat = frame(spark, [2] * 6)
    assert run(flat, "skew", window=6)[-1] == 0 and run(flat, "kurt", window=6)[-1] == -3
    assert run(flat, "std", window=6)[-1] == 0 and run(flat, "zscore", period_str="1d")[-1] is None


@pytest.mark.parametrize("name,of", [("mean", "mean"), ("std", "std"), ("rmin", "min"), ("rmax", "max"), ("skew", "skew"), ("kurt", "kurt")])
def test_rolling_like_pandas(spark, name, of):
    s = pd.Series([np.nan if v is None else v for v in NOISY], index=pd.date_range(START, periods=len(NOISY), freq="min"))
    for window in (7, "9min"):
        close(run(frame(spark, NOISY), name, window=window), getattr(s.rolling(window, min_periods=1), of)())


def test_time_windows_exclude_their_lower_end(spark):
    df = frame(spark, [1, 1, 1], dt.timedelta(days=1))
    counts = [r.out for r in TRANSFORMS["intraSum"](df, window=5).collect()]
    assert counts == [1, 1, 1]
    assert run(df, "mean", window="1d") == [1, 1, 1]
    assert run(frame(spark, [1, 2, 4], dt.timedelta(days=1)), "mean", window="2d") == [1, 1.5, 3]


def test_slope_is_scaled_by_rows(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    expected = len(values) * np.polyfit(range(8), values, 1)[0]
    assert run(frame(spark, values), "slope", window=8)[-1] == pytest.approx(expected)
    assert run(frame(spark, [1, None, 3]), "slope", window=3) == [None, None, None]


def test_dod(spark):
    df = frame(spark, [10, 20, 30, 40], dt.timedelta(hours=12))
    assert run(df, "dod", n=1) == [None, None, 3, 2]
    assert run(frame(spark, [0, 5], dt.timedelta(days=1)), "dod", n=1) == [None, None]


def test_ewma_like_pandas(spark):
    s = pd.Series([np.nan if v is None else v for v in NOISY])
    close(run(frame(spark, NOISY), "ewma", span=5), s.ewm(span=5, adjust=True, ignore_na=False).mean())
    assert run(frame(spark, [1, None, 3]), "ewma", span=3)[-1] == pytest.approx(2.6)


def test_chunks_change_nothing(spark, monkeypatch):
    whole = run(frame(spark, NOISY * 20), "ewma", span=2)
    monkeypatch.setattr(recursive, "CHUNK", 50)
    df = frame(spark, NOISY * 20)
    parts = [r.out for r in recursive.chunked(df.withColumn("us", F.expr("unix_micros(cast(ts as timestamp))")), df["value"], "out", lambda v: STATES["ewma"](span=2).run(v), recursive.memory(2 / 3), 50).orderBy("ts").collect()]
    close(parts, whole)


def test_chunks_and_gaps(spark, monkeypatch):
    """A gap longer than the memory changes nothing; rows of one time and of no series stay."""
    values = [*NOISY, *[None] * 1500, *NOISY[::-1], *[None] * 90, *NOISY]
    kept = {}
    for size in (100_000, 7):
        monkeypatch.setattr(recursive, "memory", lambda alpha: 60)
        monkeypatch.setattr(recursive.chunked, "__defaults__", (size,))
        kept[size] = run(frame(spark, values), "ewma", span=2), run(frame(spark, values), "ema_func", window=4)
    for a, b in zip(*kept.values(), strict=True):
        close(a, b)
    assert kept[7][0][len(NOISY) + 1400] == kept[7][0][len(NOISY) - 1]
    some = frame(spark, [1.0, None, 3.0])
    twice = some.union(some).union(some.withColumn("series", F.lit(None).cast("string")))
    out = TRANSFORMS["ewma"](TRANSFORMS["ewma"](twice, x="value", out="a", span=3), x="a", out="b", span=3)
    assert out.count() == 9 and out.where("series is null and b is not null").count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_intraday(spark):
    df = frame(spark, [1, 2, None, 4, 5, 6], dt.timedelta(hours=8))
    assert run(df, "intraCumSum") == [1, 3, None, 4, 9, 15]
    assert run(df, "intraSma", window=2) == [1, 1.5, 2, 4, 4.5, 5.5]
    close(run(df, "intraEwma", span=3), [1, 5 / 3, 5 / 3, 4, 14 / 3, 38 / 7])
    at = frame(spark, [None, 5, 7, None], dt.timedelta(minutes=30)).withColumn("ts", F.expr("ts + interval 9 hours"))
    assert run(at, "OAD", reference_time="0930") == [None, 0, 2, 2]


def test_spectra(spark):
    values = np.sin(np.arange(40) / 3).tolist()
    found = run(frame(spark, values), "lowFreqEnergyRatio", window=16, cutoff_freq=0.1)
    f, at = np.fft.fft(values[-16:]), np.fft.fftfreq(16)
    assert found[-1] == pytest.approx((abs(f) ** 2)[abs(at) <= 0.1].sum() / (abs(f) ** 2).sum())
    assert run(frame(spark, [1, None, 2]), "lowFreqEnergyRatio", window=2, cutoff_freq=0.1) == [1, None, None]
    phases = run(frame(spark, values), "phaseTimesMagnitude", window=16, cutoff_freq=0.1)
    assert phases[0] is None and phases[-1] == pytest.approx((np.angle(f) * abs(f))[abs(at) <= 0.1].sum())
    assert recursive.freq_to_minutes(0.2) == "5min"
    with pytest.raises(ValueError):
        recursive.freq_to_minutes(0)


def loop_ema(v, n, alpha=None):
    alpha = alpha or 2 / (n + 1)
    out = [None] * (n - 1) + [np.mean(v[:n])]
    for x in v[n:]:
        out.append(out[-1] + alpha * (x - out[-1]))
    return out


def test_smoothers(spark):
    df = frame(spark, WALK)
    close(run(df, "ema_func", window=10)[10:], loop_ema(WALK, 10)[10:])
    once = loop_ema(WALK, 5)
    twice = loop_ema(once[4:], 5)
    close(run(df, "dema_func", window=5)[8:], [2 * a - b for a, b in zip(once[8:], twice[4:])])
    gain = loop_ema([max(b - a, 0) for a, b in zip(WALK, WALK[1:])], 7, 1 / 7)
    loss = loop_ema([max(a - b, 0) for a, b in zip(WALK, WALK[1:])], 7, 1 / 7)
    close(run(df, "rsi_func", window=7)[7:], [100 * g / (g + s) for g, s in zip(gain[6:], loss[6:])])
    close(run(df, "cmo_func", window=7)[7:], [100 * (g - s) / (g + s) for g, s in zip(gain[6:], loss[6:])])
    slow, fast = loop_ema(WALK, 12), [None] * 6 + loop_ema(WALK[6:], 6)
    line = [a - b for a, b in zip(fast[11:], slow[11:])]
    close(run(df, "macd_func", window=12), [None] * 19 + loop_ema(line, 9)[8:])
    kama = run(df, "kama_func", window=10)
    assert kama[:10] == [None] * 10 and all(min(WALK) <= v <= max(WALK) for v in kama[10:])
    flat = frame(spark, [5.0] * 80)
    for name, parameters in (("t3_func", {"window": 4}), ("kama_func", {"window": 4}), ("htTrendline_func", {"window": 1}), ("ema_func", {"window": 4})):
        assert run(flat, name, **parameters)[-1] == pytest.approx(5), name
    assert run(flat, "rsi_func", window=4)[-1] == 0
    trend = run(frame(spark, np.arange(150.0).tolist()), "htTrendline_func", window=1)
    assert trend[:63] == [None] * 63 and all(a < b for a, b in zip(trend[70:], trend[71:]))


def test_fracdiff(spark):
    w = technical.ffd_weights(0.5, 1e-2)
    values = [v for v in NOISY if v is not None]
    expected = iter([None if i < 10 else sum(w[k] * values[i - k] for k in range(min(len(w), i + 1))) for i in range(len(values))])
    close(run(frame(spark, NOISY), "fracdiff", d=0.5, thres=1e-2), [None if v is None else next(expected) for v in NOISY])
    assert technical.ffd_weights(1.0, 1e-5) == [1.0, -1.0]
    assert [v for v in run(frame(spark, NOISY), "fracdiff_rev", d=0.5, window=3) if v is not None]


def test_signals(spark):
    df = frame(spark, WALK)
    for name in ("MACDEma_func", "DoubleEma_func", "TripleEma_func", "MACDKama_func", "DoubleKama_func", "TripleKama_func"):
        assert set(run(df, name, window=24)) <= {None, 1.0, -1.0}
    with pytest.raises(ValueError):
        run(df, "termtrend_add", window=6, tfunc="slope_func")
    with pytest.raises(ValueError):
        run(df, "termtrend_revadd", window=100, tfunc="slope_func")


def test_power(spark):
    assert run(frame(spark, [0.25, 1.5, None]), "power", gamma=0.5) == [0.5, None, None]
    with pytest.raises(ValueError):
        run(frame(spark, [0.5]), "power", gamma=0)
    with pytest.raises(ValueError):
        run(frame(spark, [0.5]), "power", gamma=1, direction="up")


def test_interaction_is_always_null(spark):
    assert run(frame(spark, WALK[:20]), "shortLongTrendInteraction", short_window=2, long_window=5) == [None] * 20
