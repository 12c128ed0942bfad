"""Exact quantiles, as-of joins and joins of streams, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapestream.functions.imbalance import IMBALANCE
from tapestream.operators import asof, quantiles
from tapestream.sources.versioned import FactorTable
from tapestream.streaming import incremental

T = dt.datetime(2024, 3, 1)
SHARES = [0, 0.013, 0.25, 0.5, 0.75, 0.999, 1]


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "two", "outliers", "constant"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "FETCHED", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    rng = np.random.default_rng(1)
    values = {
        "normal": rng.normal(size=4000), "heavy": rng.standard_cauchy(size=4000) ** 3, "ties": rng.integers(0, 5, 4000).astype(float), "two": np.where(rng.random(4000) < 0.6, 1.0, 2.0),
        "outliers": np.concatenate([rng.normal(size=3000), [1e300, -1e300, 1e-300]]), "constant": np.full(500, 3.5),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    assert quantiles.quantiles(df, "x", SHARES) == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles.quantiles(df, "x", [0.5, 1]) == [None, None]
    with pytest.raises(ValueError):
        quantiles.of_ranks(df, "x", [0])


def test_as_of(spark):
    rng = random.Random(2)
    times = [T + dt.timedelta(minutes=rng.randrange(0, 9000)) for _ in range(500)]
    left = [(i, rng.choice(["a", "b", None]), rng.choice([*times, None]), "x") for i in range(400)]
    right, seen = [], set()
    for t in times[:200]:
        k = rng.choice(["a", "b", None, "c"])
        if (k, t) not in seen:
            seen.add((k, t))
            right.append((k, t, rng.choice([rng.random(), None])))
    ls, rs = "id int, k string, ts timestamp_ntz, w string", "k string, ts timestamp_ntz, v double"
    for tolerance, limit in ((None, dt.timedelta.max), ("10h", dt.timedelta(hours=10))):
        expected = {}
        for i, k, t, _ in left:
            before = [] if t is None else [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
            last = max(before, key=lambda r: r[0], default=None)
            expected[i] = last if last and t - last[0] <= limit else (None, None)
        found = asof.as_of(spark.createDataFrame(left, ls).repartition(4), spark.createDataFrame(right, rs), ["k"], tolerance=tolerance)
        assert found.columns == ["id", "k", "ts", "w", "ts_known", "v"]
        rows = found.collect()
        assert len(rows) == len(left) and {r.id: (r.ts_known, r.v) for r in rows} == expected
    empty = spark.createDataFrame([], rs)
    assert [r.v for r in asof.as_of(spark.createDataFrame(left[:2], ls), empty, ["k"]).collect()] == [None, None]
    with pytest.raises(ValueError):
        asof.as_of(spark.createDataFrame(left, ls), spark.createDataFrame(right, rs).withColumn("w", F.lit(1)), ["k"])


def test_as_of_explodes_no_days(spark):
    left = spark.createDataFrame([(1, "a", T + dt.timedelta(days=3000))], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", T, 5.0)], "k string, ts timestamp_ntz, v double")
    found = asof.as_of(left, right, ["k"])
    assert [r.v for r in found.collect()] == [5.0]
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()


SIDE = "ts timestamp, symbol string, value double"


def test_two_streams_equal_the_batch_pair(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    bids = [(T + k * minute, s, float(k + 1)) for k in range(12) for s in ("x", "y") if (k, s) != (3, "y")]
    asks = [(T + k * minute, s, float(2 * k + 1)) for k in range(12) for s in ("x", "y") if (k, s) not in ((5, "x"), (7, "y"))]
    end = [(T + dt.timedelta(hours=5), "z", 1.0)]
    weights = spark.createDataFrame([("I", "x", T.date(), 1.0), ("I", "y", T.date(), 3.0)], "index_code string, symbol string, trade_date date, weight double")
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for cut in ((0, 9), (9, 99), None, None):
            for name, rows in (("bids", bids), ("asks", asks)):
                part = end if cut is None else rows[slice(*cut)]
                spark.createDataFrame(part, SIDE).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            pairs = incremental.both_sides(*(spark.readStream.schema(SIDE).parquet(str(tmp_path / n)) for n in ("bids", "asks")))
            incremental.write_trailing(pairs, str(tmp_path / "pairs"), target, incremental.weighted_pairs(lambda: weights), "1min", state).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    both = spark.createDataFrame(bids, SIDE).withColumnRenamed("value", "bid").join(spark.createDataFrame(asks, SIDE).withColumnRenamed("value", "ask"), ["ts", "symbol"], "full_outer")
    one = both.withColumn("v", IMBALANCE["imb01"](F.col("bid"), F.col("ask"))).join(weights, "symbol").groupBy("ts").agg((F.sum(F.col("v") * F.col("weight")) / F.sum(F.when(F.col("v").isNotNull(), F.col("weight")))).alias("value"))
    expected = {r.ts: r.value for r in one.collect()}
    found = {r.ts: r.value for r in FactorTable(spark, target).read().collect()}
    assert found.keys() == expected.keys() and all((found[k] is None) == (expected[k] is None) and (found[k] is None or found[k] == pytest.approx(expected[k])) for k in expected)
