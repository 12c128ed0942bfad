"""States over increments and the versioned table, against the whole at once."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapestream.functions import states
from tapestream.functions.rolling import TRANSFORMS
from tapestream.sources import versioned
from tapestream.sources.versioned import Conflict, FactorTable
from tapestream.streaming import stateful

from .test_transforms import NOISY, START, WALK, close, frame

SPECS = {
    "e": ("ewma", {"span": 6}), "i": ("intraEwma", {"span": 5}), "c": ("intraCumSum", {}), "a": ("ema_func", {"window": 5}), "d": ("dema_func", {"window": 4}), "t": ("t3_func", {"window": 3}),
    "k": ("kama_func", {"window": 5}), "r": ("rsi_func", {"window": 6}), "o": ("cmo_func", {"window": 6}), "m": ("macd_func", {"window": 8}), "h": ("htTrendline_func", {"window": 1}),
}


def scalar_ema(v, n, alpha):
    out, held = [], None
    for i in range(len(v)):
        if i == n - 1:
            held = sum(v[:n]) / n
        elif i >= n:
            held += alpha * (v[i] - held)
        out.append(held)
    return out


def scalar_ewm(v, alpha):
    out, total, weight, held = [], 0.0, 0.0, None
    for x in v:
        total, weight = total * (1 - alpha), weight * (1 - alpha)
        if x is not None:
            total, weight = total + x, weight + 1
            held = total / weight
        out.append(held)
    return out


def scalar_kama(v, n):
    out, held = [None] * n, v[n - 1]
    for i in range(n, len(v)):
        path = sum(abs(v[j] - v[j - 1]) for j in range(i - n + 1, i + 1))
        rate = ((min(abs(v[i] - v[i - n]) / path, 1) if path else 1) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        held += rate * (v[i] - held)
        out.append(held)
    return out


def test_states_like_scalar_loops():
    def of(name, v, **parameters):
        return [None if x != x else x for x in states.STATES[name](**parameters).run(np.array([np.nan if x is None else x for x in v], float))]

    close(of("ewma", NOISY, span=6), scalar_ewm(NOISY, 2 / 7))
    close(of("kama_func", WALK, window=7), scalar_kama(WALK, 7))
    close(of("kama_func", [1.0] * 40, window=7), scalar_kama([1.0] * 40, 7))
    once = scalar_ema(WALK, 5, 1 / 3)
    twice = [None] * 4 + scalar_ema(once[4:], 5, 1 / 3)
    close(of("dema_func", WALK, window=5), [None if b is None else 2 * a - b for a, b in zip(once, twice)])
    warm = [WALK[0]] + [sum(WALK[:i]) / i + 2 / (i + 1) * (WALK[i] - sum(WALK[:i]) / i) for i in range(1, 5)] + once[5:]
    close(of("ema_func", WALK, window=5), warm)
    close(of("ewma", WALK, span=1), WALK)


def test_recursions_are_exact_over_blocks():
    rng = np.random.default_rng(4)
    inputs = rng.normal(size=20_000)
    for rates in (0.0, 0.3, 0.999, 1.0, rng.uniform(0, 1, 20_000), np.where(rng.random(20_000) < 0.1, 0.0, 0.5)):
        held, expected = 2.0, []
        for r, b in zip(np.broadcast_to(rates, 20_000).tolist(), inputs.tolist()):
            held = r * held + b
            expected.append(held)
        assert np.allclose(states.recursion(rates, inputs, 2.0), expected, rtol=1e-9, atol=1e-9)


def pieces(spark, cuts):
    """A series of bars over three days in pieces, and another one that has no row in some of them."""
    step = dt.timedelta(minutes=35)
    whole = frame(spark, [*WALK, *NOISY], step).union(frame(spark, NOISY[:60], step, "b"))
    edges = [START + c * step for c in cuts]
    bounds = list(zip([None, *edges], [*edges, None]))
    return whole, [whole.where((F.lit(True) if a is None else F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.lit(True) if b is None else F.col("ts") < F.lit(b).cast("timestamp_ntz"))) for a, b in bounds]


def expected(whole):
    out = whole
    for name, (kind, parameters) in SPECS.items():
        out = TRANSFORMS[kind](out, out=name, **parameters)
    return {(r.series, r.ts): [r[n] for n in SPECS] for r in out.collect()}


def same(found, whole):
    assert found.keys() == whole.keys()
    for key, values in whole.items():
        close(found[key], values, 1e-7)


def test_updates_equal_the_whole(spark, tmp_path):
    whole, parts = pieces(spark, [40, 41, 90, 200])
    table = FactorTable(spark, str(tmp_path / "t"), fanout=3)
    for k, part in enumerate(parts):
        stateful.update(table, part, SPECS, batch=k)
    assert stateful.update(table, parts[2], SPECS, batch=2) == table.manifest(), "a batch that starts again"
    stateful.update(table, parts[4], SPECS)  # rows that are there
    found = {(r.series, r.ts): [r[n] for n in SPECS] for r in table.read().collect()}
    same(found, expected(whole))
    assert table.states().count() == 2


def test_updates_read_no_history(spark, tmp_path):
    _, parts = pieces(spark, [100])
    table = FactorTable(spark, str(tmp_path / "t"))
    stateful.update(table, parts[0], SPECS)
    plan = stateful.continued(parts[1], table.states(), SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<series:string,__state" in plan.replace("\n", "") and plan.count("FileScan") == 1


def test_a_new_spec_begins_and_unknown_ones_fail(spark):
    df = frame(spark, [1.0, 2.0])
    held = stateful.continued(df, None, {"c": ("cumSum", {})}).where("__state is not null").select("series", "__state.*")
    later = frame(spark, [None, None, 4.0, None])
    out = stateful.continued(later, held, {"c": ("cumSum", {}), "f": ("fill", {})}).orderBy("ts").collect()
    assert [(r.c, r.f) for r in out] == [(7.0, 4.0), (None, 4.0)], "the first two rows are there already"
    with pytest.raises(ValueError):
        stateful.continued(df, None, {"x": ("no_such", {})})


def test_streams_equal_the_whole(spark, tmp_path):
    whole, parts = pieces(spark, [40, 90, 200])
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(source)
            for _ in range(1 + (part is parts[1])):  # restarts, once with nothing new
                stream = stateful.streamed(spark.readStream.schema(whole.schema).parquet(source), SPECS)
                stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        found = {(r.series, r.ts): [r[n] for n in SPECS] for r in spark.read.parquet(target).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    same(found, expected(whole))


def test_row_windows_as_states_and_chains(spark):
    v = np.array([np.nan if x is None else x for x in NOISY])
    for name, of in (("mean", np.nanmean), ("rmin", np.nanmin), ("rmax", np.nanmax), ("std", lambda a: np.nanstd(a, ddof=1) if (~np.isnan(a)).sum() > 1 else np.nan)):
        state, out = states.STATES[name](window=7), []
        for a, b in ((0, 3), (3, 3), (3, 50), (50, len(v))):
            out += state.run(v[a:b]).tolist()
        close([None if x != x else x for x in out], [None if np.isnan(w).all() else of(w) for w in (v[max(0, i - 6) : i + 1] for i in range(len(v)))])
    with pytest.raises(ValueError):
        states.STATES["mean"](window="3d")
    df = frame(spark, [1.0, -3.0, 2.0])
    specs = {"s": ("cumSum", {}), "a": ("absv", {}, "s")}
    assert [r.a for r in stateful.continued(df, None, specs).orderBy("ts").collect()] == [1.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        stateful.continued(df, None, {"a": ("absv", {}, "s"), "s": ("cumSum", {})})


# The versioned table.


def rows(spark, first, values, series="a"):
    return spark.createDataFrame([(series, START + dt.timedelta(minutes=first + i), float(v)) for i, v in enumerate(values)], "series string, ts timestamp_ntz, value double")


def minutes(table, **times):
    return {(r.series, int((r.ts - START).total_seconds() // 60)): r.value for r in table.read(**times).collect()}


def test_upserts_and_versions(spark, tmp_path):
    table = FactorTable(spark, str(tmp_path / "t"))
    assert not table.has_rows()
    with pytest.raises(LookupError):
        table.read()
    table.commit(rows(spark, 0, [1, 2, 3]), batch=0)
    table.commit(rows(spark, 2, [30, 40]), batch=1)
    table.commit(rows(spark, 0, [7, 7, 7]), batch=1)
    table.commit(rows(spark, 50, [5], "b"), batch=2)
    table.commit(rows(spark, 0, []))
    assert minutes(table) == {("a", 0): 1, ("a", 1): 2, ("a", 2): 30, ("a", 3): 40, ("b", 50): 5}
    assert minutes(table, version=1) == {("a", 0): 1, ("a", 1): 2, ("a", 2): 3}
    assert minutes(table, since=START + dt.timedelta(minutes=2), until=START + dt.timedelta(minutes=3)) == {("a", 2): 30}
    with pytest.raises(LookupError):
        table.read(since=START + dt.timedelta(days=2))


def test_reads_open_only_what_overlaps(spark, tmp_path):
    table = FactorTable(spark, str(tmp_path / "t"), fanout=50)
    for k in range(6):
        table.commit(rows(spark, 10 * k, range(10)))
    found = table.read(since=START + dt.timedelta(minutes=25), until=START + dt.timedelta(minutes=35))
    assert found.count() == 10 and len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, "folders that nothing overlaps are not merged"
    table.commit(rows(spark, 28, [99]))
    assert "Exchange" in table.read(since=START + dt.timedelta(minutes=25), until=START + dt.timedelta(minutes=35))._jdf.queryExecution().executedPlan().toString()


def test_many_commits_leave_few_folders(spark, tmp_path):
    table, expected = FactorTable(spark, str(tmp_path / "t"), fanout=4), {}
    for k in range(45):
        first = k if k % 3 else k // 2
        table.commit(rows(spark, first, [k, k + 0.5]).coalesce(1))
        expected |= {("a", first): float(k), ("a", first + 1): k + 0.5}
    held = table.manifest()
    assert len(held.parts) <= 4 * 3 and len(table._names("manifest")) <= versioned.KEPT + 1
    assert len([n for n in table._names("data")]) <= len(held.parts) + 4 * versioned.KEPT
    assert minutes(table) == expected


def test_two_writers(spark, tmp_path):
    table = FactorTable(spark, str(tmp_path / "t"))
    table.commit(rows(spark, 0, [1]))
    held = table.manifest()
    table.commit(rows(spark, 1, [2]))
    with pytest.raises(Conflict):
        table._publish(versioned.replace(held, version=held.version + 1))
    assert minutes(table) == {("a", 0): 1, ("a", 1): 2}
