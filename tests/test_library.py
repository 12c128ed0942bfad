"""Aggregates, alignment, sources, plans, increments and streams on small literal frames."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapestream.functions.cross_section import reduce_cross_section
from tapestream.functions.imbalance import IMBALANCE
from tapestream.functions.rolling import TRANSFORMS
from tapestream.operators import aggregate, align, calendar, universe, weights
from tapestream.plans import naming, planner, registry, spec
from tapestream.sources import panels, tables
from tapestream.streaming import incremental

T = [dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=i) for i in range(6)]
DAY = T[0].date()


def test_imbalances_of_edges(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.0, 0.0), (None, 2.0), (3.0, 1.0)], "bid double, ask double")
    found = [tuple(r) for r in df.select(*(IMBALANCE[n](F.col("bid"), F.col("ask")).alias(n) for n in ("imb01", "imb03", "imb06", "add"))).collect()]
    assert found == [(None, -1.0, -2.0, 0.0), (None, None, 0.0, 0.0), (None, None, None, None), (0.5, 1 / 3, -2.0, 4.0)]


def test_reducers_of_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 0.2), (2, 0.9), (2, None), (2, None)], "k int, x double")
    out = {n: {r.k: r.v for r in reduce_cross_section(df, n, ["k"], {"v": "x"}).collect()} for n in ("csmean", "cssum", "cs_above_threshold", "cs_breadth", "cs_hhi", "cs_gini", "cs_mad")}
    assert out["csmean"][1] is None and out["cssum"][1] == 0
    assert out["cs_above_threshold"][2] == 0.25 and out["cs_breadth"][2] == 1
    assert out["cs_hhi"][1] is None and out["cs_gini"][1] == 0 and out["cs_mad"][2] == pytest.approx(0.35)


def setting(spark):
    rows = [("A", DAY, "s1", 1.0), ("A", DAY, "s2", 3.0), ("B", DAY, "s1", 1.0), ("B", DAY, "s2", 1.0), ("B", DAY, "s3", 2.0)]
    return aggregate.Setting(spark.createDataFrame(rows, "index_code string, trade_date date, symbol string, weight double"), ["A", "B"], "B", ["A", "B"], first_venue=("s",))


def indicator(spark):
    return spark.createDataFrame([(T[0], "s1", 2.0, 1.0), (T[0], "s2", 4.0, None), (T[0], "s3", 6.0, 3.0), (T[1], "s9", 1.0, 1.0)], "ts timestamp_ntz, symbol string, bid double, ask double")


def values(df):
    return {(r.ts, r.series): r.value for r in df.collect()}


def test_weighted_mean_uses_the_weights_of_values(spark):
    found = values(aggregate.wavg_imb(indicator(spark), setting(spark)))
    bid, ask = (2 + 12) / 4, 1.0
    assert found[T[0], "A"] == pytest.approx((bid - ask) / (bid + ask)) and (T[1], "A") not in found
    renormalized = values(aggregate.imb_csf(indicator(spark), setting(spark), cs="cssum"))
    assert renormalized[T[0], "A"] == pytest.approx(1 / 3)


def test_depths(spark):
    s = setting(spark)
    merged = {(r.index_code, r.symbol) for r in universe.range_weights(s.weights, ["A"], 1, "B", ["A", "B"]).collect()}
    assert merged == {("A", "s1"), ("A", "s2"), ("A", "s3")}
    rest = {(r.index_code, r.symbol, round(r.weight, 6)) for r in universe.range_weights(s.weights, ["B"], "all", "B", ["A", "B"]).collect()}
    assert rest == {("B", "s3", round(1 / 3, 6))}
    with pytest.raises(NotImplementedError):
        universe.range_weights(s.weights, ["A"], 0.5, "B", ["A", "B"])
    with pytest.raises(ValueError):
        universe.downscale(["A"], "Z", 1)


def test_minute_weight_fill(spark):
    grid = spark.createDataFrame([("A", T[i], "s1", w) for i, w in enumerate([0.5, None, None, None, -1.0, 0.0])], "index_code string, ts timestamp_ntz, symbol string, weight double")
    assert [r.weight for r in universe.filled_minute_weights(grid, limit=2).orderBy("ts").collect()] == [0.5, 0.5, 0.5, None, None, None]


def test_align(spark):
    old = spark.createDataFrame([("a", T[0], 1.0), ("a", T[1], 2.0)], "series string, ts timestamp_ntz, value double")
    new = spark.createDataFrame([("a", T[1], None), ("a", T[2], 3.0), ("b", T[2], 4.0)], "series string, ts timestamp_ntz, value double")
    assert [tuple(r) for r in align.consistency(old, new).collect()] == [(1, 1, T[1])]
    up = {(r.series, r.ts): r.value for r in align.upsert(old, new).collect()}
    assert up == {("a", T[0]): 1.0, ("a", T[1]): None, ("a", T[2]): 3.0, ("b", T[1]): None, ("b", T[2]): 4.0}
    with pytest.raises(incremental.Inconsistent):
        incremental.updated(old, new)
    assert incremental.updated(old, new.where("ts > '2024-01-02 09:31:00'")).count() == 4
    assert align.without_empty_times(new).count() == 2


def test_resample_right_edges(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, 0), 1.0), ("a", dt.datetime(2024, 1, 1, 0, 0, 30), 2.0), ("a", dt.datetime(2024, 1, 1, 0, 1, 0), 3.0)], "series string, ts timestamp_ntz, value double")
    assert {r.ts.minute: r.value for r in calendar.resample_right(df, "1min").collect()} == {0: 1.0, 1: 2.5}


def test_weights_build(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 4)], "trade_date date")
    members = spark.createDataFrame([("I", "x", dt.date(2024, 1, 1), 1.0), ("I", "y", dt.date(2024, 1, 1), 2.0), ("I", "y", dt.date(2024, 1, 3), 5.0)], "index_code string, symbol string, eff_date date, weight double")
    found = {(r.trade_date.day, r.symbol): r.weight for r in weights.daily_weights(members, days).collect()}
    assert found == {(1, "x"): 1.0, (1, "y"): 2.0, (2, "x"): 1.0, (2, "y"): 2.0, (3, "y"): 5.0, (4, "y"): 5.0}
    assert {r.trade_date.day for r in weights.labelled_next_day(weights.daily_weights(members, days), days).collect()} == {2, 3, 4}


def test_weights_increment(spark):
    old = spark.createDataFrame([("I", dt.date(2024, 1, 1)), ("I", dt.date(2024, 2, 1))], "index_code string, eff_date date")
    assert weights.increment(old, old) is None
    more = weights.increment(old, old.unionByName(spark.createDataFrame([("J", dt.date(2024, 3, 1)), ("J", dt.date(2024, 2, 1))], old.schema)))
    assert sorted((r.index_code, r.eff_date.month) for r in more.collect()) == [("I", 1), ("I", 2), ("J", 3)]


def test_days_outside_the_calendar(spark):
    cal = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (3, 4, 8)], "trade_date date")
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 3, 4, 6, 8, 20)] + [(None,)], "day date")
    of = lambda df: {r.day and r.day.day: r.trade_date and r.trade_date.day for r in df.collect()}
    assert of(calendar.previous_trading_day(days, cal)) == {1: None, 3: None, 4: 3, 6: 4, 8: 4, 20: 8, None: None}
    assert of(calendar.next_trading_day(days, cal)) == {1: 3, 3: 4, 4: 8, 6: 8, 8: None, 20: None, None: None}
    assert of(calendar.trading_day_n_days_ago(days, cal, 2)) == {1: None, 3: None, 4: None, 6: 4, 8: 4, 20: 8, None: None}
    assert of(calendar.next_trading_day(days, cal.limit(0))) == {1: None, 3: None, 4: None, 6: None, 8: None, 20: None, None: None}


def test_registry(spark):
    own = {"imb": lambda b, a: b * a, "cs": lambda x, m, u, least=0.0: F.count_if(x - m >= least).cast("double"), "ts": lambda frame, x, out, by: frame.withColumn(out, x * by)}
    for kind, function in own.items():
        registry.register(kind, "own", function, two_pass=kind == "cs")
        with pytest.raises(ValueError):
            registry.register(kind, "own", function)
    registry.register("aggregation", "own", lambda ind, s, imb="imb01": ind.select("ts", F.col("symbol").alias("series"), IMBALANCE[imb](F.col("bid"), F.col("ask")).alias("value")))
    plan = spec.parsed({"target_indexes": ["A"], "index_all": "B", "aggregation": {"o": {"aggregation": "own", "imb": "own"}, "c": {"aggregation": "imb_csf", "cs": "own", "cs_prs": {"least": -9.0}}}, "ts": {"own": {"by": [2.0]}}})
    found = {(r.factor, r.ts, r.series): r.value for r in planner.generated(indicator(spark), setting(spark), plan, "v").collect()}
    assert found["v-o-own_b2.0", T[0], "s3"] == 36 and found["v-c-org", T[0], "B"] == 2
    for kind in registry.KINDS:
        registry.unregister(kind, "own")
    with pytest.raises(ValueError):
        registry.register("udf", "own", len)


def test_panels_in_files(spark, tmp_path):
    index = pd.Index(T[:3], name="ts")
    for side in ("Bid", "Ask"):
        pd.DataFrame({"600000.XSHG": [1.0, None, 3.0], "b": [4.0, 5.0, 6.0]}, index=index).reset_index().to_parquet(tmp_path / f"{side}_vol.parquet", coerce_timestamps="us")
    pd.DataFrame({"x": [1.0]}).to_parquet(tmp_path / "Bid_only.parquet")
    assert panels.indicators(spark, str(tmp_path)) == ["vol"]
    pair = panels.side_pair(spark, str(tmp_path), "vol")
    assert pair.count() == 6 and pair.where("bid is null").count() == 1
    pd.DataFrame({"trade_date": [DAY, DAY + dt.timedelta(days=1)], "s1": [1.0, 2.0], "s2": [0.0, 3.0], "z.XBEI": [1.0, 1.0]}).to_parquet(tmp_path / "I.parquet")
    w = panels.index_weights(spark, str(tmp_path), ["I"])
    assert {(r.trade_date, r.symbol) for r in w.collect()} == {(DAY, "s1"), (DAY + dt.timedelta(days=1), "s1"), (DAY + dt.timedelta(days=1), "s2")}
    assert {(r.trade_date, r.symbol, r.weight) for r in universe.lagged(w).collect()} == {(DAY + dt.timedelta(days=1), "s1", 1.0)}
    factors = pair.select(F.lit("f").alias("factor"), F.col("symbol").alias("series"), "ts", F.col("bid").alias("value"))
    panels.write_factors(factors, str(tmp_path / "out"))
    back = panels.read_factor(spark, str(tmp_path / "out"), "f")
    assert back.count() == 6 and dict(back.dtypes)["value"] == "double"
    panels.write_wide(back, str(tmp_path / "wide"))
    assert set(spark.read.parquet(str(tmp_path / "wide")).columns) == {"ts", "600000.XSHG", "b"}


def test_text_tables(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("TradingDay\n2024-01-02\n20240103\n")
    assert {r.trade_date for r in tables.calendar_csv(spark, str(tmp_path / "cal.csv")).collect()} == {dt.date(2024, 1, 2), dt.date(2024, 1, 3)}
    (tmp_path / "oi.csv").write_text('dt,call_oi_sum,put_oi_sum,pc\n2024-01-02 10:00:00,"1,500","500",x\n')
    r = tables.option_interest_csv(spark, str(tmp_path / "oi.csv")).first()
    assert (r.call, r.put, r.pc, r.imbalance) == (1500.0, 500.0, None, 0.5)
    (tmp_path / "w.csv").write_text("con_code,trade_date,weight\ns1,20240102,0.5\n")
    assert tables.weights_csv(spark, str(tmp_path / "w.csv")).first().trade_date == DAY
    (tmp_path / "q.stat").write_text("20240101,s1,rate 0.5,missing: 3\n20240102,s1,rate 0.75,missing: 0\n20240102,s2,rate 1,missing: none\n")
    stats = tables.completeness(spark, str(tmp_path / "q.stat"))
    assert {(r.symbol, r.rate, r.missing) for r in stats.collect()} == {("s1", 0.75, 0.0), ("s2", 1.0, None)}
    assert tables.first_with_rows([lambda: stats.limit(0), lambda: stats]).count() == 2
    wide = spark.createDataFrame([(DAY, 1, 2)], "stockdate date, a int, b int")
    held = tables.positions(wide, "acc")
    assert tables.with_positions(held, held.where("symbol = 'a'").withColumn("position", F.lit(9.0))).where("position = 9").count() == 1


def test_names():
    assert naming.abbreviations(["window", "width", "min_periods"]) == {"window": "w", "width": "wi", "min_periods": "m"}
    assert naming.transform_name("zscore", {"period_str": "30d"}) == "zscore_p30d"
    assert naming.parameter_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_spec(tmp_path):
    (tmp_path / "s.yaml").write_text("target_indexes: [A]\nindex_all: B\naggregation:\n  w: {aggregation: wavg_imb, imb: imb02}\nts:\n  mean: {window: [3, 6]}\n  absv: {}\nts_second_layer:\n  rmax: {base_ts: [mean], params: {window: [4]}}\n")
    found = spec.parsed(spec.loaded(str(tmp_path / "s.yaml")))
    assert found.index_seq == ["A"] and found.aggregations[0].imb == "imb02"
    assert [s.name for s in found.steps] == ["mean_w3", "mean_w6", "absv"] and found.second[0].base == ["mean_w3", "mean_w6"]
    (tmp_path / "b.toml").write_text(spec.batch_toml([{"generate_name": "g", "ind_cate": "c"}], 3))
    assert spec.loaded(str(tmp_path / "b.toml")) == {"n_workers": 3, "mode": "init", "factors": [{"generate_name": "g", "ind_cate": "c"}]}
    assert spec.path_edges([["a", "b"], ["a", "c"]]) == [(None, "a", "a"), ("a", "b", "a_TS_b"), ("a", "c", "a_TS_c")]
    assert spec.terminal_nodes([["a", "b"], ["a"]]) == ["a", "a_TS_b"]


def test_plan_equals_direct_composition(spark):
    s = setting(spark)
    plan = spec.parsed({"target_indexes": ["A", "B"], "index_all": "B", "aggregation": {"w": {"aggregation": "wavg_imb"}, "side": {"aggregation": "avg_side"}}, "ts": {"mean": {"window": [2]}}, "ts_second_layer": {"absv": {"params": {}}}})
    made = planner.generated(indicator(spark), s, plan, "vol")
    assert {r.factor for r in made.select("factor").distinct().collect()} == {f"vol-{a}-{t}" for a in ("w", "side_Bid", "side_Ask") for t in ("org", "mean_w2", "org-absv", "mean_w2-absv")}
    direct = TRANSFORMS["mean"](align.dense(aggregate.wavg_imb(indicator(spark), s)), out="m", window=2)
    assert {(r.series, r.ts): r.value for r in made.where("factor = 'vol-w-mean_w2'").collect()} == {(r.series, r.ts): r.m for r in direct.collect()}


def test_new_dates_of_a_plan(spark):
    s = setting(spark)
    plan = spec.parsed({"target_indexes": ["A", "B"], "index_all": "B", "aggregation": {"w": {"aggregation": "avg_imb"}}, "ts": {"mean": {"window": [2]}}})
    rows = [(t, f"s{k}", float(i + k), float((i * k) % 4 + 1)) for i, t in enumerate(T) for k in (1, 2, 3)]
    ind = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, bid double, ask double")
    whole = planner.generated(ind, s, plan, "v")
    old = planner.generated(ind.where(F.col("ts") <= F.lit(T[3])), s, plan, "v")
    keyed = lambda df: {(r.factor, r.series, r.ts): r.value for r in df.collect()}
    more = planner.extended(old, ind, s, plan, "v", str(T[2]), "2min", tolerance=1e-12)
    assert keyed(more) == pytest.approx(keyed(whole)) and len(keyed(whole)) == 24
    with pytest.raises(incremental.Inconsistent):
        planner.extended(old.withColumn("value", F.col("value") + 1), ind, s, plan, "v", str(T[2]), "2min", tolerance=1e-12)


def test_short_history_is_an_error(spark):
    s, start = setting(spark), dt.datetime(2024, 1, 2, 10)
    rows = [(start + dt.timedelta(minutes=i), f"s{k}", float(i + k), float((i * k) % 4 + 1)) for i in range(60) for k in (1, 2, 3)]
    ind = spark.createDataFrame(rows, "ts timestamp_ntz, symbol string, bid double, ask double")
    body = {"target_indexes": ["A", "B"], "index_all": "B", "aggregation": {"w": {"aggregation": "avg_imb"}}, "ts_second_layer": {"mean": {"params": {"window": [5]}}}}
    for ts, needed in (({"mean": {"window": [20]}}, (0, 27)), ({"zscore": {"period_str": ["30min"]}}, (30 * 60 * 10**6, 7)), ({"ewma": {"span": [2]}}, (0, 1 + 6 + 38)), ({"zsc": {"period_str": ["10min"]}}, (0, 17))):
        plan = spec.parsed({**body, "ts": ts})
        assert planner.look_back(plan) == needed
        since = str(start + dt.timedelta(minutes=50))
        planner.covered(ind, plan, since, "48min")
        planner.covered(ind, plan, since, "2h")  # all there is
        with pytest.raises(planner.ShortHistory):
            planner.extended(planner.generated(ind, s, plan, "v"), ind, s, plan, "v", since, "6min")


def test_plans_without_states_need_history(spark):
    body = {"target_indexes": ["A", "B"], "index_all": "B", "aggregation": {"w": {"aggregation": "avg_imb"}}, "ts": {"zscore": {"period_str": ["3d"]}, "mean": {"window": [2]}}}
    with pytest.raises(ValueError, match="zscore"):
        planner.state_specs(spec.parsed(body))
    assert planner.state_specs(spec.parsed({**body, "ts": {"mean": {"window": [2]}}}))[1] == ["mean_w2"]


def test_transform_within_aggregation(spark):
    found = aggregate.avg_imb(indicator(spark), setting(spark), ts=lambda f, x, out: TRANSFORMS["absv"](f, x=x, out=out))
    assert values(found).keys() == {(T[0], "A"), (T[0], "B")}


def test_latest_equals_whole(spark):
    rows = [("a", dt.datetime(2024, 1, 1 + i % 9, 10, i // 9), float((i * 7) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double")
    whole = TRANSFORMS["zscore"](df, out="z", period_str="3d").orderBy(F.desc("ts")).first().z
    assert incremental.latest_zscore(df, "3d").first().value == pytest.approx(whole)
    whole = TRANSFORMS["rollingRemoveIntradayEffect"](df, out="z", window="5d").orderBy(F.desc("ts")).first().z
    assert incremental.latest_without_intraday_effect(df, "5d").first().value == pytest.approx(whole)


def test_stream(spark, tmp_path):
    events = [(T[0] + dt.timedelta(seconds=20 * i), "s1", "bid" if i % 2 else "ask", float(i)) for i in range(12)] + [(T[0] + dt.timedelta(hours=2), "s1", "bid", 1.0)]
    schema = "ts timestamp, symbol string, side string, value double"
    for k in range(2):
        spark.createDataFrame(events[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bars = incremental.minute_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

    def factor(known):
        frame = known.select(F.col("symbol").alias("series"), F.col("ts").cast("timestamp_ntz").alias("ts"), IMBALANCE["imb01"](F.col("bid"), F.col("ask")).alias("value"))
        return TRANSFORMS["mean"](frame, out="m", window=2).select("series", "ts", F.col("m").alias("value"))

    query = incremental.write_trailing(bars, str(tmp_path / "history"), str(tmp_path / "factor"), factor, "10min", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    found = {r.ts: r.value for r in incremental.latest_version(spark, str(tmp_path / "factor")).collect()}
    assert len(found) == 4 and found[T[0]] == pytest.approx((1 - 2) / 3)


def test_batch_file_round_trip(tmp_path):
    specs = [{"name": 'a "quoted" one', "path": "C:\\x", "on": True, "off": False, "n": 3, "x": 0.5, "list": ["a'b", "c"], "inner": {"k": [1, 2]}, "none": None}]
    file = tmp_path / "batch.toml"
    file.write_text(spec.batch_toml(specs, 4, "update"))
    assert spec.loaded(str(file)) == {"n_workers": 4, "mode": "update", "factors": [{k: v for k, v in specs[0].items() if v is not None}]}
    spec.paths_json([["a", "b"], ["a"]], str(tmp_path / "paths.json"))
    assert spec.loaded(str(tmp_path / "paths.json")) == ["a", "a_TS_b"]


def test_planner_takes_or_refuses_parameters(spark):
    s, ind = setting(spark), indicator(spark)
    made = planner.aggregated(ind, s, spec.Aggregation("f", "imb_csf", cs="cs_above_threshold", cs_prs={"threshold": 0.4}))["f"]
    assert values(made)[T[0], "A"] == pytest.approx(0.0) and values(made)[T[0], "B"] == pytest.approx(1 / 3)
    none = planner.aggregated(ind, s, spec.Aggregation("f", "wavg_imb", exchange="SZ"))["f"]
    both = planner.aggregated(ind, s, spec.Aggregation("f", "wavg_imb", exchange="all"))["f"]
    assert not values(none) and values(both)
    with pytest.raises(ValueError, match="exchange"):
        planner.aggregated(ind, s, spec.Aggregation("f", "imb_csf", exchange="SH"))


def test_inconsistent_rows_are_written(spark, tmp_path):
    old = spark.createDataFrame([("a", T[0], 1.0), ("a", T[1], 2.0)], "series string, ts timestamp_ntz, value double")
    new = spark.createDataFrame([("a", T[1], 2.5), ("a", T[2], 3.0)], "series string, ts timestamp_ntz, value double")
    with pytest.raises(incremental.Inconsistent):
        incremental.updated(old, new, debug=str(tmp_path / "differ"))
    assert [(r.series, r.ts, r.old, r.new) for r in spark.read.parquet(str(tmp_path / "differ")).collect()] == [("a", T[1], 2.0, 2.5)]


def test_message_insert(spark):
    held = spark.createDataFrame([(4, "x", "F", "t", "m", 1)], "id int, author string, level string, title string, msg string, alerted int")
    more = tables.with_message(tables.with_message(held, "me", "P", "late", "text"), "me", "P", "later", None)
    assert [tuple(r) for r in more.orderBy("id").collect()] == [(4, "x", "F", "t", "m", 1), (5, "me", "P", "late", "text", 0), (6, "me", "P", "later", None, 0)]
    assert [r.id for r in tables.with_message(held.limit(0), "me", "P", "t", "m").collect()] == [1]
