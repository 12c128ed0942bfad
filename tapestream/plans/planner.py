"""From specs to lazy DataFrames.

The factors of an indicator are rows of one frame and their transforms columns added to it, so all of
them share an exchange and a sort; the wide frame is turned into rows once at the end. Paths keep one DataFrame per node.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recursive, technical  # noqa: F401  the latter registers its transforms
from ..functions.frames import MICROS, calendar_micros, timed, trading_seconds
from ..functions.rolling import TRANSFORMS
from ..functions.states import STATES
from ..operators import aggregate
from ..operators.align import dense, without_empty_times
from ..sources.versioned import FactorTable
from ..streaming.incremental import agreed
from ..streaming.stateful import update
from .spec import Aggregation, Spec, Step, path_edges

#: Transforms whose durations are trading time, of one-minute bars.
TRADING = ("zscore_fxwd", "zsc")
#: Between a factor's name and its series where both together are the series of a frame.
SEPARATOR = "\x1f"


def _bar_windows(parameters: dict) -> dict:
    """Trading durations as numbers of one-minute bars."""
    return {k: trading_seconds(v) // 60 if isinstance(v, str) and v[:1].isdigit() else v for k, v in parameters.items()}


def aggregated(ind: DataFrame, setting: aggregate.Setting, spec: Aggregation, minute_weights: DataFrame | None = None) -> dict[str, DataFrame]:
    """The factors of one aggregation by name; an aggregator of both sides gives two."""
    function = aggregate.AGGREGATORS[spec.aggregation]
    ts = None
    if spec.ts:
        parameters = _bar_windows(spec.ts_prs)
        ts = lambda frame, x, out: TRANSFORMS[spec.ts](frame, x=x, out=out, **parameters)
    exchange = None if spec.exchange == "all" else spec.exchange
    cs = (spec.cs, spec.cs_prs) if spec.cs_prs else spec.cs
    given = {"imb": spec.imb, "depth": spec.downscale_depth, "cs": cs, "ts": ts, "exchange": exchange, "minute_weights": minute_weights}
    taken = function.__code__.co_varnames[: function.__code__.co_argcount]
    unused = [k for k, default in (("imb", "imb01"), ("depth", 0), ("cs", "csmean"), ("ts", None), ("exchange", None)) if k not in taken and given[k] not in (None, default)]
    if unused:
        raise ValueError(f"{spec.aggregation} ({spec.name}) has no {', '.join(unused)}")
    made = function(ind, setting, **{k: v for k, v in given.items() if k in taken and not (v is None and k in ("ts", "exchange", "minute_weights"))})
    if spec.aggregation == "avg_side":
        return {f"{spec.name}_{side.capitalize()}": made.select("series", "ts", F.col(side).alias("value")) for side in ("bid", "ask")}
    return {spec.name: made.select("series", "ts", "value")}


def _rows(frame: DataFrame, columns: dict[str, str], name: Column) -> DataFrame:
    """factor, series, ts, value of several columns (name: column) of the factor ``name``."""
    pairs = F.array(*(F.struct(F.lit(of).alias("of"), F.col(f"`{c}`").cast("double").alias("value")) for of, c in columns.items()))
    return frame.withColumn("name", name).select("name", "series", "ts", F.explode(pairs).alias("p")).select(F.concat_ws("-", "name", "p.of").alias("factor"), "series", "ts", "p.value")


def _layers(frame: DataFrame, spec: Spec) -> tuple[DataFrame, dict[str, str]]:
    """A frame with the first and second layer of transforms as columns, and which of them to keep by name."""
    columns = {"org": "value"} if spec.save_org else {}
    held = {"org": "value"}
    for k, step in enumerate(spec.steps):
        frame = TRANSFORMS[step.function](frame, x="value", out=f"a{k}", **step.parameters)
        held[step.name] = f"a{k}"
        if spec.save_first_layer:
            columns[step.name] = f"a{k}"
    for k, second in enumerate(spec.second):
        for j, base in enumerate(["org", *second.base]):
            frame = TRANSFORMS[second.step.function](frame, x=held[base], out=f"b{k}_{j}", **second.step.parameters)
            columns[f"{base}-{second.step.name}"] = f"b{k}_{j}"
    return frame, columns


def layered(factor: DataFrame, name: str, spec: Spec) -> DataFrame:
    """A factor with its first and second layer of transforms: factor, series, ts, value."""
    frame, columns = _layers(timed(dense(without_empty_times(factor))), spec)
    return _rows(frame, columns, F.lit(name))


def generated(ind: DataFrame, setting: aggregate.Setting, spec: Spec, indicator: str, minute_weights: DataFrame | None = None) -> DataFrame:
    """All factors of one indicator under a spec: factor, series, ts, value.

    The factors are rows of one frame, each dense on its own times and series, so every transform is
    planned once, whatever the number of aggregations.
    """
    rows = None
    for aggregation in spec.aggregations:
        for name, factor in aggregated(ind, setting, aggregation, minute_weights).items():
            made = factor.select(F.lit(f"{indicator}-{name}").alias("name"), "series", "ts", "value")
            rows = made if rows is None else rows.unionByName(made)
    if rows is None:
        raise ValueError("the spec has no aggregation")
    # one row per factor and time, whose exchange the list of each factor's series reuses; a factor has few series
    times = rows.groupBy("name", "ts").agg(F.collect_list(F.struct("series", "value")).alias("cells"), F.count("value").alias("n"))
    series = times.select("name", F.explode("cells.series").alias("series")).groupBy("name").agg(F.collect_set("series").alias("all"))
    at = times.where("n > 0").join(series, "name").select("name", "ts", F.map_from_entries("cells").alias("cells"), F.explode("all").alias("series"))
    grid = at.select("name", "ts", "series", F.try_element_at("cells", F.col("series")).alias("value"))
    frame, columns = _layers(timed(grid.withColumn("of", F.col("series")).withColumn("series", F.concat_ws(SEPARATOR, "name", "series"))), spec)
    return _rows(frame.withColumn("series", F.col("of")), columns, F.col("name"))


def look_back(spec: Spec) -> tuple[int, int]:
    """How far the transforms of a spec look back, both layers together: microseconds of calendar windows, and rows of the others."""

    def of(step: Step) -> tuple[int, int]:
        micros, rows = 0, 0
        for name, value in step.parameters.items():
            if isinstance(value, str) and value[:1].isdigit():
                if step.function in TRADING:
                    rows += trading_seconds(value) // 60
                else:
                    micros += calendar_micros(value)
            elif name in ("window", "short_window", "long_window", "fft_window", "pos_window", "period", "gap"):
                rows += recursive.REMEMBERS[step.function](value) if step.function in recursive.REMEMBERS else int(value)
            elif name == "span":
                rows += recursive.memory(2 / (value + 1))
            elif name == "n" and step.function.startswith("dod"):
                micros += value * MICROS["d"]
        return micros, rows + 1

    first = [of(s) for s in spec.steps] or [(0, 0)]
    second = [of(s.step) for s in spec.second] or [(0, 0)]
    inner = [_bar_windows(a.ts_prs) for a in spec.aggregations if a.ts]
    within = max((sum(v for v in p.values() if isinstance(v, int)) for p in inner), default=0)
    return max(f[0] for f in first) + max(s[0] for s in second), max(f[1] for f in first) + max(s[1] for s in second) + within


class ShortHistory(ValueError):
    """An increment would be computed from fewer rows than its transforms look back over."""


def covered(ind: DataFrame, spec: Spec, since: str, history: str) -> None:
    """Raises ShortHistory unless ``history`` before ``since`` holds what the spec's transforms look back over, or all there is."""
    micros, rows = look_back(spec)
    start = F.lit(since).cast("timestamp_ntz")
    begin = start - F.make_dt_interval(secs=F.lit(calendar_micros(history) / 1e6))
    known = ind.where(F.col("ts") < start).agg(F.count_distinct(F.when(F.col("ts") >= begin, F.col("ts"))).alias("n"), F.count_if(F.col("ts") < begin).alias("earlier")).first()
    if known["earlier"] and (calendar_micros(history) < micros or known["n"] < rows):
        raise ShortHistory(f"{history} before {since} has {known['n']} times; the transforms look back {rows} rows and {micros / 1e6:.0f} seconds")


def extended(old: DataFrame, ind: DataFrame, setting: aggregate.Setting, spec: Spec, indicator: str, since: str, history: str, minute_weights: DataFrame | None = None, tolerance: float | None = None, debug: str | None = None) -> DataFrame:
    """``old`` (what ``generated`` gave) with all factors made anew from the time ``since`` on.

    Only the indicator's rows from ``history`` (a calendar duration, as long as the transforms look back)
    before it are read; too short a one is an error (``covered``). Where both have a row they must agree
    (``incremental.agreed``); the new one stays. ``stateful.update`` goes on without any history.
    """
    covered(ind, spec, since, history)
    start = F.lit(since).cast("timestamp_ntz")
    recent = ind.where(F.col("ts") >= start - F.make_dt_interval(secs=F.lit(calendar_micros(history) / 1e6)))
    new = generated(recent, setting, spec, indicator, minute_weights).where(F.col("ts") >= start)
    keyed = [t.select(F.concat_ws(SEPARATOR, "factor", "series").alias("series"), "ts", "value") for t in (old, new)]
    agreed(*keyed, tolerance, debug)
    kept = old.join(new.select("factor", "series", "ts"), ["factor", "series", "ts"], "left_anti")
    return kept.select("factor", "series", "ts", "value").unionByName(new)


def state_specs(spec: Spec) -> tuple[dict[str, tuple], list[str]]:
    """The transforms of both layers as states by name, and the names to keep; an error for those that have no state."""
    specs: dict[str, tuple] = {step.name: (step.function, step.parameters) for step in spec.steps}
    kept = list(specs) if spec.save_first_layer else []
    for second in spec.second:
        for base in ["org", *second.base]:
            name = f"{base}-{second.step.name}"
            specs[name] = (second.step.function, second.step.parameters, *([] if base == "org" else [base]))
            kept.append(name)
    without = sorted({s[0] for s in specs.values()} - STATES.keys())
    if without:
        raise ValueError(f"{', '.join(without)} can't go on without history; use extended")
    return specs, kept


def advanced(table: FactorTable, ind: DataFrame, setting: aggregate.Setting, spec: Spec, indicator: str, batch: int | None = None, minute_weights: DataFrame | None = None) -> None:
    """Adds the factors of an indicator's next rows to a table, out of the states it holds; no history is read.

    ``ind`` has whole times later than the table's. Series that the table knows and the new rows lack go on with nulls,
    as in the grid of the whole. A batch that was committed changes nothing. ``table_rows`` gives the factors.
    """
    specs, _ = state_specs(spec)
    new = generated(ind, setting, replace(spec, steps=[], second=[], save_org=True), indicator, minute_weights).where("factor is not null")
    named = new.select(F.regexp_replace("factor", "-org$", "").alias("name"), "series", "ts", "value")
    held = table.states()
    of = named.select("name", "series").distinct()
    if held is not None:
        parts = F.split("series", SEPARATOR)
        of = of.union(held.select(parts[0].alias("name"), parts[1].alias("series"))).distinct()
    grid = named.select("name", "ts").distinct().join(of, "name").join(named, ["name", "series", "ts"], "left")
    update(table, grid.select(F.concat_ws(SEPARATOR, "name", "series").alias("series"), "ts", "value"), specs, batch)


def table_rows(table: FactorTable, spec: Spec, **times) -> DataFrame:
    """factor, series, ts, value of a table that ``advanced`` keeps."""
    _, kept = state_specs(spec)
    columns = ({"org": "value"} if spec.save_org else {}) | {name: name for name in kept}
    parts = F.split("series", SEPARATOR)
    return _rows(table.read(**times).withColumn("of", parts[0]).withColumn("series", parts[1]), columns, F.col("of"))


def along_paths(factors: DataFrame, paths: list[list[str]], specs: dict[str, list[Step]]) -> dict[str, DataFrame]:
    """factor, series, ts, value of every node of the paths; each node transforms all factors of its parent."""
    nodes: dict[str | None, DataFrame] = {None: factors}
    for parent, spec, node in path_edges(paths):
        keyed = nodes[parent].withColumn("of", F.col("series")).withColumn("series", F.concat_ws(SEPARATOR, "factor", "series"))
        frame = timed(keyed)
        columns = {}
        for k, step in enumerate(specs[spec]):
            frame = TRANSFORMS[step.function](frame, x="value", out=f"a{k}", **step.parameters)
            columns[step.name] = f"a{k}"
        pairs = F.array(*(F.struct(F.lit(name).alias("step"), F.col(c).cast("double").alias("value")) for name, c in columns.items()))
        rows = frame.select("factor", "of", "ts", F.explode(pairs).alias("p"))
        nodes[node] = rows.select(F.concat_ws("-", "factor", "p.step").alias("factor"), F.col("of").alias("series"), "ts", "p.value")
    return {k: v for k, v in nodes.items() if k is not None}
