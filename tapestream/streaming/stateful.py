"""Transforms with a memory over increments: each goes on from the states that the one before left.

States (``functions.states``) are a few doubles per series and transform. Increments of a table keep them
in the table itself, committed with the rows they belong to; streams keep them in Spark's state store.
Neither reads history, and rows that are there already, or come late, are left out by their time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType

from ..functions.frames import MICROS, timed
from ..functions.states import STATES
from ..sources.versioned import FactorTable, Manifest

#: Column names to (transform, parameters), or (transform, parameters, the earlier column it goes on from).
Specs = dict[str, tuple]
STATE = StructType([StructField("last", LongType()), StructField("state", MapType(StringType(), ArrayType(DoubleType())))])


def _checked(specs: Specs) -> Specs:
    unknown = sorted({spec[0] for spec in specs.values()} - STATES.keys())
    if unknown:
        raise ValueError(f"no states for {', '.join(unknown)}")
    order = list(specs)
    for k, out in enumerate(order):
        if specs[out][2:] and specs[out][2] not in order[:k]:
            raise ValueError(f"{out} goes on from {specs[out][2]}, which isn't before it")
    return specs


def _advanced(us: np.ndarray, x: np.ndarray, specs: Specs, given: dict[str, list[float]]) -> tuple[dict[str, np.ndarray], dict[str, list[float]]]:
    """Values of each spec for rows in order, and the states after them; a spec without a state begins."""
    found, after, days = {}, {}, np.floor_divide(us, MICROS["d"]).astype(np.float64)
    for out, (name, parameters, *source) in specs.items():
        state = STATES[name](**parameters)
        if given.get(out):
            state.values = [math.nan if v is None else v for v in given[out]]
        found[out] = state.run(found[source[0]] if source else x, days)
        after[out] = [float(v) for v in state.values]
    return found, after


def continued(new: DataFrame, states: DataFrame | None, specs: Specs, x: str = "value") -> DataFrame:
    """Rows of ``new`` (series, ts, ...) with a column per spec, ``__own``, and the states after them in ``__state``.

    ``states`` has series, last (the microsecond of the last row) and state, as an earlier call gave them in
    ``__state``. Rows that aren't later than their series' last are left out; series without a new row keep
    their state. Exactly one row of a series has a state, and one that only brings a state isn't ``__own``. Each series is one
    task's group, so give increments, not a whole history of a long series at once.
    """
    specs = _checked(specs)
    frame = timed(new)
    fields = [f for f in frame.schema.fields if f.name != "us"]
    schema = StructType([*fields, *(StructField(out, DoubleType()) for out in specs), StructField("__own", BooleanType()), StructField("__state", STATE)])
    known = states if states is not None else new.sparkSession.createDataFrame([], StructType([new.schema["series"], *STATE.fields]))
    names = [f.name for f in fields]

    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        given, last = {}, None
        if held.num_rows:
            one = held.to_pylist()[0]
            given, last = dict(one["state"] or []), one["last"]
        if last is not None and rows.num_rows:
            rows = rows.filter(pa.compute.greater(rows["us"], last))
        rows = rows.sort_by("us")
        n, kind = rows.num_rows, _state_type()
        if not n:
            series = held["series"]
            nothing = {f.name: pa.nulls(len(series), t) for f, t in zip(fields, types, strict=True)} | {"series": series}
            columns = [nothing[c] for c in names] + [pa.nulls(len(series), pa.float64()) for _ in specs]
            return pa.table([*columns, pa.array([False] * len(series)), pa.array([{"last": last, "state": list(given.items())}] * len(series), kind)], names=[*names, *specs, "__own", "__state"])
        found, after = _advanced(rows["us"].to_numpy(), rows[x].to_numpy().astype(np.float64), specs, given)
        state = [None] * (n - 1) + [{"last": rows["us"][n - 1].as_py(), "state": list(after.items())}]
        values = [pa.array(found[out], pa.float64(), from_pandas=True) for out in specs]
        return pa.table([*(rows[c] for c in names), *values, pa.array([True] * n), pa.array(state, kind)], names=[*names, *specs, "__own", "__state"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    return frame.groupBy("series").cogroup(known.groupBy("series")).applyInArrow(run, schema)


def _state_type() -> pa.DataType:
    return pa.struct([("last", pa.int64()), ("state", pa.map_(pa.string(), pa.list_(pa.float64())))])


def update(table: FactorTable, new: DataFrame, specs: Specs, batch: int | None = None, x: str = "value") -> Manifest:
    """Commits the next rows of a table with their transforms; only the table's states are read, none of its rows.

    A batch that was committed before changes nothing, and so do rows that were: a run that starts again may give both.
    """
    held = table.manifest()
    if batch is not None and batch <= held.batch:
        return held
    return table.commit(continued(new, table.states(), specs, x), batch)


def streamed(stream: DataFrame, specs: Specs, x: str = "value") -> DataFrame:
    """A stream of (series, ts, x) with a column per spec, continued from batch to batch in Spark's state store.

    Within a batch rows go by time; one that isn't later than its series' last is left out (rows of one time in one
    batch all stay). Append mode; a query that is restarted from its checkpoint goes on where it stood.
    """
    specs = _checked(specs)
    frame = timed(stream).select("series", "ts", "us", F.col(x).cast("double").alias("x"))
    schema = StructType([*(frame.schema[n] for n in ("series", "ts")), StructField(x, DoubleType()), *(StructField(out, DoubleType()) for out in specs)])

    def run(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pieces)).sort_values("us", kind="stable")
        given, last = {}, None
        if state.exists:
            last, flat, sizes = state.get
            at = np.cumsum([0, *sizes])
            given = {out: list(flat[a:b]) for out, a, b in zip(specs, at[:-1], at[1:], strict=True)}
            rows = rows[rows["us"] > last]
        if not len(rows):
            return
        found, after = _advanced(rows["us"].to_numpy(), rows["x"].to_numpy(dtype=float), specs, given)
        state.update((int(rows["us"].iloc[-1]), [v for values in after.values() for v in values], [len(v) for v in after.values()]))
        yield pd.DataFrame({"series": rows["series"], "ts": rows["ts"], x: rows["x"], **found})

    return frame.groupBy("series").applyInPandasWithState(run, schema, "last long, flat array<double>, sizes array<int>", "append", GroupStateTimeout.NoTimeout)
