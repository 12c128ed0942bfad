"""Wide files: only what is asked for is read, and thousands of columns become rows."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tapestream.sources import panels

T = dt.datetime(2024, 1, 1)


def written(path, columns, rows, seed=0):
    rng = np.random.default_rng(seed)
    values = {f"s{k}.SH": rng.normal(size=rows) for k in range(columns)}
    values["s1.SH"][3] = np.nan
    pq.write_table(pa.table({"ts": pa.array([T + dt.timedelta(minutes=i) for i in range(rows)], pa.timestamp("us")), **values}), path, row_group_size=20)
    return values


def test_three_of_many_symbols(spark, tmp_path):
    bid, ask = (written(str(tmp_path / f"{side}_x.parquet"), 3000, 60, seed) for seed, side in enumerate(("Bid", "Ask")))
    some = ["s1.SH", "s7.SH", "s2999.SH"]
    found = panels.side_pair(spark, str(tmp_path), "x", symbols=[*some, "no such"], since=T + dt.timedelta(minutes=2), until=T + dt.timedelta(minutes=30))
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line or "ReadSchema" in line]
    assert scans and all("s2999.SH" in line and "s8.SH" not in line and "GreaterThanOrEqual(ts" in line for line in scans)
    rows = {(r.ts, r.symbol): (r.bid, r.ask) for r in found.collect()}
    assert len(rows) == 3 * 28
    for (ts, symbol), (b, a) in rows.items():
        i = int((ts - T).total_seconds() // 60)
        assert a == (None if np.isnan(ask[symbol][i]) else ask[symbol][i]) and b == (None if np.isnan(bid[symbol][i]) else bid[symbol][i])


def test_all_columns(spark, tmp_path, monkeypatch):
    values = written(str(tmp_path / "w.parquet"), 700, 40)
    monkeypatch.setattr(panels, "BLOCK_CELLS", 900)
    table = spark.read.parquet(str(tmp_path / "w.parquet"))
    found = panels.melted(table, "ts").toPandas()
    assert len(found) == 700 * 40 and found["value"].isna().sum() == 1
    assert np.isclose(found["value"].sum(), sum(np.nansum(v) for v in values.values()))
    assert panels.melted(table, "ts", only=[]).collect() == [] and panels.melted(table.limit(0), "ts").collect() == []
