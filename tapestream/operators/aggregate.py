"""Aggregators: an indicator panel and index weights to one factor value per time and index.

Indicators are rows (ts, symbol, bid, ask). Each aggregator is a join with the day's weights (a
broadcast where Spark finds them small), one grouped reduction over all indexes, and an imbalance.
A ``ts`` argument is a transform (frame, x, out) of the series; it runs on each side before the
imbalance, on the grid of times and series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import Reducer, reduce_cross_section
from ..functions.frames import ratio, timed
from ..functions.imbalance import IMBALANCE
from .universe import board_weights, downscale, on_venue, range_weights

Transform = Callable[..., DataFrame]


@dataclass
class Setting:
    """What all aggregators of one run share."""

    weights: DataFrame
    targets: list[str]
    index_all: str
    index_seq: list[str] = field(default_factory=list)
    universe: DataFrame | None = None
    first_venue: tuple[str, ...] = ("5", "6")

    def __post_init__(self) -> None:
        self.index_seq = self.index_seq or list(self.targets)

    def sizes(self, depth: int | str = 0, indexes: list[str] | None = None) -> DataFrame:
        """index_code, universe: columns of each target's (or given index's) cross-section (zero weights included if ``universe`` names them)."""
        named = (self.universe if self.universe is not None else self.weights).select("index_code", "symbol").distinct()
        codes = {t: [t] if depth == 0 else [self.index_all] if depth == "all" else downscale(self.index_seq, t, depth) for t in indexes or self.targets}
        counted = named.agg(*(F.count_distinct(F.when(F.col("index_code").isin(members), F.col("symbol"))).alias(f"n{k}") for k, members in enumerate(codes.values())))
        rows = F.explode(F.array(*(F.struct(F.col(f"n{k}").alias("universe"), F.lit(target).alias("index_code")) for k, target in enumerate(codes))))
        return counted.select(rows.alias("r")).select("r.*")


def weighted(panel: DataFrame, weights: DataFrame, minute: bool = False) -> DataFrame:
    """The panel's rows with each index they count for and the weight there."""
    if minute:
        return panel.join(weights, ["ts", "symbol"])
    return panel.withColumn("trade_date", F.to_date("ts")).join(weights, ["trade_date", "symbol"])


def weighted_mean(rows: DataFrame, values: list[str]) -> DataFrame:
    """Mean of each value with weights scaled over the cells that have one: sum(w x) / sum(w)."""
    w = F.nullif(F.col("weight"), F.lit(0.0))
    return rows.groupBy("ts", "index_code").agg(*(ratio(F.sum(w * F.col(x)), F.sum(F.when(F.col(x).isNotNull(), w))).alias(x) for x in values))


def renormalized(rows: DataFrame, value: str) -> DataFrame:
    """value * w', where w' has mean 1 over the cells with a value: for reducers other than the mean."""
    over = Window.partitionBy("ts", "index_code")
    w = F.when(F.col(value).isNotNull(), F.nullif(F.col("weight"), F.lit(0.0)))
    return rows.withColumn(value, F.col(value) * ratio(w * F.count(w).over(over), F.sum(w).over(over)))


def _reduced(rows: DataFrame, setting: Setting, cs: Reducer, values: dict[str, str], depth: int | str = 0, indexes: list[str] | None = None) -> DataFrame:
    sized = rows.join(F.broadcast(setting.sizes(depth, indexes)), "index_code", "left")  # a row per index
    return reduce_cross_section(sized, cs, ["ts", "index_code"], values, F.col("universe"))


def _renormalized_reduced(rows: DataFrame, s: Setting, cs: Reducer, values: list[str], indexes: list[str] | None = None) -> DataFrame:
    """Values times their renormalised weights, reduced; the mean of those is the weighted mean."""
    if cs == "csmean":
        return weighted_mean(rows, values)
    for x in values:
        rows = renormalized(rows, x)
    return _reduced(rows, s, cs, {x: x for x in values}, 0, indexes)


def _transformed(factor: DataFrame, values: list[str], ts: Transform | None, key: str = "index_code") -> DataFrame:
    if ts is None:
        return factor
    frame = timed(factor.withColumnRenamed(key, "series"))
    for x in values:
        frame = ts(frame, x=x, out=f"{x}_of_ts").drop(x).withColumnRenamed(f"{x}_of_ts", x)
    return frame.withColumnRenamed("series", key).drop("us")


def _imbalanced(factor: DataFrame, imb: str, b: str = "bid", a: str = "ask") -> DataFrame:
    return factor.select("ts", F.col("index_code").alias("series"), IMBALANCE[imb](F.col(b), F.col(a)).alias("value"))


def _scaled(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.withColumns({x: F.col(x) * F.col("weight") for x in values})


def _universe_rows(ind: DataFrame, s: Setting, depth: int | str, exchange: str | None) -> DataFrame:
    return weighted(ind, range_weights(s.weights, s.targets, depth, s.index_all, s.index_seq, exchange, s.first_venue))


def avg_side(ind: DataFrame, s: Setting, depth: int | str = 0, cs: Reducer = "csmean") -> DataFrame:
    """Both sides' reduced values by themselves: ts, series, bid, ask."""
    out = _reduced(_scaled(_universe_rows(ind, s, depth, None), ["bid", "ask"]), s, cs, {"bid": "bid", "ask": "ask"}, depth)
    return out.select("ts", F.col("index_code").alias("series"), "bid", "ask")


def avg_imb(ind: DataFrame, s: Setting, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "csmean", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """Reduce each side with the universe's weights, transform, then the imbalance of the two."""
    out = _reduced(_scaled(_universe_rows(ind, s, depth, exchange), ["bid", "ask"]), s, cs, {"bid": "bid", "ask": "ask"}, depth)
    return _imbalanced(_transformed(out, ["bid", "ask"], ts), imb)


def avg_scale_imb(ind: DataFrame, s: Setting, ts: Transform, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "csmean") -> DataFrame:
    """``avg_imb`` with a transform that must be there."""
    return avg_imb(ind, s, imb, depth, cs, ts)


def sum_imb(ind: DataFrame, s: Setting, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "cssum", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """``avg_imb`` by a sum, with 1/N over the members on the venue alone."""
    venue = replace(s, weights=on_venue(s.weights, exchange, s.first_venue), universe=s.universe if s.universe is not None else s.weights)
    return avg_imb(ind, venue, imb, depth, cs, ts)


def _over_depth(factor: DataFrame, s: Setting, depth: int) -> DataFrame:
    """Mean over each target's downscale indexes of the values they have."""
    pairs = [(t, m) for t in s.targets for m in downscale(s.index_seq, t, depth)]
    members = F.broadcast(factor.sparkSession.createDataFrame(pairs, "target string, series string"))  # targets * depth rows
    return factor.join(members, "series").groupBy("ts", "target").agg(F.avg("value").alias("value")).select("ts", F.col("target").alias("series"), "value")


def _raw(s: Setting, depth: int | str, exchange: str | None = None) -> DataFrame:
    columns = ("index_code", "trade_date", "symbol", "weight")
    if depth == "all":
        return range_weights(s.weights, s.targets, "all", s.index_all, s.index_seq, exchange, s.first_venue, raw_complement=True).select(*columns)
    return on_venue(s.weights.where(F.col("index_code").isin(s.index_seq)).select(*columns), exchange, s.first_venue)


def _indexes(s: Setting, depth: int | str) -> list[str]:
    """Whose values ``_raw`` gives."""
    return s.targets if depth == "all" else s.index_seq


def wavg_imb(ind: DataFrame, s: Setting, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "csmean", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """Each side and index reduced with renormalised weights, imbalance, then the mean over the downscale indexes."""
    out = _renormalized_reduced(weighted(ind, _raw(s, depth, exchange)), s, cs, ["bid", "ask"], _indexes(s, depth))
    out = _imbalanced(_transformed(out, ["bid", "ask"], ts), imb)
    return out if depth == "all" else _over_depth(out, s, depth)


def _stock_imbalance(ind: DataFrame, imb: str, ts: Transform | None = None) -> DataFrame:
    stock = ind.select("ts", "symbol", IMBALANCE[imb](F.col("bid"), F.col("ask")).alias("value"))
    return _transformed(stock, ["value"], ts, "symbol")


def _weighted_value(stock: DataFrame, weights: DataFrame, s: Setting, cs: Reducer, indexes: list[str] | None = None) -> DataFrame:
    return _renormalized_reduced(weighted(stock, weights), s, cs, ["value"], indexes).select("ts", F.col("index_code").alias("series"), "value")


def imb_wavg(ind: DataFrame, s: Setting, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "csmean", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """Imbalance per symbol first, then reduced as in ``wavg_imb``."""
    out = _weighted_value(_stock_imbalance(ind, imb, ts), _raw(s, depth, exchange), s, cs, _indexes(s, depth))
    return out if depth == "all" else _over_depth(out, s, depth)


def imb_avg(ind: DataFrame, s: Setting, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "csmean", ts: Transform | None = None) -> DataFrame:
    """Imbalance per symbol, then reduced over the universe, all members alike."""
    universe = range_weights(s.weights, s.targets, depth, s.index_all, s.index_seq).withColumn("weight", F.lit(1.0))
    return _weighted_value(_stock_imbalance(ind, imb, ts), universe, s, cs)


def imb_csf(ind: DataFrame, s: Setting, imb: str = "imb01", cs: Reducer = "csmean") -> DataFrame:
    """Imbalance per symbol with the raw weights of every loaded index, then a reducer."""
    rows = weighted(_stock_imbalance(ind, imb), s.weights.select("index_code", "trade_date", "symbol", "weight"))
    if cs == "csmean":
        return weighted_mean(rows, ["value"]).select("ts", F.col("index_code").alias("series"), "value")
    return reduce_cross_section(renormalized(rows, "value"), cs, ["ts", "index_code"], {"value": "value"}).select("ts", F.col("index_code").alias("series"), "value")


def _self_rows(ind: DataFrame, s: Setting, minute_weights: DataFrame, depth: int | str | None, exchange: str | None) -> DataFrame:
    rows = weighted(ind, minute_weights.select("index_code", "ts", "symbol", "weight"), minute=True)
    if depth is None:
        return rows
    universe = range_weights(s.weights, s.targets, depth, s.index_all, s.index_seq, exchange, s.first_venue, raw_complement=True).where("weight > 0").select("index_code", F.col("trade_date").alias("day"), "symbol").distinct()
    return rows.withColumn("day", F.to_date("ts")).join(universe, ["index_code", "day", "symbol"], "left_semi")


def selfwavg_imb(ind: DataFrame, s: Setting, minute_weights: DataFrame, imb: str = "imb01", depth: int | str | None = None, cs: Reducer = "csmean", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """Sides reduced with minute weights of one's own; with a depth, kept to the universe and its venue."""
    out = _renormalized_reduced(_self_rows(ind, s, minute_weights, depth, exchange), s, cs, ["bid", "ask"])
    return _imbalanced(_transformed(out, ["bid", "ask"], ts), imb)


def selfavg_imb(ind: DataFrame, s: Setting, minute_weights: DataFrame, imb: str = "imb01", depth: int | str | None = None, cs: Reducer = "csmean", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """As ``selfwavg_imb``, every positive minute weight counting alike."""
    return selfwavg_imb(ind, s, minute_weights.where("weight > 0").withColumn("weight", F.lit(1.0)), imb, depth, cs, ts, exchange)


def subset_wavg_imb(ind: DataFrame, s: Setting, minute_weights: DataFrame, depth: int | str = 0, cs: Reducer = "cssum", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """(bid - ask) of the universe's symbols with a positive minute weight over (bid + ask) of the whole universe.

    Both weights only select. Each side is reduced by ``cs`` (a sum, for the intended meaning) before the ratio.
    """
    rows = _universe_rows(ind, s, depth, exchange)
    marked = minute_weights.where("weight > 0").select("index_code", "ts", "symbol", F.lit(True).alias("chosen"))
    rows = rows.join(marked, ["index_code", "ts", "symbol"], "left")
    rows = rows.withColumns({"nb": F.when(F.col("chosen"), F.col("bid")), "na": F.when(F.col("chosen"), F.col("ask"))})
    out = _reduced(rows, s, cs, {"nb": "nb", "na": "na", "db": "bid", "da": "ask"}, depth)
    out = _transformed(out, ["nb", "na", "db", "da"], ts)
    return out.select("ts", F.col("index_code").alias("series"), IMBALANCE["imb09"](F.col("nb"), F.col("na"), F.col("db"), F.col("da")).alias("value"))


def norm_wavg_imb(ind: DataFrame, s: Setting, imb: str = "imb01", depth: int | str = 0, cs: Reducer = "csmean", ts: Transform | None = None, exchange: str | None = None) -> DataFrame:
    """Each symbol's sides as shares of their sum, weighted by the board's own weights within the universe."""
    both = F.col("bid") + F.col("ask")
    shares = ind.select("ts", "symbol", ratio(F.col("bid"), both).alias("bid"), ratio(F.col("ask"), both).alias("ask"))
    board = on_venue(board_weights(s.weights, s.targets, depth, s.index_all, s.index_seq), exchange, s.first_venue)
    out = _renormalized_reduced(weighted(shares, board), s, cs, ["bid", "ask"])
    return _imbalanced(_transformed(out, ["bid", "ask"], ts), imb)


def fund_flow_metrics(ind: DataFrame, s: Setting, cs: Reducer, imb: str = "imb10", depth: int | str = 0, ts: Transform | None = None) -> DataFrame:
    """Flow per symbol times the universe's weight, then a cross-sectional metric of it."""
    stock = _stock_imbalance(ind, imb, ts)
    rows = weighted(stock, range_weights(s.weights, s.targets, depth, s.index_all, s.index_seq)).withColumn("value", F.col("value") * F.col("weight"))
    return _reduced(rows, s, cs, {"value": "value"}, depth).select("ts", F.col("index_code").alias("series"), "value")


AGGREGATORS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (avg_side, avg_imb, avg_scale_imb, sum_imb, wavg_imb, imb_wavg, imb_avg, imb_csf, selfwavg_imb, selfavg_imb, subset_wavg_imb, norm_wavg_imb, fund_flow_metrics)}


def mean_by_row(panel: DataFrame, value: Column | str = "value") -> DataFrame:
    """Mean of the values of each time."""
    return panel.groupBy("ts").agg(F.avg(value).alias("value"))


