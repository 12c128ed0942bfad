"""Index universes: which symbols stand for an index on a day, and with what weight.

Weights are rows (index_code, trade_date, symbol, weight) of non-zero weight. ``depth`` 0 is the
index by itself, a number merges that many narrower indexes behind it in ``index_seq``, and 'all' is
the board less every index before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First characters of the symbols of the first venue.
FIRST_VENUE = ("5", "6")


def clean_weights(weights: DataFrame, dropped_suffix: str = ".XBEI") -> DataFrame:
    """Without symbols of one venue, and with zero weights as absent."""
    return weights.where(~F.col("symbol").endswith(dropped_suffix) & (F.col("weight") != 0))


def lagged(weights: DataFrame) -> DataFrame:
    """Each day's weights apply from the next day that has any."""
    days = weights.select("index_code", "trade_date").distinct()
    following = days.withColumn("next_date", F.lead("trade_date").over(Window.partitionBy("index_code").orderBy("trade_date")))
    return weights.join(following, ["index_code", "trade_date"]).where("next_date is not null").withColumn("trade_date", F.col("next_date")).drop("next_date")


def equal_weights(weights: DataFrame) -> DataFrame:
    """1 / members of the day for each positive weight."""
    members = Window.partitionBy("index_code", "trade_date")
    return weights.where("weight > 0").withColumn("weight", 1.0 / F.count("*").over(members))


def downscale(index_seq: list[str], index: str, depth: int) -> list[str]:
    at = index_seq.index(index)
    return index_seq[at : at + depth + 1]


def narrower(index_seq: list[str], index: str) -> list[str]:
    return index_seq[: index_seq.index(index)]


def merged(weights: DataFrame, name: str, indexes: list[str]) -> DataFrame:
    """Members of any of ``indexes``, with weight 1."""
    return weights.where(F.col("index_code").isin(indexes) & (F.col("weight") > 0)).select(F.lit(name).alias("index_code"), "trade_date", "symbol").distinct().withColumn("weight", F.lit(1.0))


def without(weights: DataFrame, others: DataFrame) -> DataFrame:
    """Weights of symbols that no positive weight of ``others`` names on that day."""
    return weights.join(others.where("weight > 0").select("trade_date", "symbol").distinct(), ["trade_date", "symbol"], "left_anti").select("index_code", "trade_date", "symbol", "weight")


def within(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights of symbols that the universe of the same index names on that day."""
    return weights.join(universe.where("weight > 0").select("index_code", "trade_date", "symbol").distinct(), ["index_code", "trade_date", "symbol"], "left_semi").select("index_code", "trade_date", "symbol", "weight")


def complement(weights: DataFrame, name: str, index_all: str, index_seq: list[str]) -> DataFrame:
    board = weights.where(F.col("index_code") == index_all).withColumn("index_code", F.lit(name))
    others = weights.where(F.col("index_code").isin([i for i in narrower(index_seq, name) if i != index_all]))
    return without(board, others)


def on_venue(weights: DataFrame, exchange: str | None, first: tuple[str, ...] = FIRST_VENUE) -> DataFrame:
    """'SH': symbols of the first venue; 'SZ': the others; none: all."""
    if exchange in (None, "all"):
        return weights
    starts = F.substring("symbol", 1, 1).isin(*first)
    return weights.where(starts if exchange == "SH" else ~starts)


def each_target(of: dict[str, Column]) -> Column:
    """Gives a row to each target whose condition it meets, so that all of them come from one scan."""
    return F.explode(F.array_compact(F.array(*(F.when(condition, F.lit(target)) for target, condition in of.items()))))


def range_weights(weights: DataFrame, targets: list[str], depth: int | str, index_all: str, index_seq: list[str], exchange: str | None = None, first: tuple[str, ...] = FIRST_VENUE, raw_complement: bool = False) -> DataFrame:
    """Weights of each target at ``depth``: 1/N of its own, 1 of a merger, or the complement's."""
    columns = ["index_code", "trade_date", "symbol", "weight"]
    normal = equal_weights(weights)
    if depth == 0:
        out = normal.where(F.col("index_code").isin(targets)).select(*columns)
    elif depth == "all":
        source = weights if raw_complement else normal
        named = source.where((F.col("weight") > 0) & (F.col("index_code") != index_all)).groupBy("trade_date", "symbol").agg(F.collect_set("index_code").alias("of"))  # a handful of indexes
        board = source.where(F.col("index_code") == index_all).drop("index_code").join(named, ["trade_date", "symbol"], "left")
        behind = {t: F.coalesce(F.arrays_overlap("of", F.lit([i for i in narrower(index_seq, t) if i != index_all] or [""])), F.lit(False)) for t in targets}
        out = board.withColumn("index_code", each_target({t: ~within_ for t, within_ in behind.items()})).select(*columns)
    elif isinstance(depth, int):
        members = {t: F.col("index_code").isin(downscale(index_seq, t, depth)) for t in targets}
        out = weights.where("weight > 0").select(each_target(members).alias("index_code"), "trade_date", "symbol").distinct().withColumn("weight", F.lit(1.0))
    else:
        raise NotImplementedError(f"depth {depth!r}")
    return on_venue(out, exchange, first)


def board_weights(weights: DataFrame, targets: list[str], depth: int | str, index_all: str, index_seq: list[str]) -> DataFrame:
    """The board's own weights, kept to the universe of each target."""
    board = weights.where(F.col("index_code") == index_all).drop("index_code")
    named = board.crossJoin(F.broadcast(board.sparkSession.createDataFrame([(t,) for t in targets], "index_code string")))  # a handful of targets
    return within(named.select("index_code", "trade_date", "symbol", "weight"), range_weights(weights, targets, depth, index_all, index_seq))


def filled_minute_weights(weights: DataFrame, limit: int = 240, least: float = 0.0, mean_of: int | None = None) -> DataFrame:
    """Minute weights carried over up to ``limit`` rows of their grid, optionally averaged, and kept from ``least`` on.

    ``weights`` is a dense grid (index_code, ts, symbol, weight); what falls short, and 0, becomes null.
    """
    by_symbol = Window.partitionBy("index_code", "symbol").orderBy("ts")
    w = weights.withColumn("weight", F.last("weight", ignorenulls=True).over(by_symbol.rowsBetween(-limit, 0)))
    if mean_of:
        frame = by_symbol.rowsBetween(1 - mean_of, 0)
        w = w.withColumn("weight", F.when(F.count("weight").over(frame) >= mean_of, F.avg("weight").over(frame)))
    return w.withColumn("weight", F.when(F.col("weight") >= least, F.nullif(F.col("weight"), F.lit(0.0))))
