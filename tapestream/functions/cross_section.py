"""Cross-sectional reducers: a panel column to one value per group.

``reduce_cross_section`` takes the name of a reducer. Deviations from the mean need a second pass:
the mean comes from a window over the same keys, so both passes share one exchange. Shares of the
universe divide by its column count, in which cells without a value count too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import ratio

EPSILON = 1e-10


def _share(condition: Column, universe: Column) -> Column:
    return ratio(F.count_if(condition), universe)


def _breadth(x: Column) -> Column:
    return ratio(F.count_if(x > 0) - F.count_if(x < 0), F.count(x))


def _hhi(x: Column) -> Column:
    """Sum of squared shares of the absolute total; null where that isn't positive."""
    total = F.sum(F.abs(x))
    return F.when(total > 0, F.sum(x * x) / (total * total))


def _side(x: Column, sign: int) -> Column:
    return F.when(x * sign > 0, F.abs(x)).when(x.isNotNull(), F.lit(0.0))


def _entropy(x: Column) -> Column:
    """Entropy of ten equal bins on [0, 1], the last one closed."""
    bin_of = F.when(x.between(0, 1), F.least(F.floor(x * 10), F.lit(9)))
    counts = [F.count_if(bin_of == k) for k in range(10)]
    total = F.count(bin_of)
    shares = [F.when(total > 0, c / total + EPSILON) for c in counts]
    norm = sum(shares[1:], shares[0])
    terms = [-(s / norm) * F.ln(s / norm) for s in shares]
    return sum(terms[1:], terms[0])


def _gini(x: Column) -> Column:
    ordered = F.array_sort(F.collect_list(x))
    n = F.size(ordered)
    weighted = F.aggregate(F.transform(ordered, lambda v, i: v * (n - i)), F.lit(0.0), lambda a, v: a + v)
    total = F.aggregate(ordered, F.lit(0.0), lambda a, v: a + v)
    return F.when((n == 0) | (total <= 0), 0.0).otherwise((n + 1 - 2 * weighted / total) / n)


def _iqr(x: Column) -> Column:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    return q[1] - q[0]


#: name: (x, mean of x over the group, size of the universe) to an aggregate.
REDUCERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "csmean": lambda x, m, u: F.avg(x),
    "cssum": lambda x, m, u: F.coalesce(F.sum(x), F.lit(0.0)),
    "cs_adjusted_cv": lambda x, m, u: 1 - F.stddev_pop(F.abs(x - 0.5)) / (F.avg(F.abs(x - 0.5)) + EPSILON),
    "cs_direction_consistency": lambda x, m, u: _share(x > 0.5, u) - _share(x < 0.5, u),
    "cs_polarization": lambda x, m, u: F.avg(F.abs(x - 0.5)),
    "cs_concentration": lambda x, m, u: 1 - F.avg(F.abs(x - m)) / 0.5,
    "cs_direction": lambda x, m, u: (F.avg(x) - 0.5) * 2,
    "cs_consensus_strength": lambda x, m, u: F.avg(x - 0.5) * 2,
    "cs_skewness": lambda x, m, u: F.skewness(x),
    "cs_kurtosis": lambda x, m, u: F.kurtosis(x) + 3,
    "cs_entropy": lambda x, m, u: _entropy(x),
    "cs_gini": lambda x, m, u: _gini(x),
    "cs_iqr": lambda x, m, u: _iqr(x),
    "cs_mad": lambda x, m, u: F.avg(F.abs(x - m)),
    "cs_consensus_index": lambda x, m, u: (F.avg(x) - 0.5) / 0.5 * (1 - F.avg(F.abs(x - m)) / 0.5),
    "cs_above_threshold": lambda x, m, u, threshold=0.5: _share(x > threshold, u),
    "cs_below_threshold": lambda x, m, u, threshold=0.5: _share(x < threshold, u),
    "cs_breadth": lambda x, m, u: _breadth(x),
    "cs_hhi": lambda x, m, u: _hhi(x),
    "cs_hhi_positive": lambda x, m, u: _hhi(_side(x, 1)),
    "cs_hhi_negative": lambda x, m, u: _hhi(_side(x, -1)),
    "cs_breadth_positive": lambda x, m, u: ratio(F.count_if(x > 0), F.count(x)),
    "cs_breadth_negative": lambda x, m, u: ratio(F.count_if(x < 0), F.count(x)),
    "cs_diffusion_positive": lambda x, m, u: ratio(F.count_if(x > 0), F.count(x)) * (1 - _hhi(_side(x, 1))),
    "cs_diffusion_negative": lambda x, m, u: ratio(F.count_if(x < 0), F.count(x)) * (1 - _hhi(_side(x, -1))),
}
#: A reducer's name, or its name and parameters.
Reducer = str | tuple[str, dict]
#: Reducers that need the group's mean first.
TWO_PASS = {"cs_concentration", "cs_mad", "cs_consensus_index"}


def reduce_cross_section(panel: DataFrame, name: Reducer, keys: list[str], values: dict[str, str], universe: Column | None = None, **params) -> DataFrame:
    """One row per ``keys`` with a reduced column for each of ``values`` (output name: input column).

    ``universe`` is the number of columns of the cross-section, constant per group; by default the
    group's rows count.
    """
    if not isinstance(name, str):
        name, own = name
        params = own | params
    size = F.count("*") if universe is None else F.max(universe)
    if name in TWO_PASS:
        over = Window.partitionBy(*keys)
        panel = panel.withColumns({f"__mean_{x}": F.avg(x).over(over) for x in set(values.values())})
    reduce = REDUCERS[name]
    return panel.groupBy(*keys).agg(*(reduce(F.col(x), F.col(f"__mean_{x}") if name in TWO_PASS else F.lit(None), size, **params).alias(out) for out, x in values.items()))


def hhi_weighted(panel: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Concentration of value / weight over cells with a positive weight."""
    x = F.when(F.col(weight) > 0, ratio(F.col(value), F.col(weight)))
    return panel.groupBy(*keys).agg(_hhi(x).alias("value"))
