"""Exact quantiles of all rows, found by narrowing brackets; no task or driver ever holds the values.

Each round asks a mergeable sketch for values a little below, at and above the wanted ranks, counts exactly
how many rows lie below and at them, and keeps the side on which each rank lies. The value in the
middle leaves its bracket every time, so brackets shrink whatever the ties; the last few thousand rows
of a bracket are fetched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bracket that are fetched, and the sketch's accuracy (its ranks err by one in so many rows).
FETCHED, ACCURACY = 5_000, 10_000


@dataclass
class _Bracket:
    """Values from lo to hi, both included, among which the rank lies; ``below`` rows are less than lo, ``inside`` rows lie within."""

    rank: int
    lo: float
    hi: float
    below: int
    inside: int
    found: float | None = None


def _counts(rows: DataFrame, edges: list[float]) -> list[tuple[int, int]]:
    """Rows below each edge, and equal to it."""
    row = rows.agg(*(F.count_if(c).alias(f"{k}{i}") for i, e in enumerate(edges) for k, c in (("b", F.col("v") < e), ("e", F.col("v") == e)))).first()
    return [(row[f"b{i}"], row[f"e{i}"]) for i in range(len(edges))]


def _narrow(rows: DataFrame, brackets: list[_Bracket]) -> None:
    asked = []
    for i, b in enumerate(brackets):
        at = (b.rank - b.below + 0.5) / b.inside
        probes = [min(max(p, 0.0), 1.0) for p in (at - 2 / ACCURACY, at, at + 2 / ACCURACY)]
        asked.append(F.percentile_approx(F.when(F.col("v").between(b.lo, b.hi), F.col("v")), probes, ACCURACY).alias(f"q{i}"))
    sketched = rows.agg(*asked).first()
    edges = [float(e) for i in range(len(brackets)) for e in sketched[f"q{i}"]]
    counted = _counts(rows, edges)
    for i, b in enumerate(brackets):
        for e, (below, equal) in sorted(zip(edges[3 * i : 3 * i + 3], counted[3 * i : 3 * i + 3], strict=True)):
            if below <= b.rank < below + equal:
                b.found = e
                break
            if b.rank >= below + equal and e >= b.lo:  # the rank lies above
                b.inside -= below + equal - b.below
                b.lo, b.below = math.nextafter(e, math.inf), below + equal
            elif b.rank < below and e <= b.hi:
                b.inside = below - b.below
                b.hi = math.nextafter(e, -math.inf)
                break


def _fetched(rows: DataFrame, b: _Bracket) -> float:
    held = sorted(r["v"] for r in rows.where(F.col("v").between(b.lo, b.hi)).collect())  # at most FETCHED
    return held[b.rank - b.below]


def of_ranks(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The values of 0-based ranks among the rows with a value."""
    values = rows.select(F.nullif(F.col(column).cast("double"), F.lit(float("nan"))).alias("v")).where("v is not null").persist(StorageLevel.DISK_ONLY)
    try:
        n, lo, hi = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if any(not 0 <= r < n for r in ranks):
            raise ValueError(f"ranks go from 0 to {n - 1}")
        brackets = [_Bracket(r, lo, hi, 0, n) for r in sorted(set(ranks))]
        while open_ := [b for b in brackets if b.found is None]:
            small = [b for b in open_ if b.inside <= FETCHED or b.lo == b.hi]
            for b in small:
                b.found = b.lo if b.lo == b.hi else _fetched(values, b)
            if wide := [b for b in open_ if b.found is None]:
                _narrow(values, wide)
        return {b.rank: b.found for b in brackets}
    finally:
        values.unpersist()


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles of a column, linear between the two values beside each, as SQL's continuous percentile; null without a value.

    Runs at once: the rows are kept on the executors' disks while some passes count them.
    """
    n = rows.select(F.count(F.nullif(F.col(column).cast("double"), F.lit(float("nan"))))).first()[0]
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    held = of_ranks(rows, column, [int(f(p)) for p in places for f in (math.floor, math.ceil)])
    return [held[a] if a == b else (b - p) * held[a] + (p - a) * held[b] for p in places for a, b in [(math.floor(p), math.ceil(p))]]
