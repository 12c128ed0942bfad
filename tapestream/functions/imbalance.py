"""Imbalance of a bid and an ask value. Null wherever a side is null or a denominator is 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import ratio

IMBALANCE: dict[str, Callable[..., Column]] = {
    "imb01": lambda b, a: ratio(b - a, b + a),
    "imb02": lambda b, a: ratio(F.abs(b - a), F.abs(b) + F.abs(a)),
    "imb03": lambda b, a: ratio(a, b),
    "imb04": lambda b, a: ratio(a - b, F.greatest(a, b)),
    "imb05": lambda b, a: ratio(F.abs(a) - F.abs(b), F.abs(a) + F.abs(b)),
    "imb06": lambda b, a: a - b,
    "imb07": lambda b, a: ratio(a - b, F.abs(a) + F.abs(b)),
    "imb08": lambda b, a: (a + b) / 2,
    "imb09": lambda nb, na, db, da: ratio(nb - na, db + da),
    "imb10": lambda b, a: b - a,
    "add": lambda b, a: b + a,
}
