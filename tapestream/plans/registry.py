"""What a spec may name, and how users add their own: imbalances, reducers, transforms and aggregators."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import recursive, technical  # noqa: F401  register their transforms
from ..functions.cross_section import REDUCERS, TWO_PASS
from ..functions.imbalance import IMBALANCE
from ..functions.rolling import TRANSFORMS, transform
from ..operators.aggregate import AGGREGATORS

KINDS: dict[str, dict[str, Callable]] = {"imb": IMBALANCE, "cs": REDUCERS, "ts": TRANSFORMS, "aggregation": AGGREGATORS}


def register(kind: str, name: str, function: Callable, replace: bool = False, two_pass: bool = False) -> None:
    """Adds a function under a name that specs can use.

    ``imb``: (bid, ask) to a column. ``cs``: (x, mean of x, size of the universe, parameters) to an
    aggregate; with ``two_pass`` the group's mean is there, otherwise null. ``ts``: (frame, x, out,
    parameters) to the frame with a column ``out``. ``aggregation``: (ind, setting, parameters) to
    ts, series, value. A name that is taken is an error unless ``replace``.
    """
    if kind not in KINDS:
        raise ValueError(f"{kind!r} is none of {', '.join(KINDS)}")
    if name in KINDS[kind] and not replace:
        raise ValueError(f"there is a {kind} {name!r} already")
    if two_pass and kind != "cs":
        raise ValueError("only reducers have two passes")
    if kind == "ts":
        function.__name__ = name
        transform(function)
        return
    KINDS[kind][name] = function
    if kind == "cs":
        (TWO_PASS.add if two_pass else TWO_PASS.discard)(name)


def unregister(kind: str, name: str) -> None:
    KINDS[kind].pop(name)
    if kind == "cs":
        TWO_PASS.discard(name)
