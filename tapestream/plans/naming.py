"""Names and parameter grids of transforms."""

from __future__ import annotations

from itertools import product


def parameter_grid(lists: dict[str, list]) -> list[dict]:
    """All combinations of parameter lists, the last list fastest."""
    return [dict(zip(lists, values, strict=True)) for values in product(*lists.values())]


def abbreviations(names: list[str]) -> dict[str, str]:
    """Shortest prefix of each name that no earlier name has taken, in the order given."""
    taken: dict[str, str] = {}
    for name in names:
        short = next((name[:n] for n in range(1, len(name) + 1) if name[:n] not in taken.values()), name)
        taken[name] = short
    return taken


def transform_name(function: str, parameters: dict, grid: dict[str, list] | None = None) -> str:
    """function_p1v1_p2v2 with abbreviated parameter names."""
    short = abbreviations(list(grid or parameters))
    return "_".join([function, *(f"{short[k]}{v}" for k, v in parameters.items())])
