"""Generation specs: which factors a run makes, from YAML, TOML or a dict."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from .naming import parameter_grid, transform_name


@dataclass
class Aggregation:
    """One aggregator with its parameters; ``ts`` names a transform within it."""

    name: str
    aggregation: str
    downscale_depth: int | str | None = 0
    imb: str = "imb01"
    cs: str = "csmean"
    cs_prs: dict = field(default_factory=dict)
    ts: str | None = None
    ts_prs: dict = field(default_factory=dict)
    exchange: str | None = None


@dataclass
class Step:
    """One transform with fixed parameters."""

    name: str
    function: str
    parameters: dict


@dataclass
class Second:
    """A transform of first-layer results; no ``base`` means all of them, and the untransformed factor always."""

    step: Step
    base: list[str]


@dataclass
class Spec:
    target_indexes: list[str]
    index_all: str
    index_seq: list[str]
    aggregations: list[Aggregation]
    steps: list[Step]
    second: list[Second]
    save_org: bool = True
    save_first_layer: bool = True


def _steps(function: str, lists: dict | None) -> list[Step]:
    lists = {k: v if isinstance(v, list) else [v] for k, v in (lists or {}).items()}
    return [Step(transform_name(function, p, lists), function, p) for p in parameter_grid(lists)]


def parsed(spec: dict) -> Spec:
    targets = list(spec["target_indexes"])
    aggregations = [Aggregation(name, **{k: v for k, v in body.items()}) for name, body in (spec.get("aggregation") or {}).items()]
    steps = [s for function, lists in (spec.get("ts") or {}).items() for s in _steps(function, lists)]
    second = []
    for function, body in (spec.get("ts_second_layer") or {}).items():
        for step in _steps(function, body.get("params")):
            named = body.get("base_ts") or []
            base = [s.name for s in steps if not named or s.name in named or s.function in named]
            second.append(Second(step, base))
    return Spec(targets, spec["index_all"], list(spec.get("index_seq") or targets), aggregations, steps, second, spec.get("save_org", True), spec.get("save_first_layer", True))


def loaded(path: str) -> dict:
    """A spec or batch file as a dict, by its ending."""
    file = Path(path)
    if file.suffix == ".toml":
        return tomllib.loads(file.read_text())
    if file.suffix == ".json":
        return json.loads(file.read_text())
    import yaml

    return yaml.safe_load(file.read_text())


def path_edges(paths: list[list[str]]) -> list[tuple[str | None, str, str]]:
    """(parent, spec, node) of transform paths; paths that begin alike share their nodes, parents come first."""
    edges: dict[str, tuple[str | None, str, str]] = {}
    for path in paths:
        parent = None
        for spec in path:
            node = spec if parent is None else f"{parent}_TS_{spec}"
            edges.setdefault(node, (parent, spec, node))
            parent = node
    return list(edges.values())


def terminal_nodes(paths: list[list[str]]) -> list[str]:
    return sorted({"_TS_".join(p) for p in paths})


def paths_json(paths: list[list[str]], path: str) -> None:
    """Writes the terminal nodes of transform paths."""
    Path(path).write_text(json.dumps(terminal_nodes(paths), ensure_ascii=False, indent=1))


def _toml(value: object) -> str:
    """A TOML value; strings, booleans, numbers, lists and tables (None has no form)."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(str(k), ensure_ascii=False)} = {_toml(v)}" for k, v in value.items() if v is not None) + "}"
    if isinstance(value, (int, float)):
        return repr(value)
    raise TypeError(f"{value!r} has no TOML form")


def batch_toml(specs: list[dict], n_workers: int = 1, mode: str = "init") -> str:
    """A batch file of generation specs; absent (None) values are left out."""
    lines = [f"n_workers = {n_workers}", f"mode = {_toml(mode)}"]
    for spec in specs:
        lines += ["", "[[factors]]", *(f"{json.dumps(k, ensure_ascii=False)} = {_toml(v)}" for k, v in spec.items() if v is not None)]
    return "\n".join(lines) + "\n"
