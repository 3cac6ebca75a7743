"""Requests: metrics, dimensions, filters, order and limit, checked for form."""

from __future__ import annotations

from dataclasses import dataclass, field

from quernel.errors import EngineError
from quernel.model import check_leaf

ORDERED = {"gt", "gte", "lt", "lte", "between"}
MOST_DEPTH, MOST_NODES, MOST_LEAVES = 8, 128, 64


@dataclass(frozen=True)
class DimensionRef:
    name: str
    grain: str | None = None
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name.rpartition(".")[2]


@dataclass(frozen=True)
class Request:
    metrics: tuple[str, ...] = ()
    dimensions: tuple[DimensionRef, ...] = ()
    filters: tuple[dict, ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    intent: str | None = None
    extra: dict = field(default_factory=dict)


def _check(node: dict, depth: int, counts: list[int], root: bool) -> None:
    counts[0] += 1
    if depth > MOST_DEPTH or counts[0] > MOST_NODES or counts[1] > MOST_LEAVES:
        raise EngineError("FILTER_TOO_LARGE", "too many or too deep predicates")
    inner = [k for k in ("and", "or", "not", "exists") if k in node]
    if inner:
        if len(node) != 1:
            raise EngineError("INVALID_FILTER", str(sorted(node)))
        kind = inner[0]
        if kind == "exists":
            if not root:
                raise EngineError("INVALID_EXISTS", "only at the root of the filters")
            if set(node["exists"]) - {"relationship", "filters"}:
                raise EngineError("INVALID_FILTER", "exists")
            for x in node["exists"].get("filters", []):
                _check(x, depth + 1, counts, False)
            return
        children = [node["not"]] if kind == "not" else node[kind]
        if kind != "not" and not 2 <= len(children) <= 32:
            raise EngineError("INVALID_FILTER", f"{kind} takes 2 to 32 parts")
        for x in children:
            _check(x, depth + 1, counts, False)
        return
    counts[1] += 1
    check_leaf(node)


def parse(given: dict) -> Request:
    known = {"metrics", "dimensions", "filters", "order_by", "limit", "intent"}
    if extra := set(given) - known:
        raise EngineError("UNKNOWN_KEY", ", ".join(sorted(extra)))
    dims = [DimensionRef(d) if isinstance(d, str) else DimensionRef(**d) for d in given.get("dimensions", [])]
    order = [(o, "asc") if isinstance(o, str) else (o["field"], o.get("direction", "asc")) for o in given.get("order_by", [])]
    out = Request(tuple(given.get("metrics", [])), tuple(dims), tuple(given.get("filters", [])), tuple(order), given.get("limit"), given.get("intent"))
    if not out.metrics and not out.dimensions:
        raise EngineError("EMPTY_REQUEST", "no metrics or dimensions")
    if out.limit is not None and (not isinstance(out.limit, int) or out.limit <= 0):
        raise EngineError("INVALID_LIMIT", str(out.limit))
    if len(set(out.metrics)) < len(out.metrics) or len({d.label for d in dims}) < len(dims):
        raise EngineError("DUPLICATE_OUTPUT", "a metric or dimension twice")
    if any(d not in ("asc", "desc") for _, d in order):
        raise EngineError("INVALID_ORDER", str(order))
    counts = [0, 0]
    for f in out.filters:
        _check(f, 1, counts, True)
    if sum("exists" in f for f in out.filters) > 1:
        raise EngineError("INVALID_EXISTS", "only one")
    if out.intent == "distinct_values" and (out.metrics or len(dims) != 1 or any(o != dims[0].label for o, _ in order)):
        raise EngineError("INVALID_INTENT", "distinct values take one dimension, no metrics and its order alone")
    return out
