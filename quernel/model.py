"""Business models: datasets with fields, relationships between them, calendars and metrics."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from quernel.errors import EngineError
from quernel.functions.expressions import Call, aggregates, counts_rows, names_in, outside

GRAINS = ("year", "quarter", "month", "week", "day", "hour")
TYPES = {"string": "string", "integer": "bigint", "decimal": "decimal(38,18)", "float": "double", "boolean": "boolean", "date": "date", "time": "time", "datetime": "timestamp_ntz", "datetimetz": "timestamp", "opaque": None}


@dataclass(frozen=True)
class Field:
    name: str
    expr: str = ""
    type: str = "opaque"
    dimension: bool = True
    about: dict | None = None


@dataclass(frozen=True)
class Grain:
    """A custom grain: the field that names the bucket, the one that numbers it without gaps, and the coarser grain."""

    name: str
    bucket: str
    ordinal: str
    dense: bool = True
    parent: str | None = None


@dataclass(frozen=True)
class Dataset:
    name: str
    source: str
    fields: dict[str, Field]
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    grains: dict[str, Grain] = field(default_factory=dict)
    base_time: str | None = None
    about: dict | None = None

    def unique_on(self, columns: tuple[str, ...]) -> bool:
        return any(k and set(k) == set(columns) for k in (self.primary_key, *self.unique_keys))


@dataclass(frozen=True)
class Relationship:
    """An equi-join edge; with `event`, `valid_from` and `valid_to` a point-in-time one."""

    name: str
    left: str
    right: str
    left_columns: tuple[str, ...]
    right_columns: tuple[str, ...]
    event: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None

    @property
    def temporal(self) -> bool:
        return self.event is not None


@dataclass(frozen=True)
class Spine:
    dataset: str
    field: str
    grains: tuple[str, ...] = GRAINS[:5]


@dataclass(frozen=True)
class Metric:
    """An aggregate over fields, an expression over metrics, or one of the special kinds named by their option.

    where: a filter or a list of them that belong to the metric; stage: pre_aggregation (of its rows) or
    post_aggregation (of its own values). dataset: whose rows COUNT(*) counts. algebra: how results of an
    aggregate merge that the engine knows nothing of: sum, min or max; duplicates: whether it is sensitive to them.
    about: description, aliases, owner, lifecycle, certification, replacement; and what reviewers expect: type, aggregation.
    """

    name: str
    expr: str = ""
    type: str = "decimal"
    time: str | None = None
    fill_zero: bool = False
    scale: str | None = None
    where: dict | list | None = None
    stage: str | None = None
    dataset: str | None = None
    cumulative: dict | None = None
    offset: dict | None = None
    offset_to_grain: dict | None = None
    semi_additive: dict | None = None
    conversion: dict | None = None
    algebra: str | None = None
    duplicates: str = "sensitive"
    about: dict | None = None

    @property
    def filters(self) -> tuple[dict, ...]:
        return tuple(self.where) if isinstance(self.where, list) else (self.where,) if self.where else ()

    @property
    def post(self) -> tuple[dict, ...]:
        """The definition filters on its own values."""
        own = self.stage == "post_aggregation" or self.stage is None and self.where and all(f.get("field") == self.name for f in self.filters)
        return self.filters if own else ()

    @property
    def pre(self) -> tuple[dict, ...]:
        return () if self.post else self.filters


OPERATORS = {"eq": 1, "neq": 1, "gt": 1, "gte": 1, "lt": 1, "lte": 1, "in": None, "not_in": None, "between": 2, "is_null": 0, "is_not_null": 0}


def check_leaf(f: dict) -> None:
    """A filter of a field, an operator and as many values as it takes."""
    values = f.get("values", [])
    if set(f) - {"field", "op", "values"} or not f.get("field") or f.get("op") not in OPERATORS:
        raise EngineError("INVALID_FILTER", str(f))
    n = OPERATORS[f["op"]]
    if not isinstance(values, list | tuple) or (not values if n is None else len(values) != n):
        raise EngineError("INVALID_FILTER", f"{f['op']} with {values!r}")


ABOUT = {"description", "aliases", "owner", "lifecycle", "certification", "replacement", "expects"}


class Model:
    """Indexes of a model, checked when it is made."""

    def __init__(self, name: str, datasets: list[Dataset], relationships: list[Relationship] = (), metrics: list[Metric] = (), spine: Spine | None = None):
        self.name, self.spine = name, spine
        self.datasets = _index("dataset", datasets)
        self.relationships = _index("relationship", relationships)
        self.metrics = _index("metric", metrics)
        for r in self.relationships.values():
            for side, columns in ((r.left, r.left_columns), (r.right, r.right_columns)):
                if side not in self.datasets:
                    raise EngineError("UNKNOWN_DATASET", side)
                for c in columns:
                    self.field(f"{side}.{c}")
            if len(r.left_columns) != len(r.right_columns) or not r.left_columns:
                raise EngineError("INVALID_RELATIONSHIP", r.name)
        for m in self.metrics:
            self.kind(m)
            self.closure([m])
            self._check_pick(m)
            self._check_filters(m)
            self._check_algebra(m)

    def _check_filters(self, name: str) -> None:
        """Definition filters are leaves: on fields, of a source metric, or on the metric's own values."""
        m = self.metrics[name]
        if m.stage not in (None, "pre_aggregation", "post_aggregation") or (m.stage or m.where is not None) and not m.filters:
            raise EngineError("INVALID_DEFINITION_FILTER", name)
        for f in m.filters:
            check_leaf(f)
        if any(f["field"] != name for f in m.post):
            raise EngineError("INVALID_DEFINITION_FILTER", f"{name} may filter no other values than its own")
        if m.pre and self.kind(name) != "source":
            raise EngineError("INVALID_DEFINITION_FILTER", f"{name} has no rows of its own to filter")
        for f in m.pre:
            self.field(f["field"])

    def _check_algebra(self, name: str) -> None:
        m = self.metrics[name]
        if m.duplicates not in ("sensitive", "insensitive"):
            raise EngineError("INVALID_ALGEBRA", name)
        if m.algebra is None:
            return
        calls = aggregates(m.expr) if self.kind(name) == "source" else []
        if m.algebra not in ("sum", "min", "max") or len(calls) != 1 or not calls[0].whole:
            raise EngineError("INVALID_ALGEBRA", f"{name}: only of one aggregate call")

    def merge_of(self, name: str) -> str | None:
        """How results of a source metric merge into coarser ones; None if they do not."""
        m, calls = self.metrics[name], aggregates(self.metrics[name].expr)
        return calls[0].merge or m.algebra if len(calls) == 1 and calls[0].whole else None

    def ignores_duplicates(self, name: str) -> bool:
        m = self.metrics[name]
        return m.duplicates == "insensitive" and m.algebra is not None or all(c.ignores_duplicates for c in aggregates(m.expr))

    def calls(self, name: str) -> list[Call]:
        return aggregates(self.metrics[name].expr)

    def _check_pick(self, name: str) -> None:
        """A pick over another pick chooses by the same time and tie break, with the same nulls, and over no rollup."""
        o = self.metrics[name].semi_additive
        inner = self.metric(o["metric"]).semi_additive if o else None
        if inner and (inner.get("groupings") or any(inner.get(k) != o.get(k) for k in ("time", "tie_break", "null_policy"))):
            raise EngineError("INVALID_SEMI_ADDITIVE", f"{name} over {o['metric']}")

    def field(self, name: str) -> tuple[Dataset, Field]:
        """By `dataset.field`, or by a bare name that one dataset has."""
        if "." in name:
            ds, _, f = name.partition(".")
            if ds in self.datasets and f in self.datasets[ds].fields:
                return self.datasets[ds], self.datasets[ds].fields[f]
            raise EngineError("UNKNOWN_FIELD", name)
        found = [(d, d.fields[name]) for d in self.datasets.values() if name in d.fields]
        if len(found) != 1:
            raise EngineError("AMBIGUOUS_FIELD" if found else "UNKNOWN_FIELD", name)
        return found[0]

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise EngineError("UNKNOWN_METRIC", name)
        return self.metrics[name]

    def kind(self, name: str) -> str:
        m = self.metric(name)
        special = [k for k in ("cumulative", "offset", "offset_to_grain", "semi_additive", "conversion") if getattr(m, k)]
        if len(special) > 1:
            raise EngineError("INVALID_METRIC", f"{name} has several kinds")
        if special:
            return special[0]
        calls = aggregates(m.expr)
        if any(c.inner for c in calls):
            raise EngineError("NESTED_AGGREGATE", name)
        if not calls:
            if not [x for x in names_in(m.expr) if x in self.metrics]:
                raise EngineError("INVALID_METRIC", f"{name} aggregates nothing")
            return "derived"
        if bare := [x for x in outside(m.expr) if x not in self.metrics]:
            raise EngineError("MIXED_AGGREGATE", f"{name} has {', '.join(bare)} outside its aggregates")
        return "source"

    def inputs(self, name: str) -> list[str]:
        m, kind = self.metric(name), self.kind(name)
        if kind == "derived":
            return list(dict.fromkeys(x for x in names_in(m.expr) if x in self.metrics))
        if kind == "conversion":
            return []
        return [] if kind == "source" else [getattr(m, kind)["metric"]]

    def closure(self, names: list[str]) -> list[str]:
        """The metrics and all that they need, inputs first."""
        out: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in out:
                return
            if n in open_:
                raise EngineError("METRIC_CYCLE", n)
            open_.add(n)
            for x in self.inputs(n):
                visit(x)
            open_.discard(n)
            out.append(n)

        for n in names:
            visit(n)
        return out

    def metric_datasets(self, name: str) -> list[str]:
        """Datasets that a source metric's expression reads, in order."""
        m = self.metric(name)
        out = list(dict.fromkeys(self.field(x)[0].name for x in names_in(m.expr) if "." in x or any(x in d.fields for d in self.datasets.values())))
        if counts_rows(m.expr):
            counted = m.dataset or (self.field(m.time)[0].name if m.time else None) or (out[0] if len(out) == 1 else None) or (next(iter(self.datasets)) if len(self.datasets) == 1 else None)
            if counted not in self.datasets:
                raise EngineError("INVALID_METRIC", f"{name} counts the rows of no one dataset")
            out = [counted, *[x for x in out if x != counted]]
        return out

    def time_of(self, name: str) -> str | None:
        """The time dimension a metric is bound to, its own or that of its inputs."""
        m = self.metric(name)
        if m.time:
            return m.time
        found = {t for t in map(self.time_of, self.inputs(name)) if t}
        if len(found) > 1:
            raise EngineError("CONFLICTING_TIME_BINDING", name)
        return found.pop() if found else None

    def path(self, start: str, end: str) -> list[tuple[Relationship, bool]]:
        """The one shortest path of relationships; the flag says whether an edge is walked from left to right."""
        if start == end:
            return []
        ways: dict[str, list[list[tuple[Relationship, bool]]]] = {start: [[]]}
        depth, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            if at == end:
                break
            for r in sorted(self.relationships.values(), key=lambda r: r.name):
                for a, b, ahead in ((r.left, r.right, True), (r.right, r.left, False)):
                    if a != at or b in depth and depth[b] <= depth[at]:
                        continue
                    if b not in depth:
                        depth[b] = depth[at] + 1
                        queue.append(b)
                    ways.setdefault(b, []).extend([*w, (r, ahead)] for w in ways[at])
        if end not in ways:
            raise EngineError("NO_RELATIONSHIP_PATH", f"{start} to {end}")
        if len(ways[end]) > 1:
            raise EngineError("AMBIGUOUS_RELATIONSHIP_PATH", f"{start} to {end}")
        return ways[end][0]

    def grain(self, name: str) -> tuple[Dataset, Grain] | None:
        for d in self.datasets.values():
            if name in d.grains:
                return d, d.grains[name]
        return None


def _index(kind: str, items: list) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for x in items:
        if x.name in out:
            raise EngineError(f"DUPLICATE_{kind.upper()}", x.name)
        out[x.name] = x
    return out


def _strict(cls: type, given: dict) -> dict:
    known = {f.name for f in fields(cls)}
    if extra := set(given.get("about") or ()) - ABOUT:
        raise EngineError("UNKNOWN_KEY", f"about: {', '.join(sorted(extra))}")
    if extra := set(given) - known:
        raise EngineError("UNKNOWN_KEY", f"{cls.__name__}: {', '.join(sorted(extra))}")
    return given


def load(document: dict | str | Path) -> Model:
    """A model from a dict, or from a JSON or YAML file; unknown keys are errors."""
    if not isinstance(document, dict):
        text = Path(document).read_text()
        try:
            document = json.loads(text)
        except ValueError:
            import yaml

            document = yaml.safe_load(text)
    if extra := set(document) - {"name", "datasets", "relationships", "metrics", "spine"}:
        raise EngineError("UNKNOWN_KEY", ", ".join(sorted(extra)))

    def dataset(d: dict) -> Dataset:
        items = [Field(**_strict(Field, {"name": f} if isinstance(f, str) else f)) for f in d.get("fields", [])]
        grains = {g["name"]: Grain(**_strict(Grain, g)) for g in d.get("grains", [])}
        keys = {"primary_key": tuple(d.get("primary_key", ())), "unique_keys": tuple(tuple(k) for k in d.get("unique_keys", ()))}
        return Dataset(**_strict(Dataset, d) | {"fields": _index("field", items), "grains": grains} | keys)

    def relationship(r: dict) -> Relationship:
        return Relationship(**_strict(Relationship, r) | {"left_columns": tuple(r["left_columns"]), "right_columns": tuple(r["right_columns"])})

    spine = document.get("spine")
    return Model(
        document["name"],
        [dataset(d) for d in document.get("datasets", [])],
        [relationship(r) for r in document.get("relationships", [])],
        [Metric(**_strict(Metric, m)) for m in document.get("metrics", [])],
        Spine(**_strict(Spine, spine) | ({"grains": tuple(spine["grains"])} if "grains" in spine else {})) if spine else None,
    )
