"""Requests to DataFrames.

Metrics are evaluated at the request's grain, inputs first. Source metrics that share root, joins
and filters come from one groupBy; special kinds evaluate their input and add windows, calendars or
picks; frames are aligned by full outer joins. Nothing is collected: the answer is one lazy plan,
and pruning, pushdown and join strategies are Catalyst's.
"""

from __future__ import annotations

import math
import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from datetime import time as clock
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quernel.errors import EngineError
from quernel.functions.expressions import names_in, only, over_metrics, renamed, spark_sql
from quernel.model import GRAINS, TYPES, Model, Relationship
from quernel.operators import frames, time
from quernel.plans.request import ORDERED, DimensionRef, Request, parse
from quernel.sources.tables import Tables

COARSER = {g: k for k, g in enumerate(GRAINS)}


@dataclass(frozen=True)
class Dim:
    label: str
    field: str  # dataset.field
    grain: str | None = None
    custom: bool = False
    periods: tuple[tuple[str, str, str], ...] = ()  # (name, start, stop): the name of the half-open period, null in none


@dataclass(frozen=True)
class Scope:
    dims: tuple[Dim, ...]
    filters: tuple[dict, ...]
    raw_time: bool = False

    @property
    def labels(self) -> list[str]:
        return [d.label for d in self.dims]


def column(name: str) -> str:
    return name.replace(".", "__")


def literal_type(value: str, kind: str) -> str:
    return "decimal(38,0)" if kind == "integer" and not -(1 << 63) <= int(value) < 1 << 63 else TYPES[kind]


def typed(value: str, kind: str) -> str:
    """The literal if it is one of the type, else INVALID_FILTER; numbers never take the way over a float."""
    try:
        match kind:
            case "integer":
                ok = re.fullmatch(r"[+-]?\d{1,38}", value)
            case "decimal":
                ok = Decimal(value).is_finite() and len(Decimal(value).as_tuple().digits) <= 38
            case "float":
                ok = math.isfinite(float(value))
            case "boolean":
                ok = value in ("true", "false")
            case "date":
                ok = datetime.fromisoformat(value) and re.match(r"\d{4}-\d\d-\d\d", value)
            case "time":
                ok = clock.fromisoformat(value).tzinfo is None
            case "datetime":
                ok = datetime.fromisoformat(value).tzinfo is None
            case "datetimetz":
                ok = datetime.fromisoformat(value)
            case _:
                ok = True
    except (ValueError, InvalidOperation):
        ok = False
    if not ok:
        raise EngineError("INVALID_FILTER", f"{value!r} is no {kind}")
    return value


class Engine:
    """policies: dataset -> SQL predicates over its source columns, applied at every read of it."""

    def __init__(self, model: Model, tables: Tables, policies: dict[str, list[str]] | None = None):
        self.model, self.tables, self.policies = model, tables, policies or {}

    # --- reading and joining ---------------------------------------------------------------------

    def dataset(self, name: str) -> DataFrame:
        d = self.model.datasets[name]
        df = reduce(lambda x, p: x.filter(p), self.policies.get(name, []), self.tables(d.source))
        return df.select(*[F.expr(f.expr or f"`{f.name}`").alias(f"{name}__{f.name}") for f in d.fields.values()])

    def name(self, given: str) -> str:
        d, f = self.model.field(given)
        return f"{d.name}.{f.name}"

    def joined(self, root: str, others: list[str], strict: bool = True) -> DataFrame:
        """Inner joins along the shortest paths; a target that is not unique on its key is rejected if strict."""
        df, there = self.dataset(root), {root}
        for end in others:
            at = root
            for edge, ahead in self.model.path(root, end):
                to = edge.right if ahead else edge.left
                if to not in there:
                    if strict and not self.safe(edge, ahead):
                        raise EngineError("UNSUPPORTED_RELATIONSHIP_FANOUT", f"{edge.name} from {at}")
                    df = df.join(self.dataset(to), self.condition(edge))
                    there.add(to)
                at = to
        return df

    def safe(self, edge: Relationship, ahead: bool) -> bool:
        to, columns = (edge.right, edge.right_columns) if ahead else (edge.left, edge.left_columns)
        return edge.temporal and ahead or self.model.datasets[to].unique_on(columns)

    def condition(self, edge: Relationship) -> Column:
        on = [F.col(f"{edge.left}__{a}") == F.col(f"{edge.right}__{b}") for a, b in zip(edge.left_columns, edge.right_columns, strict=True)]
        if edge.temporal:
            event = F.col(f"{edge.left}__{edge.event}")
            on.append(event >= F.col(f"{edge.right}__{edge.valid_from}"))
            on.append(F.coalesce(event < F.col(f"{edge.right}__{edge.valid_to}"), F.lit(True)))
        return reduce(lambda a, b: a & b, on)

    # --- predicates ------------------------------------------------------------------------------

    def literal(self, value: str, kind: str | None) -> Column:
        return F.lit(typed(value, kind)).cast(literal_type(value, kind)) if kind and TYPES.get(kind) else F.lit(value)

    def leaf(self, c: Column, f: dict, kind: str | None) -> Column:
        op = f["op"]
        if op in ORDERED and kind in ("boolean", "opaque"):
            raise EngineError("INVALID_FILTER", f"{op} on a {kind} field")
        values = [self.literal(str(v), kind) for v in f.get("values", [])]
        match op:
            case "eq":
                return c == values[0]
            case "neq":
                return c != values[0]
            case "gt":
                return c > values[0]
            case "gte":
                return c >= values[0]
            case "lt":
                return c < values[0]
            case "lte":
                return c <= values[0]
            case "in":
                return c.isin(*values)
            case "not_in":
                return ~c.isin(*values)
            case "between":
                return c.between(*values)
            case "is_null":
                return c.isNull()
        return c.isNotNull()

    def predicate(self, f: dict) -> Column:
        if "and" in f or "or" in f:
            parts = [self.predicate(x) for x in f.get("and") or f["or"]]
            return reduce(lambda a, b: a & b if "and" in f else a | b, parts)
        if "not" in f:
            return ~self.predicate(f["not"])
        d, fld = self.model.field(f["field"])
        return self.leaf(F.col(f"{d.name}__{fld.name}"), f, fld.type)

    def datasets_of(self, f: dict) -> set[str]:
        for k in ("and", "or"):
            if k in f:
                return set().union(*map(self.datasets_of, f[k]))
        if "not" in f:
            return self.datasets_of(f["not"])
        return {self.model.field(f["field"])[0].name}

    def check_tree(self, f: dict) -> None:
        if len(self.datasets_of(f)) > 1:
            raise EngineError("INVALID_FILTER", "a predicate tree reads one dataset")

    def is_metric_filter(self, f: dict) -> bool:
        return f.get("field") in self.model.metrics

    def exists(self, df: DataFrame, f: dict, root: str) -> DataFrame:
        e = f["exists"]
        edge = self.model.relationships.get(e["relationship"])
        if not edge or root not in (edge.left, edge.right):
            raise EngineError("INVALID_EXISTS", "the relationship does not touch the root")
        target = edge.right if edge.left == root else edge.left
        there = self.dataset(target)
        for x in e.get("filters", []):
            if self.datasets_of(x) != {target}:
                raise EngineError("INVALID_EXISTS", "predicates are on the target alone")
            there = there.filter(self.predicate(x))
        return df.join(there, self.condition(edge), "left_semi")

    # --- source aggregates -----------------------------------------------------------------------

    def dim_column(self, d: Dim) -> Column:
        c = F.col(column(d.field))
        if d.custom:
            return c
        if d.periods:
            kind = self.model.field(d.field)[1].type
            within = [F.when((c >= self.literal(a, kind)) & (c < self.literal(b, kind)), F.lit(x)) for x, a, b in d.periods]
            return F.coalesce(*within)
        return time.truncate(c, d.grain) if d.grain else c

    def root(self, name: str) -> str:
        own = self.model.metric_datasets(name)
        if not own:
            raise EngineError("INVALID_METRIC", f"{name} reads no dataset")
        for r in own:
            try:
                if all(self.safe(e, a) for o in own for e, a in self.model.path(r, o)):
                    return r
            except EngineError:
                continue
        return own[0]

    def work(self, name: str, scope: Scope, pre: tuple[dict, ...] | None = None) -> tuple:
        """What has to be equal for two source metrics to share a groupBy; `pre` stands for the metric's own filters."""
        pre = self.model.metric(name).pre if pre is None else pre
        root = self.root(name)
        needed = [*self.model.metric_datasets(name), *[d.field.split(".")[0] for d in scope.dims]]
        for f in [*scope.filters, *pre]:
            if "exists" not in f:
                needed += sorted(self.datasets_of(f))
        return root, tuple(x for x in dict.fromkeys(needed) if x != root), repr(pre), not self.model.ignores_duplicates(name)

    def rows(self, work: tuple, scope: Scope, pre: tuple[dict, ...]) -> DataFrame:
        root, others, _, strict = work
        df = self.joined(root, list(others), strict)
        for f in [*scope.filters, *pre]:
            if "exists" in f:
                df = self.exists(df, f, root)
            else:
                self.check_tree(f)
                df = df.filter(self.predicate(f))
        return df

    def sql(self, expr: str) -> Column:
        def to(name: str) -> str | None:
            try:
                return f"`{column(self.name(name))}`"
            except EngineError:
                return None

        return F.expr(renamed(spark_sql(expr), to))

    def shared(self, names: list[str], scope: Scope) -> tuple[dict[tuple, list[str]], dict[str, tuple]]:
        """Source metrics by the work they share, and the works that metrics with filters of their own join.

        Such a metric joins an unfiltered one's groupBy if that already has all that its filters
        read: what the filters keep is then aggregated apart in the same pass.
        """
        works: dict[tuple, list[str]] = {}
        for n in names:
            if not self.model.metric(n).pre:
                works.setdefault(self.work(n, scope), []).append(n)
        lowered = {}
        for n in names:
            if pre := self.model.metric(n).pre:
                own = self.work(n, scope, ())
                if own in works and set().union(*map(self.datasets_of, pre)) <= {own[0], *own[1]}:
                    lowered[n] = own
                else:
                    works.setdefault(self.work(n, scope), []).append(n)
        return works, lowered

    def sources(self, names: list[str], scope: Scope, states: bool = False) -> DataFrame:
        """Source metrics at the scope's grain; with states, AVG as its sum and count (name__sum, name__count).

        With dimensions, a metric whose filters keep none of a group's rows is null there, a count too.
        """
        works, lowered = self.shared(names, scope)
        out = []
        for work, group in works.items():
            df = self.rows(work, scope, self.model.metric(group[0]).pre)
            columns = []
            for n in group:
                expr, calls = self.model.metric(n).expr, self.model.calls(n)
                if states and calls[0].name == "AVG":
                    arg, suffix = calls[0].args[0], calls[0].suffix
                    columns += [self.sql(f"SUM({arg}){suffix}").alias(f"{n}__sum"), self.sql(f"COUNT({arg}){suffix}").alias(f"{n}__count")]
                else:
                    columns.append(self.sql(expr).alias(n))
            for k, n in enumerate(x for x, own in lowered.items() if own == work):
                kept = f"_kept_{k}"
                df = df.withColumn(kept, F.coalesce(reduce(lambda a, b: a & b, map(self.predicate, self.model.metric(n).pre)), F.lit(False)))
                value = self.sql(only(self.model.metric(n).expr, kept))
                columns.append((F.when(F.bool_or(kept), value) if scope.dims else value).alias(n))
            by = [self.dim_column(d).alias(d.label) for d in scope.dims]
            out.append(df.groupBy(*by).agg(*columns) if by else df.agg(*columns))
        return frames.align(out, scope.labels)

    # --- metrics of all kinds --------------------------------------------------------------------

    def evaluate(self, names: list[str], scope: Scope) -> DataFrame:
        """The scope's dimensions and the metrics named, inputs aligned and computed first."""
        closed: list[str] = []  # what derived metrics need; special kinds see to their own inputs

        def need(n: str) -> None:
            if self.model.kind(n) == "derived":
                for x in self.model.inputs(n):
                    need(x)
            if n not in closed:
                closed.append(n)

        for n in names:
            need(n)
        kinds = {n: self.model.kind(n) for n in closed}
        plain = [n for n in closed if kinds[n] == "source"]
        parts = [(plain, self.sources(plain, scope))] if plain else []
        parts += [([n], getattr(self, f"_{kinds[n]}")(n, scope)) for n in closed if kinds[n] not in ("source", "derived")]
        filtered = any(self.model.metric(n).post for n in closed)
        if filtered:  # a metric's filter on itself takes rows from its own branch alone, so branches say where they have rows
            parts = [(own, df.withColumn(f"_in_{k}", F.lit(True))) for k, (own, df) in enumerate(parts)]
        df = frames.align([df for _, df in parts], scope.labels)
        there = {n: F.coalesce(f"_in_{k}", F.lit(False)) for k, (own, _) in enumerate(parts) for n in own} if filtered else {}
        for n in closed:
            m = self.model.metric(n)
            if kinds[n] == "derived":
                df = df.withColumn(n, over_metrics(m.expr, lambda x: F.col(x)))
            if filtered:
                own = there[n] if n in there else reduce(lambda a, b: a | b, [F.col(f"_at_{x}") for x in self.model.inputs(n)])
                for f in m.post:
                    own = own & F.coalesce(self.leaf(F.col(n), f, m.type), F.lit(False))
                df = df.withColumn(f"_at_{n}", own)
                df = df.withColumn(n, F.when(F.col(f"_at_{n}"), F.col(n))) if m.post else df
            df = self.finished(df, n)
        if filtered:  # one-row branches are crossed, so there a branch without its row leaves none
            rows = [F.col(f"_at_{n}") for n in (names if scope.dims else closed)]
            df = df.filter(reduce((lambda a, b: a | b) if scope.dims else (lambda a, b: a & b), rows))
        return df.select(*scope.labels, *names)

    def time_dim(self, name: str, scope: Scope) -> Dim:
        bound = self.model.time_of(name)
        if not bound:
            raise EngineError("MISSING_TIME_BINDING", name)
        ds = self.model.field(bound)[0].name
        mine = [d for d in scope.dims if d.grain and (self.name(bound) == d.field or d.custom)]
        if not mine:
            raise EngineError("MISSING_TIME_DIMENSION", f"{name} is grouped by no grain of {bound} of {ds}")
        return mine[0]

    def is_time_filter(self, f: dict, name: str) -> bool:
        bound = self.model.time_of(name)
        return "field" in f and not self.is_metric_filter(f) and bound is not None and self.name(f["field"]) == self.name(bound)

    def widened(self, name: str, scope: Scope, lower: Callable | None) -> tuple[Scope, list[dict]]:
        """The scope to read, with time bounds from below moved by `lower` (None: dropped), and the filters to apply after."""
        after = [f for f in scope.filters if self.is_time_filter(f, name)]
        read = [f for f in scope.filters if f not in after]
        for f in after:
            op, v = f["op"], f.get("values", [])
            if op not in ("between", "gt", "gte", "lt", "lte"):
                raise EngineError("UNSUPPORTED_TIME_FILTER", op)
            if op in ("between", "gt", "gte") and lower:
                read.append({"field": f["field"], "op": "gte", "values": [lower(time.parsed(v[0])).isoformat(sep=" ")]})
            if op in ("between", "lt", "lte"):
                read.append({"field": f["field"], "op": "lte" if op == "between" else op, "values": [v[-1]]})
        return replace(scope, filters=tuple(read)), after

    def after(self, df: DataFrame, dim: Dim, filters: list[dict]) -> DataFrame:
        for f in filters:
            df = df.filter(self.leaf(F.col(dim.label), f, "datetime" if dim.grain == "hour" else "date"))
        return df

    def calendar(self, dim: Dim, scope: Scope) -> DataFrame | None:
        """The spine's periods of a dimension, if the model has a spine for its grain."""
        s = self.model.spine
        if dim.custom:
            ds, g = self.model.grain(dim.grain)
            return self.dataset(ds.name).select(F.col(f"{ds.name}__{g.bucket}").alias(dim.label)).distinct() if g.dense else None
        if not s or dim.grain not in s.grains:
            return None
        return self.dataset(s.dataset).select(time.truncate(F.col(f"{s.dataset}__{s.field}"), dim.grain).alias(dim.label)).distinct()

    def states(self, name: str, base: str, scope: Scope, dim: Dim) -> tuple[DataFrame, dict, Column]:
        """A base metric in a form that merges: (frame, output -> (merge, state), final value)."""
        kind = self.model.kind(base)
        if kind != "source":
            df = self.evaluate([base], scope)
            return self.dense(df, dim, scope, [base]), {f"{base}__w": ("sum", base)}, F.col(f"{base}__w")
        merge = self.model.merge_of(base)
        if not merge or self.model.metric(base).post:
            raise EngineError("INVALID_METRIC_ROLLUP", f"{name} over {base}")
        df = self.sources([base], scope, states=True)
        if merge == "avg":
            pair = [f"{base}__sum", f"{base}__count"]
            df = self.dense(df, dim, scope, pair)
            return df, {f"{x}__w": ("sum", x) for x in pair}, F.try_divide(F.col(f"{pair[0]}__w"), F.col(f"{pair[1]}__w"))
        df = self.dense(df, dim, scope, [base] if merge == "sum" else [])
        return df, {f"{base}__w": (merge, base)}, F.col(f"{base}__w")

    def dense(self, df: DataFrame, dim: Dim, scope: Scope, zero: list[str]) -> DataFrame:
        periods = self.calendar(dim, scope)
        if periods is None:
            return df
        bounds = [f for f in scope.filters if dim.custom is False and self.name(f.get("field", dim.field)) == dim.field and "field" in f] if zero else []
        for f in bounds:
            periods = periods.filter(self.leaf(F.col(dim.label), f, "date"))
        return frames.densify(df, periods, [dim.label], [x for x in scope.labels if x != dim.label], zero)

    def ordinals(self, dim: Dim) -> tuple[DataFrame, str]:
        ds, g = self.model.grain(dim.grain)
        if not g.dense:
            raise EngineError("INVALID_CALENDAR", f"{dim.grain} is not dense")
        return self.dataset(ds.name).select(F.col(f"{ds.name}__{g.bucket}").alias(dim.label), F.col(f"{ds.name}__{g.ordinal}").alias("_ordinal")).distinct(), ds.name

    def _cumulative(self, name: str, scope: Scope) -> DataFrame:
        o = self.model.metric(name).cumulative
        dim = self.time_dim(name, scope)
        others = [x for x in scope.labels if x != dim.label]
        rows, to = o.get("rows"), o.get("to_grain")
        if dim.custom:
            read, after = self.widened(name, scope, None)
        elif rows:
            if o["unit"] != dim.grain:
                raise EngineError("INCOMPATIBLE_GRAIN", f"{name} rolls over {o['unit']}s")
            read, after = self.widened(name, scope, lambda v: time.moved(time.start_of(v, dim.grain), 1 - rows, dim.grain))
        elif to:
            if COARSER.get(to, -1) >= COARSER[dim.grain]:
                raise EngineError("INCOMPATIBLE_GRAIN", f"{name} needs a grain finer than {to}")
            read, after = self.widened(name, scope, lambda v: time.start_of(v, to))
        else:
            read, after = self.widened(name, scope, None)
        df, values, final = self.states(name, o["metric"], read, dim)
        by, order = list(others), dim.label
        if dim.custom:
            keys, ds = self.ordinals(dim)
            if to:
                d, upper = self.model.grain(to)
                g = self.model.grain(dim.grain)[1]
                chain, at = [], g
                while at:
                    chain.append(at.name)
                    at = d.grains.get(at.parent) if at.parent else None
                if to not in chain:
                    raise EngineError("INCOMPATIBLE_GRAIN", f"{dim.grain} does not descend from {to}")
                reset = self.dataset(ds).select(F.col(f"{ds}__{g.bucket}").alias(dim.label), F.col(f"{ds}__{upper.bucket}").alias("_reset")).distinct()
                df, by = df.join(reset, dim.label), [*others, "_reset"]
            df, order = df.join(keys, dim.label), "_ordinal"
        elif to:
            df = df.withColumn("_reset", time.truncate(F.col(dim.label), to))
            by = [*others, "_reset"]
        df = frames.running(df, values, by, order, rows).withColumn(name, final)
        return self.after(df, dim, after).select(*scope.labels, name)

    def _offset(self, name: str, scope: Scope) -> DataFrame:
        o = self.model.metric(name).offset
        dim, n, base = self.time_dim(name, scope), o["count"], o["metric"]
        if dim.custom:
            read, after = self.widened(name, scope, None)
            df = self.dense(self.evaluate([base], read), dim, read, [base])
            keys, _ = self.ordinals(dim)
            there = keys.select(F.col(dim.label).alias("_to"), (F.col("_ordinal") + n).alias("_ordinal"))
            df = df.join(keys, dim.label).join(there, "_ordinal").drop(dim.label, "_ordinal").withColumnRenamed("_to", dim.label)
        else:
            read, after = self.widened(name, scope, lambda v: time.moved(v, n, o["unit"]))
            read_after = [f for f in read.filters if self.is_time_filter(f, name) and f["op"] in ("lt", "lte")]
            read = replace(read, filters=tuple(f for f in read.filters if f not in read_after))
            df = self.dense(self.evaluate([base], read), dim, replace(read, filters=()), [base])
            df = df.withColumn(dim.label, time.shift(F.col(dim.label), -n, o["unit"]))
        return self.after(df, dim, after).select(*scope.labels, F.col(base).alias(name))

    def _offset_to_grain(self, name: str, scope: Scope) -> DataFrame:
        o = self.model.metric(name).offset_to_grain
        dim, base, to = self.time_dim(name, scope), o["metric"], o["grain"]
        others = [x for x in scope.labels if x != dim.label]
        read, after = self.widened(name, scope, None if dim.custom else lambda v: time.start_of(v, to))
        df = self.dense(self.evaluate([base], read), dim, read, [base])
        order = dim.label
        if dim.custom:
            keys, ds = self.ordinals(dim)
            g, upper = self.model.grain(dim.grain)[1], self.model.grain(to)[1]
            reset = self.dataset(ds).select(F.col(f"{ds}__{g.bucket}").alias(dim.label), F.col(f"{ds}__{upper.bucket}").alias("_reset")).distinct()
            df, order = df.join(reset, dim.label).join(keys, dim.label), "_ordinal"
        else:
            df = df.withColumn("_reset", time.truncate(F.col(dim.label), to))
        df = frames.boundary(df, base, [*others, "_reset"], order)
        return self.after(df, dim, after).select(*scope.labels, F.col(base).alias(name))

    def finished(self, df: DataFrame, name: str) -> DataFrame:
        m = self.model.metric(name)
        if m.scale:
            df = df.withColumn(name, F.col(name) * F.expr(m.scale))
        return df.withColumn(name, F.coalesce(F.col(name), F.lit(0))) if m.fill_zero else df

    def selected(self, name: str, scope: Scope) -> DataFrame:
        """The value picked for each of the scope's groups, with the struct `_at` of time and tie break that it was picked by.

        Over another pick, the choice is among what that one picked, by the times it picked them at.
        """
        o = self.model.metric(name).semi_additive
        base = o["metric"]
        if self.model.kind(base) == "semi_additive":
            df = self.finished(self.selected(base, scope), base)
        else:
            order = [Dim("_time", self.name(o["time"]))] + ([Dim("_tie", self.name(o["tie_break"]))] if o.get("tie_break") else [])
            df = self.evaluate([base], replace(scope, dims=(*scope.dims, *order)))
            df = df.filter(F.col("_time").isNotNull()).withColumn("_at", F.struct(*[d.label for d in order]))
        if o.get("null_policy") == "skip":
            df = df.filter(F.col(base).isNotNull())
        both = df.withColumn("_picked", F.struct(F.col(base).alias("value"), F.col("_at").alias("at")))
        out = frames.pick(both, "_picked", scope.labels, F.col("_at"), o.get("choose", "last") == "last")
        return out.select(*scope.labels, F.col("_picked.value").alias(name), F.col("_picked.at").alias("_at"))

    def _semi_additive(self, name: str, scope: Scope) -> DataFrame:
        o = self.model.metric(name).semi_additive
        extra = [Dim(f"_g{k}", self.name(g)) for k, g in enumerate(o.get("groupings", []))]
        df = self.selected(name, replace(scope, dims=(*scope.dims, *extra)))
        if extra:
            how = {"sum": F.sum, "min": F.min, "max": F.max}[o.get("rollup", "sum")]
            df = df.groupBy(*scope.labels).agg(how(name).alias(name))
        return df.select(*scope.labels, name)

    def _conversion(self, name: str, scope: Scope) -> DataFrame:
        o = self.model.metric(name).conversion
        base, event = o["base"], o["event"]
        roots = [self.model.datasets[x["dataset"]] for x in (base, event)]
        if not all(d.primary_key for d in roots):
            raise EngineError("INVALID_CONVERSION", "both events need a primary key")
        if any(d.field.split(".")[0] != base["dataset"] for d in scope.dims):
            raise EngineError("INVALID_CONVERSION", "dimensions belong to the base event")

        def side(x: dict, tag: str) -> DataFrame:
            d = self.dataset(x["dataset"])
            for f in x.get("filters", []):
                d = d.filter(self.predicate(f))
            for f in scope.filters if tag == "b" else ():
                d = d.filter(self.predicate(f))
            value = F.col(f"{x['dataset']}__{x['value']}") if x.get("value") else F.lit(1)
            d = d.withColumn(f"_{tag}v", value)
            if tag == "b":
                d = d.withColumns({f"_d{k}": self.dim_column(dim) for k, dim in enumerate(scope.dims)})
            wanted = {x["entity"], x["time"], *self.model.datasets[x["dataset"]].primary_key, *[c[tag == "e"] for c in o.get("constant", [])]}
            return d.select(*[F.col(f"{x['dataset']}__{c}").alias(f"_{tag}_{c}") for c in sorted(wanted)], *[c for c in d.columns if c.startswith("_")])

        b, e = side(base, "b"), side(event, "e")
        since = None
        if o.get("window"):
            n, unit = o["window"]
            since = time.shift(F.col(f"_e_{event['time']}"), -n, unit, hours=True)
        keys = [(f"_b_{a}", f"_e_{c}") for a, c in [(base["entity"], event["entity"]), *[tuple(x) for x in o.get("constant", [])]]]
        got = frames.match_conversions(b, e, keys, f"_b_{base['time']}", f"_e_{event['time']}", [f"_b_{k}" for k in roots[0].primary_key], [f"_e_{k}" for k in roots[1].primary_key], since)
        dims = [F.col(f"_d{k}").alias(d.label) for k, d in enumerate(scope.dims)]
        total = (b.groupBy(*dims) if dims else b).agg(F.sum("_bv").alias("_base"))
        done = (got.groupBy(*dims) if dims else got).agg(F.sum("_ev").alias("_done"))
        both = frames.align([total, done], scope.labels)
        count = F.coalesce("_done", F.lit(0))
        out = count if o.get("output") == "conversions" else F.try_divide(count.cast("double"), F.col("_base").cast("double"))
        return both.select(*scope.labels, out.alias(name))

    # --- requests --------------------------------------------------------------------------------

    def dims(self, refs: tuple[DimensionRef, ...]) -> tuple[Dim, ...]:
        out = []
        for r in refs:
            d, f = self.model.field(r.name)
            if not f.dimension:
                raise EngineError("NOT_A_DIMENSION", r.name)
            if r.grain is None or r.grain in GRAINS:
                if r.grain and f.type not in ("date", "datetime", "datetimetz"):
                    raise EngineError("INVALID_GRAIN", f"{r.name} is no time")
                out.append(Dim(r.label, f"{d.name}.{f.name}", r.grain))
                continue
            found = self.model.grain(r.grain)
            if not found or found[0].name != d.name or d.base_time != f.name:
                raise EngineError("INVALID_GRAIN", r.grain)
            out.append(Dim(r.label, f"{d.name}.{found[1].bucket}", r.grain, True))
        return tuple(out)

    def leaves(self, f: dict) -> list[dict]:
        parts = f.get("and") or f.get("or") or ([f["not"]] if "not" in f else [])
        return [x for p in parts for x in self.leaves(p)] if parts else [f]

    def check(self, names: list[str], scope: Scope) -> None:
        """Rejects filters and groupings that have no one meaning for the metrics asked for."""
        closed = self.model.closure(names)
        kinds = {n: self.model.kind(n) for n in closed}
        sources = [n for n in closed if kinds[n] == "source"]
        times = {self.name(t) for m in map(self.model.metric, closed) for t in (m.time, (m.semi_additive or {}).get("time")) if t}
        used = {d.field.split(".")[0] for d in scope.dims} | {d for n in sources for d in self.model.metric_datasets(n)}
        for f in scope.filters:
            if "exists" in f:
                continue
            leaves = self.leaves(f)
            if any(map(self.is_metric_filter, leaves)):
                raise EngineError("INVALID_FILTER", "a metric within a predicate tree")
            used |= self.datasets_of(f)
            if leaves != [f]:
                if any(self.name(x["field"]) in times for x in leaves):
                    raise EngineError("INVALID_FILTER", "a time dimension within a predicate tree")
                if len({self.root(n) for n in sources}) > 1 or "conversion" in kinds.values():
                    raise EngineError("UNSUPPORTED_FILTER", "a predicate tree over several sources, or over a conversion")
        for f in scope.filters:
            edge = self.model.relationships.get(f["exists"]["relationship"]) if "exists" in f else None
            if not edge:
                continue
            if edge.temporal or {"conversion", "semi_additive"} & set(kinds.values()):
                raise EngineError("INVALID_EXISTS", "not over a point-in-time relationship, nor with conversions or picks")
            if {edge.left, edge.right} <= used:
                raise EngineError("INVALID_EXISTS", "the target is read by the request itself")
        for n in closed:
            bound = self.model.time_of(n) if kinds[n] in ("cumulative", "offset", "offset_to_grain") else None
            if bound and any(d.grain and not d.custom and d.field != self.name(bound) for d in scope.dims):
                raise EngineError("CONFLICTING_TIME_DIMENSION", f"{n} is bound to {bound}")

    def query(self, given: dict | Request) -> DataFrame:
        """Dimensions, then metrics, in the order asked for."""
        q = given if isinstance(given, Request) else parse(given)
        dims = self.dims(q.dimensions)
        labels = [d.label for d in dims]
        on_metrics = [f for f in q.filters if self.is_metric_filter(f)]
        for f in on_metrics:
            if f["op"] not in ORDERED:
                raise EngineError("INVALID_FILTER", f"{f['op']} on a metric")
        scope = Scope(dims, tuple(f for f in q.filters if f not in on_metrics))
        hidden = [f["field"] for f in on_metrics] + [n for n, _ in q.order_by if n in self.model.metrics]
        names = list(dict.fromkeys([*q.metrics, *hidden]))
        self.check(names, scope)
        if names:
            df = self.evaluate(names, scope)
        else:
            needed = list(dict.fromkeys([d.field.split(".")[0] for d in dims] + [x for f in scope.filters if "exists" not in f for x in sorted(self.datasets_of(f))]))
            root = next((r for r in needed if all(self._reaches(r, o) for o in needed)), needed[0])
            df = self.rows((root, tuple(x for x in needed if x != root), "", False), scope, ())
            df = df.select(*[self.dim_column(d).alias(d.label) for d in dims]).distinct()
        for f in on_metrics:
            df = df.filter(self.leaf(F.col(f["field"]), f, self.model.metric(f["field"]).type))
        outputs = [n for n in names if n in q.metrics]
        for n, _ in q.order_by:
            if n not in labels and n not in names:
                raise EngineError("INVALID_ORDER", n)
        order = [F.asc_nulls_last(n) if way == "asc" else F.desc_nulls_last(n) for n, way in q.order_by]
        df = df.withColumns({n: F.col(n).cast(TYPES[self.model.metric(n).type] or "string") for n in outputs if TYPES.get(self.model.metric(n).type)})
        if order:
            df = df.orderBy(*order)
        if q.limit:
            df = df.limit(q.limit)
        return df.select(*labels, *[n for n in q.metrics])

    def _reaches(self, a: str, b: str) -> bool:
        try:
            return all(self.safe(e, w) for e, w in self.model.path(a, b))
        except EngineError:
            return False

    def validate(self, given: dict) -> None:
        """Raises what the request would be rejected for; runs nothing."""
        self.query(given)

    def explain(self, given: dict) -> dict:
        """How a request is evaluated: metrics by kind, source groups that share a scan, and Spark's plan."""
        q = parse(given)
        scope = Scope(self.dims(q.dimensions), tuple(f for f in q.filters if not self.is_metric_filter(f)))
        closed = self.model.closure(list(q.metrics))
        groups, lowered = self.shared([n for n in closed if self.model.kind(n) == "source"], scope)
        for n, own in lowered.items():
            groups[own].append(n)
        plan = self.query(q)._jdf.queryExecution().toString()
        return {"metrics": {n: self.model.kind(n) for n in closed}, "shared": list(groups.values()), "plan": plan}

    def dimension_values(self, name: str, limit: int = 100, filters: tuple[dict, ...] = (), metrics: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[list], bool]]:
        """Distinct values without null, in order, one more than the limit; and a test of whether rows got were cut.

        With metrics, eight at most, only values that these have rows of.
        """
        if not 1 <= limit <= 500:
            raise EngineError("INVALID_LIMIT", str(limit))
        if len(metrics) > 8:
            raise EngineError("INVALID_SCOPE", "eight metrics at most")
        label = DimensionRef(name).label
        if metrics:
            rows = self.query({"metrics": list(metrics), "dimensions": [name], "filters": [*filters, {"field": name, "op": "is_not_null"}]})
            return rows.select(label).distinct().orderBy(F.asc_nulls_last(label)).limit(limit + 1), lambda rows: len(rows) > limit
        df = self.query({"dimensions": [name], "filters": [*filters, {"field": name, "op": "is_not_null"}], "order_by": [label], "intent": "distinct_values"})
        return df.limit(limit + 1), lambda rows: len(rows) > limit

    def compatible_dimensions(self, metrics: list[str]) -> dict[str, str]:
        """Each field's worst status for the metrics: compatible, ambiguous or unreachable."""
        rank = {"compatible": 0, "ambiguous": 1, "unreachable": 2}
        out = {}
        roots = {self.root(n) for m in metrics for n in self.model.closure([m]) if self.model.kind(n) == "source"}
        for d in self.model.datasets.values():
            status = "compatible"
            for r in roots:
                try:
                    own = "compatible" if all(self.safe(e, a) for e, a in self.model.path(r, d.name)) else "unreachable"
                except EngineError as e:
                    own = "ambiguous" if e.code.startswith("AMBIGUOUS") else "unreachable"
                status = max(status, own, key=rank.__getitem__)
            out |= {f"{d.name}.{f.name}": status for f in d.fields.values() if f.dimension}
        return out


def bounded(df: DataFrame, most_rows: int, most_bytes: int | None = None, seconds: float | None = None) -> list:
    """All rows or none: fails beyond the limits, never fetches more than one row beyond them, and ends its jobs after `seconds`."""
    late, sc = threading.Event(), df.sparkSession.sparkContext
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    group, timer = f"bounded-{uuid.uuid4().hex}", None
    if seconds is not None:

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(seconds, stop)
        sc.setJobGroup(group, "bounded result", interruptOnCancel=True)
        timer.start()
    try:
        few = df.limit(most_rows + 1)
        if most_bytes is not None:  # rows that follow the one that goes beyond are not sent; there are most_rows at most to number
            size = F.coalesce(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), F.lit(0))
            before = Window.orderBy(F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)
            few = few.withColumn("_size", size).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).filter(F.col("_before") <= most_bytes)
        rows = few.collect()
    except Exception as failure:
        if late.is_set():
            raise EngineError("EXECUTION_TIMEOUT", f"more than {seconds} seconds") from failure
        raise
    finally:
        if timer:
            timer.cancel()
            for k, v in before.items():
                sc.setLocalProperty(k, v)
    if late.is_set():
        raise EngineError("EXECUTION_TIMEOUT", f"more than {seconds} seconds")
    if len(rows) > most_rows:
        raise EngineError("RESULT_TOO_LARGE", f"more than {most_rows} rows")
    if most_bytes is not None:
        if rows and rows[-1]["_before"] + rows[-1]["_size"] > most_bytes:
            raise EngineError("RESULT_TOO_LARGE", f"more than {most_bytes} bytes")
        return [Row(**{k: v for k, v in r.asDict().items() if k not in ("_size", "_before")}) for r in rows]
    return rows


__all__ = ["Engine", "Scope", "bounded", "names_in"]
