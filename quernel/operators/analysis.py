"""Comparison of two periods, and attribution of a metric's change to segments."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import EngineError
from quernel.functions.expressions import without_calls
from quernel.plans.engine import Dim, Engine, Scope
from quernel.plans.request import DimensionRef

QUOTIENT = "decimal(20,12)"
PERCENT_PLACES = 18
Period = tuple[str, str]


def _period(engine: Engine, metrics: list[str], dims: list[str], time: str, period: Period, tag: str, filters: tuple = ()) -> DataFrame:
    start, stop = period
    df = engine.query({"metrics": metrics, "dimensions": dims, "filters": [*filters, {"field": time, "op": "gte", "values": [start]}, {"field": time, "op": "lt", "values": [stop]}]})
    labels = [d.rpartition(".")[2] for d in dims]
    return df.select(*[F.col(x).alias(f"_{tag}_{x}") for x in labels], *[F.col(m).alias(f"{m}_{tag}") for m in metrics], F.lit(True).alias(f"_{tag}"))


def _at_once(engine: Engine, metrics: list[str], dims: list[str], time: str, baseline: Period, current: Period, filters: tuple) -> DataFrame:
    """Both periods from one evaluation that has the period as a dimension of its own."""
    refs = engine.dims(tuple(DimensionRef(d) for d in dims))
    field, labels = engine.name(time), [d.label for d in refs]
    names = (("baseline", *baseline), ("current", *current))
    spans = [{"and": [{"field": field, "op": "gte", "values": [a]}, {"field": field, "op": "lt", "values": [b]}]} for _, a, b in names]
    scope = Scope((*refs, Dim("_period", field, periods=names)), (*filters, {"or": spans}))
    engine.check(metrics, Scope(refs, tuple(filters)))
    df = engine.evaluate(metrics, scope)
    values = [F.any_value(F.when(F.col("_period") == t, F.col(m)), ignoreNulls=True).alias(f"{m}_{t}") for m in metrics for t in ("baseline", "current")]
    there = [F.bool_or(F.col("_period") == t).alias(f"in_{t}") for t in ("baseline", "current")]
    return df.groupBy(*labels).agg(*values, *there)


def _matched(engine: Engine, metrics: list[str], dims: list[str], time: str, baseline: Period, current: Period, filters: tuple = ()) -> DataFrame:
    """Dimensions, each metric in both periods, and whether each period has the member; null members are one member."""
    labels = [d.rpartition(".")[2] for d in dims]
    apart = sorted([baseline, current])
    plain = all(engine.model.kind(n) in ("source", "derived") for n in engine.model.closure(metrics))
    if labels and plain and apart[0][1] <= apart[1][0]:
        return _at_once(engine, metrics, dims, time, baseline, current, filters)
    a, b = (_period(engine, metrics, dims, time, p, t, filters) for p, t in ((baseline, "baseline"), (current, "current")))
    if not labels:
        return a.crossJoin(b).drop("_baseline", "_current")
    on = [F.col(f"_baseline_{x}").eqNullSafe(F.col(f"_current_{x}")) for x in labels]
    both = a.join(b, on, "full")
    members = [F.when(F.col("_baseline"), F.col(f"_baseline_{x}")).otherwise(F.col(f"_current_{x}")).alias(x) for x in labels]
    return both.select(*members, *[f"{m}_{t}" for m in metrics for t in ("baseline", "current")], F.coalesce("_baseline", F.lit(False)).alias("in_baseline"), F.coalesce("_current", F.lit(False)).alias("in_current"))


def _scale(df: DataFrame, c: str) -> int:
    kind = df.schema[c].dataType
    return kind.scale if isinstance(kind, T.DecimalType) else 0


def _whole(c: Column, scale: int) -> Column:
    """A decimal in units of its last place."""
    return F.replace(c.cast(f"decimal(38,{scale})").cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")


def exact_quotient(a: Column, b: Column, places: int = PERCENT_PLACES) -> Column:
    """a / b of whole numbers, rounded half up at the last place; null for a zero b, or if the digits exceed 38.

    Long division, six places at a time: Spark's own keeps six places of numbers this wide.
    """
    step, den = F.lit(1_000_000).cast("decimal(7,0)"), F.nullif(b, F.lit(0))
    left = F.try_mod(a, den)
    out = F.try_divide(F.try_subtract(a, left), den).try_cast("decimal(36,18)")  # narrower than the widest, or sums would lose a place
    for k in range(1, places // 6 + 1):
        more = F.try_multiply(left, step).try_cast("decimal(38,0)")
        left = F.try_mod(more, den)
        digits = F.try_divide(F.try_subtract(more, left), den).try_cast("decimal(7,0)")
        out = (out + (digits * F.lit("0." + "0" * (6 * k - 1) + "1").cast(f"decimal({6 * k + 1},{6 * k})")).cast("decimal(25,18)")).cast("decimal(36,18)")
    last = F.lit("0." + "0" * (places - 1) + "1").cast("decimal(19,18)")
    up = F.abs(left) >= F.abs(den) - F.abs(left)
    negative = (F.signum(a) * F.signum(b)) < 0
    return (out + F.when(up, F.when(negative, -last).otherwise(last)).otherwise(F.lit(0).cast("decimal(19,18)"))).try_cast("decimal(38,18)")


def compare(engine: Engine, metrics: list[str], dims: list[str], time: str, baseline: Period, current: Period) -> DataFrame:
    """Both periods side by side: delta and percent of each metric, exact to 18 places. Null members equal each other and sort last."""
    if not 1 <= len(metrics) <= 16 or len(dims) > 8:
        raise EngineError("INVALID_COMPARISON", "1 to 16 metrics and up to 8 dimensions")
    if any(engine.model.metric(m).type not in ("integer", "decimal") for m in metrics):
        raise EngineError("INVALID_COMPARISON", "only Integer and Decimal metrics")
    df = _matched(engine, metrics, dims, time, baseline, current)
    labels = [d.rpartition(".")[2] for d in dims]
    out = [F.col(x) for x in labels]
    for m in metrics:
        kind = "bigint" if engine.model.metric(m).type == "integer" else "decimal(38,18)"
        b, c = F.col(f"{m}_baseline"), F.col(f"{m}_current")
        scale = max(_scale(df, f"{m}_baseline"), _scale(df, f"{m}_current"))
        delta = (c.cast("decimal(37,18)") - b.cast("decimal(37,18)")).try_cast("decimal(38,18)")
        n = F.try_subtract(_whole(c, scale), _whole(b, scale))
        percent = exact_quotient(F.try_multiply(n, F.lit(100).cast("decimal(3,0)")).try_cast("decimal(38,0)"), _whole(b, scale))
        out += [b.cast(kind).alias(f"{m}_baseline"), c.cast(kind).alias(f"{m}_current"), delta.alias(f"{m}_delta"), percent.alias(f"{m}_percent"), delta.isNotNull().alias(f"{m}_change_defined"), percent.isNotNull().alias(f"{m}_percent_defined")]
    return df.select(*out).orderBy(*[F.asc_nulls_last(x) for x in labels])


def decomposition(engine: Engine, metric: str) -> str | tuple[str, str] | None:
    """"additive", the (numerator, denominator) of a ratio of two additive metrics, or None.

    Additive are aggregates whose results sum up, their sums and differences, and their products
    with and quotients by constants; read from the expression's tree.
    """
    if engine.model.kind(metric) not in ("source", "derived") or engine.model.metric(metric).post:
        return None
    text, calls = without_calls(engine.model.metric(metric).expr)
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError:
        return None

    def number(node: ast.AST) -> float | None:
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return number(node.operand)
        return node.value if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool) else None

    def adds(node: ast.AST) -> bool:
        match node:
            case ast.Name(id=name) if name.startswith("_aggregate_"):
                call = calls[int(name.rpartition("_")[2])]
                return (call.merge or (engine.model.metric(metric).algebra if call.whole else None)) == "sum"
            case ast.Name(id=name):
                return name in engine.model.metrics and decomposition(engine, name) == "additive"
            case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=x):
                return adds(x)
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub(), right=b):
                return adds(a) and adds(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return adds(a) and number(b) is not None or number(a) is not None and adds(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return adds(a) and bool(number(b))
        return False

    if adds(tree):
        return "additive"
    match tree:
        case ast.BinOp(left=ast.Name(id=a), op=ast.Div(), right=ast.Name(id=b)) if {a, b} <= set(engine.model.metrics):
            if decomposition(engine, a) == decomposition(engine, b) == "additive":
                return a, b
    return None


def additive(engine: Engine, metric: str) -> bool:
    return decomposition(engine, metric) == "additive"


def _check_population(engine: Engine, operands: list[str], segment: str, time: str) -> None:
    """Operands fill with zero, read one population, and read the time's dataset already."""
    dims = engine.dims((DimensionRef(segment),))
    works = set()
    for n in operands:
        own = [x for x in engine.model.closure([n]) if engine.model.kind(x) == "source"]
        if not engine.model.metric(n).fill_zero and not all(engine.model.metric(x).fill_zero for x in own):
            raise EngineError("UNSUPPORTED_ATTRIBUTION", f"{n} is not zero where a segment has no rows")
        works |= {engine.work(x, Scope(dims, ())) for x in own}
    if len({(w[0], w[1], w[2]) for w in works}) > 1:
        raise EngineError("UNSUPPORTED_ATTRIBUTION", "the operands read several populations")
    if any(engine.model.field(time)[0].name not in (w[0], *w[1]) for w in works):
        raise EngineError("UNSUPPORTED_ATTRIBUTION", f"the operands do not read {time}")


def attribute_additive(engine: Engine, metric: str, segment: str, time: str, baseline: Period, current: Period) -> DataFrame:
    """Per segment: baseline, current, delta, the total delta and the share of it."""
    if not additive(engine, metric):
        raise EngineError("UNSUPPORTED_ATTRIBUTION", metric)
    _check_population(engine, [metric], segment, time)
    label = segment.rpartition(".")[2]
    df = _matched(engine, [metric], [segment], time, baseline, current)
    b, c = (F.coalesce(f"{metric}_{t}", F.lit(0)).cast("decimal(38,18)") for t in ("baseline", "current"))
    rows = df.select(label, b.alias("baseline"), c.alias("current"), (c.cast("decimal(37,18)") - b.cast("decimal(37,18)")).alias("delta"))
    # the segments are few rows by then, so the total is a window over them and nothing is read again
    rows = rows.withColumn("total_delta", F.sum("delta").over(Window.partitionBy()))
    share = exact_quotient(F.try_multiply(_whole(F.col("delta"), 18), F.lit(100).cast("decimal(3,0)")).try_cast("decimal(38,0)"), _whole(F.col("total_delta").try_cast("decimal(38,18)"), 18))
    return rows.withColumn("contribution", share).orderBy(F.desc_nulls_last(F.abs("delta")), F.asc_nulls_last(label))


def _quotient(a: Column, b: Column) -> Column:
    """To twelve places, exactly; Spark's quotient of two decimals this wide would keep six."""
    return exact_quotient(_whole(a, 18), _whole(b, 18)).try_cast(QUOTIENT)


def attribute_ratio(engine: Engine, metric: str, segment: str, time: str, baseline: Period, current: Period) -> DataFrame:
    """Rate, mix, entry and exit effects of each segment on a ratio of two additive metrics, with totals and residual.

    A segment that is there with a zero denominator has null effects and leaves the whole undefined.
    """
    operands = decomposition(engine, metric)
    if not isinstance(operands, tuple):
        raise EngineError("UNSUPPORTED_ATTRIBUTION", metric)
    num, den = operands
    _check_population(engine, [num, den], segment, time)
    label = segment.rpartition(".")[2]
    df = _matched(engine, [num, den], [segment], time, baseline, current)
    zero = F.lit(0)
    v = {f"{x}{t[0]}": F.coalesce(f"{n}_{t}", zero).cast("decimal(38,18)") for x, n in (("n", num), ("d", den)) for t in ("baseline", "current")}
    rows = df.select(label, "in_baseline", "in_current", *[c.alias(k) for k, c in v.items()])
    whole = Window.partitionBy()  # over the segments, which are few rows by then
    rows = rows.withColumns({f"t{k}": F.sum(k).over(whole).cast("decimal(38,18)") for k in v})
    for t in "bc":
        rows = rows.withColumns({f"r{t}": _quotient(F.col(f"n{t}"), F.col(f"d{t}")), f"w{t}": _quotient(F.col(f"d{t}"), F.col(f"td{t}"))})
    both, entry, exit_ = F.col("in_baseline") & F.col("in_current"), ~F.col("in_baseline"), ~F.col("in_current")
    half = F.lit("0.5").cast("decimal(2,1)")
    rb, rc, wb, wc = (F.col(x) for x in ("rb", "rc", "wb", "wc"))
    rows = rows.withColumns({
        "rate_effect": F.when(both, half * (wb + wc) * (rc - rb)).otherwise(zero),
        "mix_effect": F.when(both, half * (rb + rc) * (wc - wb)).otherwise(zero),
        "entry_effect": F.when(entry, wc * rc).otherwise(zero),
        "exit_effect": F.when(exit_, -wb * rb).otherwise(zero),
    })
    effect = F.col("rate_effect") + F.col("mix_effect") + F.col("entry_effect") + F.col("exit_effect")
    rows = rows.withColumn("segment_effect", effect)
    change = _quotient(F.col("tnc"), F.col("tdc")) - _quotient(F.col("tnb"), F.col("tdb"))
    rows = rows.withColumns({"_sum": F.sum("segment_effect").over(whole), "attribution_defined": F.bool_and(F.col("segment_effect").isNotNull()).over(whole), "total_change": change})
    rows = rows.withColumn("decomposed", F.when(F.col("attribution_defined"), F.col("_sum"))).withColumn("residual", F.col("total_change") - F.col("decomposed"))
    out = ["rate_effect", "mix_effect", "entry_effect", "exit_effect", "segment_effect", "total_change", "decomposed", "residual", "attribution_defined"]
    return rows.select(label, *out).orderBy(F.desc_nulls_last(F.abs("segment_effect")), F.asc_nulls_last(label))


def inconsistencies(attribution: DataFrame, tolerance: str = "0.000000001") -> DataFrame:
    """Rows of an attribution that contradict it: parts that do not add up, shares that differ, or a residual beyond the tolerance."""
    near, whole = F.lit(tolerance).cast("decimal(38,18)"), Window.partitionBy()
    if "delta" in attribution.columns:
        sums = attribution.withColumn("_s", F.sum("delta").over(whole))
        share = F.try_divide(F.col("delta").cast("double") * 100, F.col("total_delta").cast("double"))
        wrong = (F.col("delta") != F.col("current") - F.col("baseline")) | (F.abs(F.col("_s") - F.col("total_delta")) > near)
        off = F.abs(share - F.col("contribution").cast("double")) > F.greatest(F.abs(share), F.lit(1.0)) * float(tolerance)
        return sums.filter(wrong | F.coalesce(off, share.isNotNull() != F.col("contribution").isNotNull())).drop("_s")
    parts = F.col("rate_effect") + F.col("mix_effect") + F.col("entry_effect") + F.col("exit_effect")
    sums = attribution.withColumn("_s", F.sum("segment_effect").over(whole))
    wrong = F.abs(parts - F.col("segment_effect")) > near
    off = F.col("attribution_defined") & ((F.abs("residual") > near) | (F.abs(F.col("_s") - F.col("decomposed")) > near) | (F.abs(F.col("total_change") - F.col("decomposed") - F.col("residual")) > near))
    return sums.filter(F.coalesce(wrong, F.lit(False)) | F.coalesce(off, F.lit(False))).drop("_s")
