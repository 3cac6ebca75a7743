"""Joining metric frames on their dimensions, window metrics over them, and picks of first and last values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(frames: list[DataFrame], dims: list[str]) -> DataFrame:
    """Full outer join on the dimensions, by plain equality: rows with a null member stay apart. One-row frames are crossed."""
    if not dims:
        return reduce(lambda a, b: a.crossJoin(b), frames)
    return reduce(lambda a, b: a.join(b, dims, "full"), frames)


def running(df: DataFrame, values: dict[str, tuple[str, str]], by: list[str], order: str, rows: int | None = None, final: Column | None = None, name: str = "") -> DataFrame:
    """Windows over ordered rows: from the start, or the last `rows`. values: output -> (merge, state column)."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first(order))
    w = w.rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, Window.currentRow)
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    return df.withColumns({out: how[merge](state).over(w) for out, (merge, state) in values.items()})


def boundary(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Each row gets the value of the first row of its partition."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.first(value).over(w))


def pick(df: DataFrame, value: str, dims: list[str], key: Column, last: bool = True) -> DataFrame:
    """The value at the greatest (least) key of each group; null values at that key stay null."""
    how = F.max_by if last else F.min_by
    return df.groupBy(*dims).agg(how(F.col(value), key).alias(value))


def densify(df: DataFrame, calendar: DataFrame, keys: list[str], others: list[str], zero: list[str]) -> DataFrame:
    """A row for each calendar period and each combination of the other dimensions; `zero` columns are 0 where there was none."""
    grid = calendar.crossJoin(df.select(*others).distinct()) if others else calendar
    out = grid.join(df, [*keys, *others], "full")
    return out.withColumns({z: F.coalesce(z, F.lit(0)) for z in zero})


def match_conversions(base: DataFrame, events: DataFrame, keys: list[tuple[str, str]], base_time: str, event_time: str, base_id: list[str], event_id: list[str], since: Column | None) -> DataFrame:
    """Each event with the nearest base row at or before its time, by equal keys and, if given, no earlier than `since`.

    Both sides in one order by key and time; an event takes the last base row it has passed. So a key
    with many of both costs its sorted rows, not their pairs. Rows without a key or a time match nothing.
    """
    own = [f"_k{i}" for i in range(len(keys))]

    def side(df: DataFrame, names: list[str], time: str, kind: int, ids: list[str]) -> DataFrame:
        there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*names, time]])
        left, right = (F.struct(*x.columns) for x in (base, events))
        both = [left if kind == 0 else F.lit(None).cast(base.schema), right if kind else F.lit(None).cast(events.schema)]
        order = F.struct(*[F.col(c) for c in ids]) if kind == 0 else F.lit(None).cast(base.select(F.struct(*[F.col(c) for c in base_id]).alias("x")).schema["x"].dataType)
        return df.filter(there).select(*[F.col(a).alias(b) for a, b in zip(names, own, strict=True)], F.col(time).alias("_time"), F.lit(kind).alias("_kind"), order.alias("_order"), both[0].alias("_base"), both[1].alias("_event"))

    rows = side(base, [a for a, _ in keys], base_time, 0, base_id).unionByName(side(events, [b for _, b in keys], event_time, 1, event_id))
    w = Window.partitionBy(*own).orderBy("_time", "_kind", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = rows.withColumn("_base", F.last("_base", ignorenulls=True).over(w)).filter((F.col("_kind") == 1) & F.col("_base").isNotNull()).select("_base.*", "_event.*")
    return got if since is None else got.filter(F.col(base_time) >= since)
