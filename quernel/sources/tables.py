"""Where datasets come from: resolvers of source names, catalogue inspection and model scaffolds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quernel.errors import EngineError

Tables = Callable[[str], DataFrame]


def parquet(spark: SparkSession, folder: str) -> Tables:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession) -> Tables:
    return spark.table


def frames(given: dict[str, DataFrame]) -> Tables:
    def find(name: str) -> DataFrame:
        if name not in given:
            raise EngineError("UNKNOWN_SOURCE", name)
        return given[name]

    return find


def registry(**backends: Tables) -> Tables:
    """Sources named `backend:table`; each backend resolves its own."""

    def find(name: str) -> DataFrame:
        kind, _, table = name.partition(":")
        if kind not in backends or not table:
            raise EngineError("UNKNOWN_BACKEND", name)
        return backends[kind](table)

    return find


def semantic_type(kind: T.DataType) -> str:
    match kind:
        case T.StringType() | T.VarcharType() | T.CharType():
            return "string"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "integer"
        case T.DecimalType():
            return "decimal"
        case T.FloatType() | T.DoubleType():
            return "float"
        case T.BooleanType():
            return "boolean"
        case T.DateType():
            return "date"
        case T.TimestampNTZType():
            return "datetime"
        case T.TimestampType():
            return "datetimetz"
    return "time" if kind.typeName().startswith("time") else "opaque"


def inspect(tables: Tables, names: list[str]) -> dict[str, list[dict]]:
    """Columns of the named sources only; no rows are read."""
    return {n: [{"name": f.name, "native": f.dataType.simpleString(), "type": semantic_type(f.dataType), "nullable": f.nullable} for f in tables(n).schema] for n in names}


def scaffold(name: str, snapshot: dict[str, list[dict]], selected: dict[str, list[str]] | None = None, row_count: bool = False) -> dict:
    """A model document from an inspection; only selected fields, and a row-count metric for each dataset if asked."""
    datasets, metrics = [], []
    for source, columns in snapshot.items():
        wanted = (selected or {}).get(source, [c["name"] for c in columns])
        if missing := set(wanted) - {c["name"] for c in columns}:
            raise EngineError("UNKNOWN_FIELD", ", ".join(sorted(missing)))
        datasets.append({"name": source, "source": source, "fields": [{"name": c["name"], "type": c["type"]} for c in columns if c["name"] in wanted]})
        if row_count and wanted:
            metrics.append({"name": f"{source}_rows", "expr": "COUNT(*)", "dataset": source, "type": "integer"})
    return {"name": name, "datasets": datasets, "metrics": metrics}
