"""The engine over the driver's tables: one semantic model, named requests, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.model import load
from quernel.operators import analysis
from quernel.plans.engine import Engine
from quernel.sources import tables

_PRICE = "SUM(CAST(orders.o_totalprice AS DECIMAL(18,2)))"
_EVENT = "CAST(events.value AS DECIMAL(18,4))"


def _fields(**types: str) -> list[dict]:
    return [{"name": n, "type": t} for n, t in types.items()]


MODEL = {
    "name": "sales",
    "datasets": [
        {"name": "region", "source": "region", "primary_key": ["r_regionkey"], "fields": _fields(r_regionkey="integer", r_name="string")},
        {"name": "nation", "source": "nation", "primary_key": ["n_nationkey"], "fields": _fields(n_nationkey="integer", n_name="string", n_regionkey="integer")},
        {"name": "customer", "source": "customer", "primary_key": ["c_custkey"], "fields": _fields(c_custkey="integer", c_name="string", c_nationkey="integer", c_acctbal="float", c_mktsegment="string")},
        {"name": "supplier", "source": "supplier", "primary_key": ["s_suppkey"], "fields": _fields(s_suppkey="integer", s_name="string", s_acctbal="float")},
        {"name": "part", "source": "part", "primary_key": ["p_partkey"], "fields": _fields(p_partkey="integer", p_brand="string", p_type="string", p_size="integer")},
        {"name": "orders", "source": "orders", "primary_key": ["o_orderkey"], "fields": _fields(o_orderkey="integer", o_custkey="integer", o_orderstatus="string", o_totalprice="float", o_orderdate="datetime", o_orderpriority="string") + [{"name": "o_day", "expr": "CAST(o_orderdate AS DATE)", "type": "date"}]},
        {"name": "lineitem", "source": "lineitem", "fields": _fields(l_orderkey="integer", l_partkey="integer", l_suppkey="integer", l_quantity="float", l_extendedprice="float", l_discount="float", l_returnflag="string", l_linestatus="string", l_shipdate="datetime")},
        {"name": "events", "source": "events", "primary_key": ["event_id"], "fields": _fields(event_id="integer", ts="datetime", user_id="integer", event_type="string", value="float", props="string") + [{"name": "k", "expr": "CAST(get_json_object(props, '$.k') AS BIGINT)", "type": "integer"}]},
        {"name": "tiers", "source": "tiers", "primary_key": ["version_id"], "fields": _fields(version_id="integer", t_user="integer", valid_from="datetime", valid_to="datetime", tier="integer")},
        {"name": "days", "source": "days", "primary_key": ["day"], "fields": _fields(day="date")},
        {"name": "fiscal", "source": "fiscal", "primary_key": ["f_day"], "base_time": "f_day",
         "fields": _fields(f_day="date", week_start="date", week_index="integer", quarter_start="date", quarter_index="integer", year_start="date", year_index="integer"),
         "grains": [{"name": "fiscal_week", "bucket": "week_start", "ordinal": "week_index", "parent": "fiscal_quarter"}, {"name": "fiscal_quarter", "bucket": "quarter_start", "ordinal": "quarter_index", "parent": "fiscal_year"}, {"name": "fiscal_year", "bucket": "year_start", "ordinal": "year_index"}]},
    ],
    "relationships": [
        {"name": "order_customer", "left": "orders", "right": "customer", "left_columns": ["o_custkey"], "right_columns": ["c_custkey"]},
        {"name": "customer_nation", "left": "customer", "right": "nation", "left_columns": ["c_nationkey"], "right_columns": ["n_nationkey"]},
        {"name": "nation_region", "left": "nation", "right": "region", "left_columns": ["n_regionkey"], "right_columns": ["r_regionkey"]},
        {"name": "line_order", "left": "lineitem", "right": "orders", "left_columns": ["l_orderkey"], "right_columns": ["o_orderkey"]},
        {"name": "line_part", "left": "lineitem", "right": "part", "left_columns": ["l_partkey"], "right_columns": ["p_partkey"]},
        {"name": "line_supplier", "left": "lineitem", "right": "supplier", "left_columns": ["l_suppkey"], "right_columns": ["s_suppkey"]},
        {"name": "event_tier", "left": "events", "right": "tiers", "left_columns": ["user_id"], "right_columns": ["t_user"], "event": "ts", "valid_from": "valid_from", "valid_to": "valid_to"},
        {"name": "order_fiscal", "left": "orders", "right": "fiscal", "left_columns": ["o_day"], "right_columns": ["f_day"]},
    ],
    "metrics": [
        {"name": "revenue", "expr": _PRICE, "time": "orders.o_orderdate"},
        {"name": "orders_count", "expr": "COUNT(orders.o_orderkey)", "type": "integer", "time": "orders.o_orderdate"},
        {"name": "avg_price", "expr": "AVG(CAST(orders.o_totalprice AS DECIMAL(18,2)))", "time": "orders.o_orderdate"},
        {"name": "min_price", "expr": "MIN(CAST(orders.o_totalprice AS DECIMAL(18,2)))"},
        {"name": "max_price", "expr": "MAX(CAST(orders.o_totalprice AS DECIMAL(18,2)))", "time": "orders.o_orderdate"},
        {"name": "buyers", "expr": "COUNT(DISTINCT orders.o_custkey)", "type": "integer"},
        {"name": "distinct_sum", "expr": "SUM(DISTINCT orders.o_custkey)", "type": "integer"},
        {"name": "open_revenue", "expr": "SUMIF(CAST(orders.o_totalprice AS DECIMAL(18,2)), orders.o_orderstatus = 'O')", "time": "orders.o_orderdate"},
        {"name": "urgent_revenue", "expr": _PRICE, "where": {"field": "orders.o_orderpriority", "op": "eq", "values": ["1-URGENT"]}},
        {"name": "large_revenue", "expr": _PRICE, "where": {"field": "large_revenue", "op": "gt", "values": ["2000000"]}},
        {"name": "filled_urgent", "expr": _PRICE, "where": {"field": "orders.o_totalprice", "op": "gt", "values": ["490000"]}, "fill_zero": True},
        {"name": "sales", "expr": _PRICE, "fill_zero": True},
        {"name": "open_sales", "expr": f"{_PRICE} FILTER (WHERE orders.o_orderstatus = 'O')", "fill_zero": True},
        {"name": "open_sales_share", "expr": "open_sales / sales"},
        {"name": "orders_rows", "expr": "COUNT(*)", "dataset": "orders", "type": "integer"},
        {"name": "big_orders", "expr": "COUNT_IF(orders.o_totalprice > 300000)", "type": "integer"},
        {"name": "statuses", "expr": "LISTAGG(DISTINCT orders.o_orderstatus, ',') WITHIN GROUP (ORDER BY orders.o_orderstatus)", "type": "string"},
        {"name": "quoted_open", "expr": """MAX(CAST("orders"."o_totalprice" AS DECIMAL(18,2))) FILTER (WHERE `orders`.`o_orderstatus` = 'O')"""},
        {"name": "urgent_open", "expr": _PRICE, "stage": "pre_aggregation", "where": [{"field": "orders.o_orderpriority", "op": "eq", "values": ["1-URGENT"]}, {"field": "orders.o_orderstatus", "op": "eq", "values": ["O"]}]},
        {"name": "wide_spread", "expr": "max_price - min_price", "stage": "post_aggregation", "where": [{"field": "wide_spread", "op": "gt", "values": ["400000"]}]},
        {"name": "many_orders", "expr": "COUNT(orders.o_orderkey)", "type": "integer", "where": [{"field": "many_orders", "op": "gte", "values": ["180"]}]},
        {"name": "last_flag", "expr": "BOOL_OR(orders.o_totalprice > 480000)", "type": "boolean"},
        {"name": "top_bits", "expr": "BIT_OR(CAST(orders.o_custkey AS BIGINT))", "type": "integer", "time": "orders.o_orderdate"},
        {"name": "peak", "expr": "TRY_SUM(CAST(orders.o_totalprice AS DECIMAL(18,2)))", "time": "orders.o_orderdate", "algebra": "sum"},
        {"name": "peak_to_date", "cumulative": {"metric": "peak"}},
        {"name": "thousands", "expr": _PRICE, "scale": "0.001"},
        {"name": "balance_per_buyer", "expr": "SUM(CAST(customer.c_acctbal AS DECIMAL(18,2))) / COUNT(DISTINCT orders.o_orderkey)"},
        {"name": "price_spread", "expr": "max_price - min_price"},
        {"name": "revenue_per_order", "expr": "revenue / orders_count", "time": "orders.o_orderdate"},
        {"name": "open_share", "expr": "open_revenue / revenue", "time": "orders.o_orderdate"},
        {"name": "spread_ratio", "expr": "price_spread / revenue_per_order", "time": "orders.o_orderdate"},
        {"name": "quantity", "expr": "SUM(CAST(lineitem.l_quantity AS DECIMAL(18,2)))", "time": "lineitem.l_shipdate"},
        {"name": "lines", "expr": "COUNT(*)", "dataset": "lineitem", "type": "integer"},
        {"name": "customers_with_orders", "expr": "COUNT(DISTINCT customer.c_custkey)", "type": "integer"},
        {"name": "quantity_per_order", "expr": "quantity / orders_count"},
        {"name": "revenue_to_date", "cumulative": {"metric": "revenue"}},
        {"name": "avg_to_date", "cumulative": {"metric": "avg_price"}},
        {"name": "max_to_date", "cumulative": {"metric": "max_price"}},
        {"name": "revenue_3m", "cumulative": {"metric": "revenue", "rows": 3, "unit": "month"}},
        {"name": "revenue_qtd", "cumulative": {"metric": "revenue", "to_grain": "quarter"}},
        {"name": "revenue_prev_month", "offset": {"metric": "revenue", "count": -1, "unit": "month"}},
        {"name": "revenue_prev_quarter", "offset": {"metric": "revenue", "count": -1, "unit": "quarter"}},
        {"name": "revenue_prev_year", "offset": {"metric": "revenue", "count": -1, "unit": "year"}},
        {"name": "growth", "expr": "(revenue - revenue_prev_month) / revenue_prev_month", "time": "orders.o_orderdate"},
        {"name": "revenue_year_start", "offset_to_grain": {"metric": "revenue", "grain": "year"}},
        {"name": "fiscal_revenue", "expr": _PRICE, "time": "fiscal.f_day"},
        {"name": "fiscal_prev_week", "offset": {"metric": "fiscal_revenue", "count": -1, "unit": "fiscal_week"}},
        {"name": "fiscal_3w", "cumulative": {"metric": "fiscal_revenue", "rows": 3, "unit": "fiscal_week"}},
        {"name": "fiscal_qtd", "cumulative": {"metric": "fiscal_revenue", "to_grain": "fiscal_quarter"}},
        {"name": "fiscal_year_open", "offset_to_grain": {"metric": "fiscal_revenue", "grain": "fiscal_year"}},
        {"name": "event_value", "expr": f"SUM({_EVENT})", "time": "events.ts"},
        {"name": "event_count", "expr": "COUNT(events.event_id)", "type": "integer", "time": "events.ts"},
        {"name": "last_value", "semi_additive": {"metric": "event_value", "time": "events.ts", "tie_break": "events.event_id"}},
        {"name": "first_value", "semi_additive": {"metric": "event_value", "time": "events.ts", "tie_break": "events.event_id", "choose": "first"}},
        {"name": "last_again", "semi_additive": {"metric": "last_value", "time": "events.ts", "tie_break": "events.event_id", "choose": "first"}},
        {"name": "last_again_by_user", "semi_additive": {"metric": "last_value", "time": "events.ts", "tie_break": "events.event_id", "groupings": ["events.user_id"], "rollup": "max"}},
        {"name": "last_known", "semi_additive": {"metric": "view_value", "time": "events.ts", "tie_break": "events.event_id", "null_policy": "skip"}},
        {"name": "view_value", "expr": f"SUM(CASE WHEN events.event_type = 'view' THEN {_EVENT} END)", "time": "events.ts"},
        *[{"name": f"last_by_user_{r}", "semi_additive": {"metric": "event_value", "time": "events.ts", "tie_break": "events.event_id", "groupings": ["events.user_id"], "rollup": r}} for r in ("sum", "min", "max")],
    ],
}
_SIGNUP = {"dataset": "events", "entity": "user_id", "time": "ts", "filters": [{"field": "events.event_type", "op": "eq", "values": ["signup"]}]}
_BUY = {"dataset": "events", "entity": "user_id", "time": "ts", "filters": [{"field": "events.event_type", "op": "eq", "values": ["purchase"]}]}
MODEL["metrics"] += [
    {"name": "conversions", "type": "integer", "conversion": {"base": _SIGNUP, "event": _BUY, "output": "conversions"}},
    {"name": "conversion_rate", "type": "float", "conversion": {"base": _SIGNUP, "event": _BUY}},
    {"name": "conversions_day", "type": "integer", "conversion": {"base": _SIGNUP, "event": _BUY, "output": "conversions", "window": (1, "day")}},
]


def _days(spark: SparkSession, first: str = "1994-12-26", last: str = "2001-12-30") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def _fiscal(spark: SparkSession) -> DataFrame:
    """Weeks of seven days, quarters of 13 weeks, years of 52, from a Monday on."""
    week = F.floor(F.datediff("day", F.lit("1994-12-26").cast("date")) / 7).cast("int")
    out = _days(spark).withColumnRenamed("day", "f_day").withColumn("day", F.col("f_day"))
    for name, weeks in (("week", 1), ("quarter", 13), ("year", 52)):
        index = F.floor(week / weeks).cast("int")
        out = out.withColumns({f"{name}_start": F.date_add(F.lit("1994-12-26").cast("date"), index * weeks * 7), f"{name}_index": index.cast("long")})
    return out.drop("day")


def _tiers(events: DataFrame) -> DataFrame:
    """A version of each user from each signup to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = events.filter("event_type = 'signup'")
    out = own.select(F.col("event_id").alias("version_id"), F.col("user_id").alias("t_user"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"), (F.row_number().over(w) % 3).alias("tier"))
    return out


def engine(spark: SparkSession, sf_dir: str, spine: bool = False, policies: dict | None = None) -> Engine:
    files = tables.parquet(spark, sf_dir)

    def find(name: str) -> DataFrame:
        match name:
            case "days":
                return _days(spark)
            case "fiscal":
                return _fiscal(spark)
            case "tiers":
                return _tiers(files("events"))
        return files(name)

    document = MODEL | ({"spine": {"dataset": "days", "field": "day"}} if spine else {})
    return Engine(load(document), find, policies)


def plain(df: DataFrame) -> DataFrame:
    """Decimals and doubles as doubles of six places, so that results of other engines compare."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        columns.append(F.round(c.cast("double"), 6).alias(f.name) if isinstance(f.dataType, T.DecimalType | T.DoubleType | T.FloatType) else c)
    return df.select(*columns)


def _ask(**request) -> Callable[[SparkSession, str], DataFrame]:
    spine, policies = request.pop("spine", False), request.pop("policies", None)
    return lambda spark, sf_dir: plain(engine(spark, sf_dir, spine, policies).query(request))


def _by(grain: str, field: str = "orders.o_orderdate", alias: str = "period") -> list[dict]:
    return [{"name": field, "grain": grain, "alias": alias}]


def _f(field: str, op: str, *values: str) -> dict:
    return {"field": field, "op": op, "values": list(values)} if values else {"field": field, "op": op}


_RANGE = [_f("orders.o_orderdate", "gte", "1997-02-15"), _f("orders.o_orderdate", "lt", "1998-03-01")]
_Y97, _Y98 = ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01")
_TIME = "orders.o_orderdate"

# --- the same in SQL: d() is a decimal of money, r() a double of six places

_D = "CAST(o_totalprice AS DECIMAL(18,2))"
_C = "CAST(date_trunc('{g}', o_orderdate) AS DATE)"


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def _monthly(grain: str = "month") -> str:
    return f"m AS (SELECT {_C.format(g=grain)} AS period, SUM({_D}) AS v, COUNT({_D}) AS n FROM orders GROUP BY 1)"


_WITHIN = "period >= DATE '1997-02-15' AND period < DATE '1998-03-01'"
_FISCAL = f"""f AS (SELECT CAST(floor(date_diff('day', DATE '1994-12-26', CAST(o_orderdate AS DATE)) / 7) AS INT) AS wk, {_D} AS v FROM orders),
  s AS (SELECT wk, SUM(v) AS v FROM f GROUP BY 1),
  g AS (SELECT CAST(i AS INT) AS wk, coalesce(s.v, 0) AS v FROM range(0, 366) t(i) LEFT JOIN s ON s.wk = i)"""
_WEEK = "CAST(DATE '1994-12-26' + 7 * CAST({w} AS INT) AS DATE)"
_EV = "CAST(value AS DECIMAL(18,4))"
_MATCH = """b AS (SELECT event_id AS bid, ts AS bts, user_id FROM events WHERE event_type = 'signup'),
  e AS (SELECT event_id AS eid, ts AS ets, user_id FROM events WHERE event_type = 'purchase'),
  c AS (SELECT eid, bid, bts, row_number() OVER (PARTITION BY eid ORDER BY bts DESC, bid DESC) AS k FROM e JOIN b USING (user_id) WHERE bts <= ets {w}),
  t AS (SELECT CAST(date_trunc('day', bts) AS DATE) AS period, count(*) AS n FROM b GROUP BY 1),
  d AS (SELECT CAST(date_trunc('day', bts) AS DATE) AS period, count(*) AS n FROM c WHERE k = 1 GROUP BY 1)"""


def _last(way: str, extra: str = "", where: str = "") -> str:
    return f"(SELECT event_type, {extra} {_EV} AS v, row_number() OVER (PARTITION BY event_type{', ' + extra.strip(', ') if extra else ''} ORDER BY ts {way}, event_id {way}) AS k FROM events WHERE ts IS NOT NULL {where})"


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(analysis.compare(engine(spark, sf_dir), ["revenue", "orders_count"], ["customer.c_mktsegment"], _TIME, _Y97, _Y98))


def _additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(analysis.attribute_additive(engine(spark, sf_dir), "sales", "orders.o_orderpriority", _TIME, _Y97, _Y98))


def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(analysis.attribute_ratio(engine(spark, sf_dir), "open_sales_share", "orders.o_orderpriority", _TIME, _Y97, _Y98))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks by buyer: most buyers are in one of them alone, so segments enter and leave."""
    return plain(analysis.attribute_ratio(engine(spark, sf_dir), "open_sales_share", "customer.c_name", _TIME, ("1995-06-10", "1995-06-17"), ("1995-06-17", "1995-06-24")))


def exact(df: DataFrame) -> DataFrame:
    """Decimals as text, all places of them."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def _exact_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact(engine(spark, sf_dir).query({"metrics": ["revenue", "max_price"], "dimensions": ["nation.n_name"]}))


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).dimension_values("nation.n_name", 500, (_f("orders.o_totalprice", "gt", "480000"),), ("revenue",))[0]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).dimension_values("customer.c_mktsegment", 3)[0]


_ENTRY_EXIT = f"""WITH s AS (SELECT c_name, sum(CASE WHEN p = 0 AND o_orderstatus = 'O' THEN v ELSE 0 END) AS nb, sum(CASE WHEN p = 0 THEN v ELSE 0 END) AS db, sum(CASE WHEN p = 1 AND o_orderstatus = 'O' THEN v ELSE 0 END) AS nc, sum(CASE WHEN p = 1 THEN v ELSE 0 END) AS dc,
      bool_or(p = 0) AS b, bool_or(p = 1) AS c FROM (SELECT c_name, o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 0 ELSE 1 END AS p, {_D} AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-06-10' AND o_orderdate < TIMESTAMP '1995-06-24') GROUP BY 1),
    q AS (SELECT *, CAST(nb AS DOUBLE) / nullif(CAST(db AS DOUBLE), 0) AS rb, CAST(nc AS DOUBLE) / nullif(CAST(dc AS DOUBLE), 0) AS rc, CAST(db AS DOUBLE) / CAST(sum(db) OVER () AS DOUBLE) AS wb, CAST(dc AS DOUBLE) / CAST(sum(dc) OVER () AS DOUBLE) AS wc,
      CAST(sum(nc) OVER () AS DOUBLE) / CAST(sum(dc) OVER () AS DOUBLE) - CAST(sum(nb) OVER () AS DOUBLE) / CAST(sum(db) OVER () AS DOUBLE) AS total FROM s),
    e AS (SELECT c_name, total, CASE WHEN b AND c THEN 0.5 * (wb + wc) * (rc - rb) ELSE 0 END AS rate, CASE WHEN b AND c THEN 0.5 * (rb + rc) * (wc - wb) ELSE 0 END AS mix, CASE WHEN NOT b THEN wc * rc ELSE 0 END AS ent, CASE WHEN NOT c THEN -wb * rb ELSE 0 END AS ext FROM q)
    SELECT c_name, round(rate, 6) AS rate_effect, round(mix, 6) AS mix_effect, round(ent, 6) AS entry_effect, round(ext, 6) + 0.0 AS exit_effect, round(rate + mix + ent + ext, 6) + 0.0 AS segment_effect, round(total, 6) AS total_change,
      round(sum(rate + mix + ent + ext) OVER (), 6) AS decomposed, round(total - sum(rate + mix + ent + ext) OVER (), 6) + 0.0 AS residual, TRUE AS attribution_defined FROM e"""


def _effects() -> str:
    q = lambda a, b: f"round(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), 12)"
    return f"""WITH s AS (SELECT o_orderpriority, sum(CASE WHEN y = 1997 AND o_orderstatus = 'O' THEN v ELSE 0 END) AS nb, sum(CASE WHEN y = 1997 THEN v ELSE 0 END) AS db,
      sum(CASE WHEN y = 1998 AND o_orderstatus = 'O' THEN v ELSE 0 END) AS nc, sum(CASE WHEN y = 1998 THEN v ELSE 0 END) AS dc
      FROM (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, {_D} AS v FROM orders WHERE year(o_orderdate) IN (1997, 1998)) GROUP BY 1),
    t AS (SELECT sum(nb) AS nb, sum(db) AS db, sum(nc) AS nc, sum(dc) AS dc FROM s),
    e AS (SELECT o_orderpriority, {q('s.nb', 's.db')} AS rb, {q('s.nc', 's.dc')} AS rc, {q('s.db', 't.db')} AS wb, {q('s.dc', 't.dc')} AS wc, {q('t.nc', 't.dc')} - {q('t.nb', 't.db')} AS total FROM s CROSS JOIN t),
    f AS (SELECT *, 0.5 * (wb + wc) * (rc - rb) AS rate, 0.5 * (rb + rc) * (wc - wb) AS mix FROM e)
    SELECT o_orderpriority, round(rate, 6) AS rate_effect, round(mix, 6) AS mix_effect, CAST(0 AS DOUBLE) AS entry_effect, CAST(0 AS DOUBLE) AS exit_effect,
      round(rate + mix, 6) AS segment_effect, round(total, 6) AS total_change, round(sum(rate + mix) OVER (), 6) AS decomposed,
      round(total - sum(rate + mix) OVER (), 6) + 0.0 AS residual, TRUE AS attribution_defined FROM f"""


_JOINED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_REV = f"{_r(f'SUM({_D})')} AS revenue"

#: name -> (query, SQL)
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "simple_metric": (_ask(metrics=["revenue"]), f"SELECT {_REV} FROM orders"),
    "multiple_metrics_same_source": (_ask(metrics=["revenue", "orders_count"]), f"SELECT {_REV}, COUNT(o_orderkey) AS orders_count FROM orders"),
    "aggregation_variants": (
        _ask(metrics=["avg_price", "min_price", "max_price", "buyers", "distinct_sum"], dimensions=["orders.o_orderstatus"]),
        f"SELECT o_orderstatus, {_r(f'AVG({_D})')} AS avg_price, {_r(f'MIN({_D})')} AS min_price, {_r(f'MAX({_D})')} AS max_price, COUNT(DISTINCT o_custkey) AS buyers, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS distinct_sum FROM orders GROUP BY 1",
    ),
    "local_dimension": (_ask(metrics=["revenue"], dimensions=["orders.o_orderpriority"]), f"SELECT o_orderpriority, {_REV} FROM orders GROUP BY 1"),
    "one_hop_join": (_ask(metrics=["revenue"], dimensions=["customer.c_mktsegment"]), f"SELECT c_mktsegment, {_REV} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "multi_hop_join": (_ask(metrics=["revenue", "orders_count"], dimensions=["region.r_name"]), f"SELECT r_name, {_REV}, COUNT(o_orderkey) AS orders_count FROM {_JOINED} GROUP BY 1"),
    "multiple_joined_dimensions": (_ask(metrics=["revenue"], dimensions=["customer.c_mktsegment", "region.r_name", "orders.o_orderstatus"]), f"SELECT c_mktsegment, r_name, o_orderstatus, {_REV} FROM {_JOINED} GROUP BY 1, 2, 3"),
    "multi_hop_terminal_filter": (_ask(metrics=["revenue"], filters=[_f("region.r_name", "eq", "ASIA")]), f"SELECT {_REV} FROM {_JOINED} WHERE r_name = 'ASIA'"),
    "filters_eq_in_between_null": (
        _ask(metrics=["revenue", "orders_count"], dimensions=["orders.o_orderpriority"], filters=[_f("orders.o_orderstatus", "in", "O", "F"), _f("orders.o_orderpriority", "neq", "5-LOW"), _f("orders.o_totalprice", "between", "1000", "300000"), _f("orders.o_custkey", "is_not_null"), _f("orders.o_orderkey", "not_in", "1", "2", "3")]),
        f"SELECT o_orderpriority, {_REV}, COUNT(o_orderkey) AS orders_count FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority <> '5-LOW' AND o_totalprice BETWEEN 1000 AND 300000 AND o_custkey IS NOT NULL AND o_orderkey NOT IN (1, 2, 3) GROUP BY 1",
    ),
    "boolean_filter_tree": (
        _ask(metrics=["orders_count"], dimensions=["orders.o_orderstatus"], filters=[{"or": [{"and": [_f("orders.o_orderpriority", "eq", "1-URGENT"), _f("orders.o_totalprice", "gt", "200000")]}, {"not": _f("orders.o_orderstatus", "eq", "O")}]}]),
        "SELECT o_orderstatus, COUNT(o_orderkey) AS orders_count FROM orders WHERE (o_orderpriority = '1-URGENT' AND o_totalprice > 200000) OR NOT o_orderstatus = 'O' GROUP BY 1",
    ),
    "exists_filter": (
        _ask(metrics=["revenue", "orders_count"], filters=[{"exists": {"relationship": "line_order", "filters": [_f("lineitem.l_returnflag", "eq", "R")]}}]),
        f"SELECT {_REV}, COUNT(o_orderkey) AS orders_count FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    ),
    "metric_filter": (_ask(metrics=["revenue"], dimensions=_by("month"), filters=[_f("revenue", "gt", "20000000")]), f"SELECT {_C.format(g='month')} AS period, {_REV} FROM orders GROUP BY 1 HAVING SUM({_D}) > 20000000"),
    "metric_filter_hidden": (_ask(metrics=["orders_count"], dimensions=_by("month"), filters=[_f("revenue", "between", "20000000", "40000000")]), f"SELECT {_C.format(g='month')} AS period, COUNT(o_orderkey) AS orders_count FROM orders GROUP BY 1 HAVING SUM({_D}) BETWEEN 20000000 AND 40000000"),
    "definition_filter_pre": (
        _ask(metrics=["revenue", "urgent_revenue"], dimensions=["customer.c_mktsegment"]),
        f"SELECT c_mktsegment, {_REV}, {_r(f'''SUM({_D}) FILTER (WHERE o_orderpriority = '1-URGENT')''')} AS urgent_revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "definition_filter_post": (_ask(metrics=["large_revenue"], dimensions=_by("month")), f"SELECT {_C.format(g='month')} AS period, {_r(f'SUM({_D})')} AS large_revenue FROM orders GROUP BY 1 HAVING SUM({_D}) > 2000000"),
    "definition_filter_list": (
        _ask(metrics=["revenue", "urgent_open"], dimensions=["customer.c_mktsegment"]),
        f"SELECT c_mktsegment, {_REV}, {_r(f'''SUM({_D}) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')''')} AS urgent_open FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "definition_filter_derived": (_ask(metrics=["wide_spread"], dimensions=["nation.n_name"]), f"SELECT n_name, {_r(f'MAX({_D}) - MIN({_D})')} AS wide_spread FROM {_JOINED} GROUP BY 1 HAVING MAX({_D}) - MIN({_D}) > 400000"),
    "two_post_filters": (
        _ask(metrics=["large_revenue", "many_orders"], dimensions=_by("month")),
        f"SELECT * FROM (SELECT {_C.format(g='month')} AS period, CASE WHEN SUM({_D}) > 2000000 THEN {_r(f'SUM({_D})')} END AS large_revenue, CASE WHEN COUNT(o_orderkey) >= 180 THEN COUNT(o_orderkey) END AS many_orders FROM orders GROUP BY 1) WHERE large_revenue IS NOT NULL OR many_orders IS NOT NULL",
    ),
    "count_star": (_ask(metrics=["orders_rows", "lines"], dimensions=["orders.o_orderstatus"]), "SELECT o_orderstatus, a.n AS orders_rows, b.n AS lines FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT o_orderstatus, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) b USING (o_orderstatus)"),
    "count_if": (_ask(metrics=["big_orders", "last_flag", "statuses"], dimensions=["orders.o_orderpriority"]), "SELECT o_orderpriority, CAST(count_if(o_totalprice > 300000) AS BIGINT) AS big_orders, bool_or(o_totalprice > 480000) AS last_flag, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1"),
    "filter_clause": (_ask(metrics=["quoted_open", "open_sales"], dimensions=["orders.o_orderpriority"]), f"SELECT o_orderpriority, {_r(f'''MAX({_D}) FILTER (WHERE o_orderstatus = 'O')''')} AS quoted_open, {_r(f'''coalesce(SUM({_D}) FILTER (WHERE o_orderstatus = 'O'), 0)''')} AS open_sales FROM orders GROUP BY 1"),
    "override_rollup": (_ask(metrics=["peak_to_date"], dimensions=_by("month")), f"WITH {_monthly()} SELECT period, {_r('SUM(v) OVER (ORDER BY period)')} AS peak_to_date FROM m"),
    "is_null_filter": (_ask(metrics=["event_count"], dimensions=["events.event_type"], filters=[_f("events.k", "is_null")]), "SELECT event_type, COUNT(event_id) AS event_count FROM events WHERE json_extract_string(props, '$.k') IS NULL GROUP BY 1"),
    "exact_decimals": (_exact_metric, f"SELECT n_name, CAST(CAST(SUM({_D}) AS DECIMAL(38,18)) AS VARCHAR) AS revenue, CAST(CAST(MAX({_D}) AS DECIMAL(38,18)) AS VARCHAR) AS max_price FROM {_JOINED} GROUP BY 1"),
    "dimension_values_scoped": (_scoped, f"SELECT DISTINCT n_name FROM {_JOINED} WHERE o_totalprice > 480000 AND n_name IS NOT NULL"),
    "ratio_entry_exit": (_segments, _ENTRY_EXIT),
    "zero_fill": (
        _ask(metrics=["orders_count", "filled_urgent"], dimensions=_by("month")),
        f"SELECT {_C.format(g='month')} AS period, COUNT(o_orderkey) AS orders_count, {_r(f'coalesce(SUM({_D}) FILTER (WHERE o_totalprice > 490000), 0)')} AS filled_urgent FROM orders GROUP BY 1",
    ),
    "sum_if": (_ask(metrics=["open_revenue"], dimensions=["orders.o_orderpriority"]), f"SELECT o_orderpriority, {_r(f'''SUM(CASE WHEN o_orderstatus = 'O' THEN {_D} END)''')} AS open_revenue FROM orders GROUP BY 1"),
    "row_policy": (_ask(metrics=["revenue"], dimensions=["customer.c_mktsegment"], policies={"customer": ["c_acctbal > 0"], "orders": ["o_orderstatus <> 'P'"]}), f"SELECT c_mktsegment, {_REV} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_orderstatus <> 'P' GROUP BY 1"),
    "dims_only": (_ask(dimensions=["customer.c_mktsegment", "nation.n_name"], filters=[_f("nation.n_name", "gte", "J")]), "SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name >= 'J'"),
    "distinct_values": (_ask(dimensions=["orders.o_orderpriority"], order_by=["o_orderpriority"], intent="distinct_values"), "SELECT DISTINCT o_orderpriority FROM orders"),
    "dimension_values": (_values, "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1 LIMIT 4"),
    "top_k": (_ask(metrics=["revenue"], dimensions=["nation.n_name"], order_by=[{"field": "revenue", "direction": "desc"}, "n_name"], limit=5), f"SELECT n_name, {_REV} FROM {_JOINED} GROUP BY 1 ORDER BY SUM({_D}) DESC, 1 LIMIT 5"),
    "order_by_hidden_metric": (_ask(metrics=["orders_count"], dimensions=["nation.n_name"], order_by=[{"field": "revenue", "direction": "desc"}, "n_name"], limit=7), f"SELECT n_name, COUNT(o_orderkey) AS orders_count FROM {_JOINED} GROUP BY 1 ORDER BY SUM({_D}) DESC, 1 LIMIT 7"),
    "derived_metric": (_ask(metrics=["price_spread"], dimensions=["orders.o_orderstatus"]), f"SELECT o_orderstatus, {_r(f'MAX({_D}) - MIN({_D})')} AS price_spread FROM orders GROUP BY 1"),
    "ratio_metric": (_ask(metrics=["revenue_per_order", "open_share"], dimensions=["orders.o_orderpriority"]), f"SELECT o_orderpriority, {_r(_div(f'SUM({_D})', 'COUNT(*)'))} AS revenue_per_order, {_r(_div(f'''SUM(CASE WHEN o_orderstatus = 'O' THEN {_D} END)''', f'SUM({_D})'))} AS open_share FROM orders GROUP BY 1"),
    "ratio_empty_population_null": (_ask(metrics=["revenue_per_order"], filters=[_f("orders.o_orderstatus", "eq", "none")]), "SELECT CAST(NULL AS DOUBLE) AS revenue_per_order"),
    "nested_derived": (_ask(metrics=["spread_ratio"], dimensions=["orders.o_orderstatus"]), f"SELECT o_orderstatus, {_r(_div(f'MAX({_D}) - MIN({_D})', f'SUM({_D}) / COUNT(*)'))} AS spread_ratio FROM orders GROUP BY 1"),
    "scaled_metric": (_ask(metrics=["thousands"], dimensions=["orders.o_orderstatus"]), f"SELECT o_orderstatus, {_r(f'SUM({_D}) * 0.001')} AS thousands FROM orders GROUP BY 1"),
    "multi_dataset_expression": (_ask(metrics=["balance_per_buyer"], dimensions=["customer.c_mktsegment"]), f"SELECT c_mktsegment, {_r(_div('SUM(CAST(c_acctbal AS DECIMAL(18,2)))', 'COUNT(DISTINCT o_orderkey)'))} AS balance_per_buyer FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "multi_source_aligned": (
        _ask(metrics=["revenue", "quantity", "quantity_per_order"], dimensions=["orders.o_orderpriority"]),
        f"""WITH a AS (SELECT o_orderpriority, SUM({_D}) AS v, COUNT(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, {_r('v')} AS revenue, {_r('q')} AS quantity, {_r(_div('q', 'n'))} AS quantity_per_order FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority""",
    ),
    "multi_source_scalar": (_ask(metrics=["revenue", "quantity"]), f"SELECT (SELECT {_r(f'SUM({_D})')} FROM orders) AS revenue, (SELECT {_r('SUM(CAST(l_quantity AS DECIMAL(18,2)))')} FROM lineitem) AS quantity"),
    "duplicate_invariant_fanout": (_ask(metrics=["customers_with_orders"], filters=[_f("orders.o_totalprice", "gt", "400000")]), "SELECT COUNT(DISTINCT c_custkey) AS customers_with_orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    **{f"time_grain_{g}": (_ask(metrics=["revenue", "orders_count"], dimensions=_by(g)), f"SELECT {_C.format(g=g)} AS period, {_REV}, COUNT(*) AS orders_count FROM orders GROUP BY 1") for g in ("year", "quarter", "month", "week", "day")},
    "time_grain_hour": (_ask(metrics=["event_count"], dimensions=_by("hour", "events.ts")), "SELECT date_trunc('hour', ts) AS period, COUNT(event_id) AS event_count FROM events GROUP BY 1"),
    "time_filter": (_ask(metrics=["revenue"], dimensions=_by("month"), filters=_RANGE), f"SELECT {_C.format(g='month')} AS period, {_REV} FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-15' AND o_orderdate < TIMESTAMP '1998-03-01' GROUP BY 1"),
    "cumulative_unbounded": (_ask(metrics=["revenue_to_date"], dimensions=_by("month")), f"WITH {_monthly()} SELECT period, {_r('SUM(v) OVER (ORDER BY period)')} AS revenue_to_date FROM m"),
    "cumulative_max": (_ask(metrics=["max_to_date"], dimensions=_by("month")), f"WITH m AS (SELECT {_C.format(g='month')} AS period, MAX({_D}) AS v FROM orders GROUP BY 1) SELECT period, {_r('MAX(v) OVER (ORDER BY period)')} AS max_to_date FROM m"),
    "cumulative_by_segment": (
        _ask(metrics=["revenue_to_date"], dimensions=[*_by("quarter"), "customer.c_mktsegment"]),
        f"WITH m AS (SELECT {_C.format(g='quarter')} AS period, c_mktsegment, SUM({_D}) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT period, c_mktsegment, {_r('SUM(v) OVER (PARTITION BY c_mktsegment ORDER BY period)')} AS revenue_to_date FROM m",
    ),
    "cumulative_avg": (_ask(metrics=["avg_to_date"], dimensions=_by("month")), f"WITH {_monthly()} SELECT period, {_r(_div('SUM(v) OVER (ORDER BY period)', 'SUM(n) OVER (ORDER BY period)'))} AS avg_to_date FROM m"),
    "rolling_3_month": (_ask(metrics=["revenue_3m"], dimensions=_by("month")), f"WITH {_monthly()} SELECT period, {_r('SUM(v) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS revenue_3m FROM m"),
    "quarter_to_date": (_ask(metrics=["revenue_qtd"], dimensions=_by("month")), f"WITH {_monthly()} SELECT period, {_r('''SUM(v) OVER (PARTITION BY date_trunc('quarter', period) ORDER BY period)''')} AS revenue_qtd FROM m"),
    "cumulative_filtered": (_ask(metrics=["revenue_to_date"], dimensions=_by("month"), filters=_RANGE), f"WITH {_monthly()}, c AS (SELECT period, {_r('SUM(v) OVER (ORDER BY period)')} AS revenue_to_date FROM m) SELECT * FROM c WHERE {_WITHIN}"),
    "rolling_filtered": (_ask(metrics=["revenue_3m"], dimensions=_by("month"), filters=_RANGE), f"WITH {_monthly()}, c AS (SELECT period, {_r('SUM(v) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS revenue_3m FROM m) SELECT * FROM c WHERE {_WITHIN}"),
    "gtd_filtered": (_ask(metrics=["revenue_qtd"], dimensions=_by("month"), filters=_RANGE), f"WITH {_monthly()}, c AS (SELECT period, {_r('''SUM(v) OVER (PARTITION BY date_trunc('quarter', period) ORDER BY period)''')} AS revenue_qtd FROM m) SELECT * FROM c WHERE {_WITHIN}"),
    "offset_filtered": (_ask(metrics=["revenue_prev_month"], dimensions=_by("month"), filters=[_f(_TIME, "gte", "1997-03-01"), _f(_TIME, "lt", "1998-03-01")]), f"WITH {_monthly()} SELECT CAST(period + INTERVAL 1 MONTH AS DATE) AS period, {_r('v')} AS revenue_prev_month FROM m WHERE period >= DATE '1997-02-01' AND period < DATE '1998-02-01'"),
    **{
        f"offset_{u}": (
            _ask(metrics=["revenue", f"revenue_prev_{u}"], dimensions=_by(u)),
            f"WITH {_monthly(u)}, o AS (SELECT CAST(period + INTERVAL {n} MONTH AS DATE) AS period, v AS p FROM m) SELECT coalesce(m.period, o.period) AS period, {_r('v')} AS revenue, {_r('p')} AS revenue_prev_{u} FROM m FULL JOIN o ON m.period = o.period",
        )
        for u, n in (("month", 1), ("quarter", 3), ("year", 12))
    },
    "growth_rate": (
        _ask(metrics=["growth"], dimensions=_by("month")),
        f"WITH {_monthly()}, o AS (SELECT CAST(period + INTERVAL 1 MONTH AS DATE) AS period, v AS p FROM m) SELECT coalesce(m.period, o.period) AS period, {_r(_div('v - p', 'p'))} AS growth FROM m FULL JOIN o ON m.period = o.period",
    ),
    "offset_to_year_start": (_ask(metrics=["revenue_year_start"], dimensions=_by("month")), f"WITH {_monthly()} SELECT period, {_r('first_value(v) OVER (PARTITION BY year(period) ORDER BY period)')} AS revenue_year_start FROM m"),
    "dense_rolling": (
        _ask(metrics=["revenue_3m"], dimensions=_by("month"), spine=True),
        f"WITH {_monthly()}, s AS (SELECT DISTINCT CAST(date_trunc('month', DATE '1994-12-26' + CAST(i AS INT)) AS DATE) AS period FROM range(0, 2562) t(i)), g AS (SELECT s.period, coalesce(v, 0) AS v FROM s LEFT JOIN m ON m.period = s.period) SELECT period, {_r('SUM(v) OVER (ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS revenue_3m FROM g",
    ),
    "dense_calendar_offset": (
        _ask(metrics=["revenue_prev_month"], dimensions=_by("month"), spine=True),
        f"WITH {_monthly()}, s AS (SELECT DISTINCT CAST(date_trunc('month', DATE '1994-12-26' + CAST(i AS INT)) AS DATE) AS period FROM range(0, 2562) t(i)) SELECT CAST(s.period + INTERVAL 1 MONTH AS DATE) AS period, {_r('coalesce(v, 0)')} AS revenue_prev_month FROM s LEFT JOIN m ON m.period = s.period",
    ),
    "fiscal_group": (_ask(metrics=["fiscal_revenue"], dimensions=_by("fiscal_quarter", "fiscal.f_day")), f"WITH {_FISCAL} SELECT {_WEEK.format(w='13 * (wk // 13)')} AS period, {_r('SUM(v)')} AS fiscal_revenue FROM f GROUP BY 1"),
    "fiscal_offset": (_ask(metrics=["fiscal_prev_week"], dimensions=_by("fiscal_week", "fiscal.f_day")), f"WITH {_FISCAL} SELECT {_WEEK.format(w='wk + 1')} AS period, {_r('v')} AS fiscal_prev_week FROM g WHERE wk < 365"),
    "fiscal_rolling": (_ask(metrics=["fiscal_3w"], dimensions=_by("fiscal_week", "fiscal.f_day")), f"WITH {_FISCAL} SELECT {_WEEK.format(w='wk')} AS period, {_r('SUM(v) OVER (ORDER BY wk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS fiscal_3w FROM g"),
    "fiscal_qtd": (_ask(metrics=["fiscal_qtd"], dimensions=_by("fiscal_week", "fiscal.f_day")), f"WITH {_FISCAL} SELECT {_WEEK.format(w='wk')} AS period, {_r('SUM(v) OVER (PARTITION BY wk // 13 ORDER BY wk)')} AS fiscal_qtd FROM g"),
    "fiscal_year_start": (_ask(metrics=["fiscal_year_open"], dimensions=_by("fiscal_week", "fiscal.f_day")), f"WITH {_FISCAL} SELECT {_WEEK.format(w='wk')} AS period, {_r('first_value(v) OVER (PARTITION BY wk // 52 ORDER BY wk)')} AS fiscal_year_open FROM g"),
    "semi_last": (_ask(metrics=["last_value"], dimensions=["events.event_type"]), f"SELECT event_type, {_r('v')} AS last_value FROM {_last('DESC')} WHERE k = 1"),
    "semi_first": (_ask(metrics=["first_value"], dimensions=["events.event_type"]), f"SELECT event_type, {_r('v')} AS first_value FROM {_last('ASC')} WHERE k = 1"),
    "semi_composed": (_ask(metrics=["last_again"], dimensions=["events.event_type"]), f"SELECT event_type, {_r('v')} AS last_again FROM {_last('DESC')} WHERE k = 1"),
    "semi_composed_window": (_ask(metrics=["last_again_by_user"], dimensions=["events.event_type"]), f"SELECT event_type, {_r('max(v)')} AS last_again_by_user FROM {_last('DESC', 'user_id, ')} WHERE k = 1 GROUP BY 1"),
    "semi_skip_null": (_ask(metrics=["last_known"]), f"SELECT {_r('v')} AS last_known FROM {_last('DESC', where=''' AND event_type = 'view' AND value IS NOT NULL''')} WHERE k = 1"),
    **{f"semi_window_{r}": (_ask(metrics=[f"last_by_user_{r}"], dimensions=["events.event_type"]), f"SELECT event_type, {_r(f'{r}(v)')} AS last_by_user_{r} FROM {_last('DESC', 'user_id, ')} WHERE k = 1 GROUP BY 1") for r in ("sum", "min", "max")},
    "semi_by_week": (
        _ask(metrics=["last_value"], dimensions=_by("week", "events.ts")),
        f"SELECT period, {_r('v')} AS last_value FROM (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, {_EV} AS v, row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    ),
    "conversion_count": (_ask(metrics=["conversions"], dimensions=_by("day", "events.ts")), f"WITH {_MATCH.format(w='')} SELECT t.period, coalesce(d.n, 0) AS conversions FROM t LEFT JOIN d ON t.period = d.period"),
    "conversion_rate": (_ask(metrics=["conversion_rate"], dimensions=_by("day", "events.ts")), f"WITH {_MATCH.format(w='')} SELECT t.period, {_r(_div('coalesce(d.n, 0)', 't.n'))} AS conversion_rate FROM t LEFT JOIN d ON t.period = d.period"),
    "conversion_window": (_ask(metrics=["conversions_day"], dimensions=_by("day", "events.ts")), f"WITH {_MATCH.format(w='AND bts >= ets - INTERVAL 1 DAY')} SELECT t.period, coalesce(d.n, 0) AS conversions_day FROM t LEFT JOIN d ON t.period = d.period"),
    "as_of_join": (
        _ask(metrics=["event_count"], dimensions=["tiers.tier"]),
        "WITH v AS (SELECT user_id AS u, ts AS a, lead(ts) OVER w AS b, CAST(row_number() OVER w % 3 AS BIGINT) AS tier FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT tier, COUNT(event_id) AS event_count FROM events JOIN v ON user_id = u AND ts >= a AND coalesce(ts < b, TRUE) GROUP BY 1",
    ),
    "compare_periods": (
        _compare,
        f"""WITH p AS (SELECT c_mktsegment, SUM(CASE WHEN y = 1997 THEN v END) AS rb, SUM(CASE WHEN y = 1998 THEN v END) AS rc, SUM(CASE WHEN y = 1997 THEN 1 END) AS nb, SUM(CASE WHEN y = 1998 THEN 1 END) AS nc FROM (SELECT c_mktsegment, year(o_orderdate) AS y, {_D} AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN (1997, 1998)) GROUP BY 1)
        SELECT c_mktsegment, {_r('rb')} AS revenue_baseline, {_r('rc')} AS revenue_current, {_r('rc - rb')} AS revenue_delta, {_r('100 * ' + _div('rc - rb', 'rb'))} AS revenue_percent, TRUE AS revenue_change_defined, TRUE AS revenue_percent_defined,
        CAST(nb AS BIGINT) AS orders_count_baseline, CAST(nc AS BIGINT) AS orders_count_current, {_r('nc - nb')} AS orders_count_delta, {_r('100 * ' + _div('nc - nb', 'nb'))} AS orders_count_percent, TRUE AS orders_count_change_defined, TRUE AS orders_count_percent_defined FROM p""",
    ),
    "additive_attribution": (
        _additive,
        f"""WITH p AS (SELECT o_orderpriority, SUM(CASE WHEN y = 1997 THEN v ELSE 0 END) AS b, SUM(CASE WHEN y = 1998 THEN v ELSE 0 END) AS c FROM (SELECT o_orderpriority, year(o_orderdate) AS y, {_D} AS v FROM orders WHERE year(o_orderdate) IN (1997, 1998)) GROUP BY 1)
        SELECT o_orderpriority, {_r('b')} AS baseline, {_r('c')} AS current, {_r('c - b')} AS delta, {_r('SUM(c - b) OVER ()')} AS total_delta, {_r('100 * ' + _div('c - b', 'SUM(c - b) OVER ()'))} AS contribution FROM p""",
    ),
    "ratio_attribution": (_ratio, _effects()),
    "json_path_dimension": (_ask(metrics=["event_count"], dimensions=["events.k"]), "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COUNT(event_id) AS event_count FROM events GROUP BY 1"),
}
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, orders and revenue per order by market segment and month."""
    return _ask(metrics=["revenue", "orders_count", "revenue_per_order"], dimensions=["customer.c_mktsegment", *_by("month")])(spark, sf_dir)
