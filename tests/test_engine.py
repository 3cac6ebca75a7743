"""Rejections, small hand-computed answers, and plan shapes of the engine."""

from datetime import date

import pytest

from quernel import queries
from quernel.errors import EngineError
from quernel.functions.expressions import aggregates, names_in, spark_sql
from quernel.model import load
from quernel.operators import analysis
from quernel.plans.engine import Engine, bounded
from quernel.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sales(spark):
    return queries.engine(spark, SF)


@pytest.fixture(scope="module")
def small(spark):
    orders = spark.createDataFrame([(1, "a", date(2024, 1, 31), 100, "paid"), (2, "b", date(2024, 3, 31), 50, None), (3, "x", date(2024, 3, 1), 7, "paid"), (4, "a", date(2024, 3, 2), None, "open")], "id long, customer string, day date, amount long, status string")
    customers = spark.createDataFrame([("a", "north"), ("b", "south")], "customer string, region string")
    document = {
        "name": "m",
        "datasets": [
            {"name": "orders", "source": "orders", "primary_key": ["id"], "fields": [{"name": "id", "type": "integer"}, "customer", {"name": "day", "type": "date"}, {"name": "amount", "type": "integer"}, {"name": "status", "type": "string"}]},
            {"name": "customers", "source": "customers", "primary_key": ["customer"], "fields": ["customer", {"name": "region", "type": "string"}]},
            {"name": "calendar", "source": "calendar", "fields": [{"name": "d", "type": "date"}]},
        ],
        "relationships": [{"name": "oc", "left": "orders", "right": "customers", "left_columns": ["customer"], "right_columns": ["customer"]}],
        "metrics": [
            {"name": "total", "expr": "SUM(orders.amount)", "type": "integer", "time": "orders.day"},
            {"name": "running", "cumulative": {"metric": "total"}, "type": "integer"},
            {"name": "last_two", "cumulative": {"metric": "total", "rows": 2, "unit": "month"}, "type": "integer"},
            {"name": "before", "offset": {"metric": "total", "count": -1, "unit": "month"}, "type": "integer"},
            {"name": "per_customer", "expr": "SUM(customers.customer)", "type": "integer"},
        ],
        "spine": {"dataset": "calendar", "field": "d"},
    }
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-03-31')) AS d")
    return Engine(load(document), tables.frames({"orders": orders, "customers": customers, "calendar": days}))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_unmatched_facts_and_null_groups(small):
    assert _rows(small.query({"metrics": ["total"]})) == [(157,)]
    assert _rows(small.query({"metrics": ["total"], "dimensions": ["customers.region"]})) == [("north", 100), ("south", 50)]
    assert _rows(small.query({"metrics": ["total"], "dimensions": ["status"]})) == [("open", None), ("paid", 107), (None, 50)]
    assert _rows(small.query({"metrics": ["total"], "filters": [{"not": {"field": "status", "op": "eq", "values": ["paid"]}}]})) == [(None,)]


def test_spine_fills_missing_months(small):
    month = [{"name": "orders.day", "grain": "month"}]
    ask = lambda m: [r[1] for r in sorted(small.query({"metrics": [m], "dimensions": month}).collect())]
    assert ask("running") == [100, 100, 157] and ask("last_two") == [100, 100, 57] and ask("before") == [100, 0, 57]


@pytest.mark.parametrize(
    "request_, code",
    [
        ({}, "EMPTY_REQUEST"),
        ({"metrics": ["nope"]}, "UNKNOWN_METRIC"),
        ({"metrics": ["revenue"], "limit": 0}, "INVALID_LIMIT"),
        ({"metrics": ["revenue"], "more": 1}, "UNKNOWN_KEY"),
        ({"metrics": ["revenue"], "filters": [{"field": "orders.o_orderkey", "op": "in", "values": []}]}, "INVALID_FILTER"),
        ({"metrics": ["revenue"], "filters": [{"or": [{"field": "orders.o_orderstatus", "op": "is_null"}]}]}, "INVALID_FILTER"),
        ({"metrics": ["revenue"], "filters": [{"not": {"exists": {"relationship": "line_order"}}}]}, "INVALID_EXISTS"),
        ({"metrics": ["revenue"], "filters": [{"field": "revenue", "op": "eq", "values": ["1"]}]}, "INVALID_FILTER"),
        ({"metrics": ["revenue"], "dimensions": ["part.p_brand"]}, "UNSUPPORTED_RELATIONSHIP_FANOUT"),
        ({"metrics": ["revenue_3m"], "dimensions": [{"name": "orders.o_orderdate", "grain": "week"}]}, "INCOMPATIBLE_GRAIN"),
        ({"metrics": ["revenue_to_date"]}, "MISSING_TIME_DIMENSION"),
        ({"metrics": ["revenue_to_date"], "dimensions": [{"name": "orders.o_orderdate", "grain": "month"}, {"name": "orders.o_day", "grain": "week"}]}, "CONFLICTING_TIME_DIMENSION"),
        ({"metrics": ["revenue"], "filters": [{"not": {"field": "revenue", "op": "gt", "values": ["1"]}}]}, "INVALID_FILTER"),
        ({"metrics": ["revenue"], "filters": [{"not": {"field": "orders.o_orderdate", "op": "gt", "values": ["1997-01-01"]}}]}, "INVALID_FILTER"),
        ({"metrics": ["quantity_per_order"], "filters": [{"not": {"field": "orders.o_orderstatus", "op": "eq", "values": ["O"]}}]}, "UNSUPPORTED_FILTER"),
        ({"metrics": ["conversions"], "filters": [{"not": {"field": "events.user_id", "op": "eq", "values": ["1"]}}]}, "UNSUPPORTED_FILTER"),
        ({"metrics": ["revenue"], "dimensions": ["customer.c_mktsegment"], "filters": [{"exists": {"relationship": "order_customer"}}]}, "INVALID_EXISTS"),
        ({"metrics": ["event_count"], "filters": [{"exists": {"relationship": "event_tier"}}]}, "INVALID_EXISTS"),
        ({"metrics": ["last_value"], "filters": [{"exists": {"relationship": "event_tier"}}]}, "INVALID_EXISTS"),
        ({"metrics": ["conversions"], "dimensions": ["orders.o_orderstatus"]}, "INVALID_CONVERSION"),
        ({"metrics": ["revenue"], "dimensions": ["orders.o_orderstatus"], "intent": "distinct_values"}, "INVALID_INTENT"),
    ],
)
def test_rejections(sales, request_, code):
    with pytest.raises(EngineError) as e:
        sales.query(request_)
    assert e.value.code == code


def test_models_that_are_rejected():
    fields = [{"name": "x", "type": "integer"}]
    for metrics, code in (
        ([{"name": "a", "expr": "SUM(AVG(d.x))"}], "NESTED_AGGREGATE"),
        ([{"name": "a", "expr": "b + 1"}, {"name": "b", "expr": "a + 1"}], "METRIC_CYCLE"),
        ([{"name": "a", "expr": "d.x + 1"}], "INVALID_METRIC"),
        ([{"name": "a", "expr": "SUM(d.x) + d.x"}], "MIXED_AGGREGATE"),
        ([{"name": "a", "expr": "SUM(d.x)"}, {"name": "b", "semi_additive": {"metric": "a", "time": "d.x", "groupings": ["d.x"]}}, {"name": "c", "semi_additive": {"metric": "b", "time": "d.x"}}], "INVALID_SEMI_ADDITIVE"),
        ([{"name": "a", "expr": "SUM(d.x)", "about": {"odd": 1}}], "UNKNOWN_KEY"),
        ([{"name": "a", "expr": "SUM(d.x)", "odd": 1}], "UNKNOWN_KEY"),
    ):
        with pytest.raises(EngineError) as e:
            load({"name": "m", "datasets": [{"name": "d", "source": "d", "fields": fields}], "metrics": metrics})
        assert e.value.code == code


def test_two_shortest_paths_are_ambiguous():
    fields = [{"name": "k", "type": "integer"}]
    edge = lambda n, a, b: {"name": n, "left": a, "right": b, "left_columns": ["k"], "right_columns": ["k"]}
    model = load({"name": "m", "datasets": [{"name": n, "source": n, "primary_key": ["k"], "fields": fields} for n in "abcd"], "relationships": [edge("1", "a", "b"), edge("2", "a", "c"), edge("3", "b", "d"), edge("4", "c", "d")]})
    with pytest.raises(EngineError) as e:
        model.path("a", "d")
    assert e.value.code == "AMBIGUOUS_RELATIONSHIP_PATH"


def test_expressions():
    assert names_in("SUM(a.b) + COALESCE(c, 'x y') * 2") == ["a.b", "c"]
    assert spark_sql("SUMIF(a, b = 'x,)') / 2") == "SUM(CASE WHEN b = 'x,)' THEN a END) / 2"
    call = aggregates("COUNT(DISTINCT o.k)")[0]
    assert call.ignores_duplicates and call.merge is None and call.whole


def test_metrics_of_one_source_share_a_scan_and_read_few_columns(sales):
    plan = sales.query({"metrics": ["revenue", "orders_count", "open_revenue"], "filters": [{"field": "orders.o_orderstatus", "op": "eq", "values": ["O"]}]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(o_orderstatus,O)" in plan and "o_orderdate" not in plan
    assert sales.explain({"metrics": ["revenue_per_order"]})["shared"] == [["revenue", "orders_count"]]


def test_policies_reach_every_read(spark):
    own = queries.engine(spark, SF, policies={"orders": ["o_orderstatus = 'F'"]})
    assert [r[0] for r in own.query({"dimensions": ["orders.o_orderstatus"]}).collect()] == ["F"]


def test_attributions_add_up(sales):
    for f, m in ((analysis.attribute_additive, "sales"), (analysis.attribute_ratio, "open_sales_share")):
        assert analysis.inconsistencies(f(sales, m, "orders.o_orderpriority", "orders.o_orderdate", ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01"))).count() == 0
    with pytest.raises(EngineError):
        analysis.attribute_additive(sales, "avg_price", "orders.o_orderpriority", "orders.o_orderdate", ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01"))


def test_bounded_results_and_discovery(sales):
    with pytest.raises(EngineError):
        bounded(sales.query({"dimensions": ["nation.n_name"]}), 3)
    df, cut = sales.dimension_values("region.r_name", 2)
    assert cut(df.collect()) and sales.compatible_dimensions(["revenue"])["region.r_name"] == "compatible"
    assert sales.compatible_dimensions(["revenue"])["part.p_brand"] == "unreachable"


def test_results_end_after_their_time(spark):
    slow = spark.range(1 << 40).selectExpr("sum(hash(id)) AS s")
    with pytest.raises(EngineError) as e:
        bounded(slow, 1, seconds=2)
    assert e.value.code == "EXECUTION_TIMEOUT" and bounded(spark.range(3), 3, seconds=60) and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_scaffold_loads(spark):
    files = tables.parquet(spark, SF)
    document = tables.scaffold("m", tables.inspect(files, ["orders"]), {"orders": ["o_orderkey", "o_totalprice"]}, row_count=True)
    own = Engine(load(document), files)
    assert own.query({"metrics": ["orders_rows"]}).first()[0] == files("orders").count()
