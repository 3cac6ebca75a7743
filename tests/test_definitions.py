"""Definition filters, aggregates of all kinds, exact quotients, admissibility, literals and hot conversions."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quernel import queries
from quernel.errors import EngineError
from quernel.functions.expressions import aggregates, names_in, only
from quernel.model import load
from quernel.operators import analysis, frames
from quernel.plans.engine import Engine, bounded, typed


def document(*metrics: dict) -> dict:
    fields = [{"name": "id", "type": "integer"}, {"name": "g", "type": "string"}, {"name": "x", "type": "integer"}, {"name": "y", "type": "integer"}]
    return {"name": "m", "datasets": [{"name": "o", "source": "o", "primary_key": ["id"], "fields": fields}], "metrics": [{"type": "integer"} | m for m in metrics]}


@pytest.fixture(scope="module")
def ask(spark):
    rows = spark.createDataFrame([(1, "a", 5, 10), (2, "a", 7, 0), (3, "b", 4, 1), (4, "c", 2, None)], "id long, g string, x long, y long")

    def of(metrics: list[dict], names: list[str], **request) -> list[tuple]:
        got = Engine(load(document(*metrics)), lambda _: rows).query({"metrics": names, "dimensions": ["o.g"]} | request)
        return sorted((tuple(r) for r in got.collect()), key=repr)

    return of


A, B = {"name": "a", "expr": "SUM(o.x)"}, {"name": "b", "expr": "SUM(o.y)"}


def test_post_filter_of_a_derived_metric(ask):
    dd = {"name": "dd", "expr": "a + b", "stage": "post_aggregation", "where": [{"field": "dd", "op": "gt", "values": ["5"]}]}
    assert ask([A, B, dd], ["dd"]) == [("a", 22)]
    assert ask([A, B, dd], ["a", "dd"]) == [("a", 12, 22), ("b", 4, None), ("c", 2, None)]
    assert ask([A, B, dd], ["dd"], dimensions=[]) == [(29,)]


def test_two_post_filters_leave_no_ghost_rows(ask):
    both = [{"name": n, "expr": f"SUM(o.{c})", "where": {"field": n, "op": "gt", "values": ["100"]}} for n, c in (("sx", "x"), ("sy", "y"))]
    assert ask(both, ["sx", "sy"]) == []
    both[0]["where"] = {"field": "sx", "op": "gt", "values": ["3"]}
    assert ask(both, ["sx", "sy"]) == [("a", 12, None), ("b", 4, None)]


def test_pre_filters_join_the_shared_pass(ask):
    few = {"name": "few", "expr": "COUNT(o.id)", "where": [{"field": "o.x", "op": "gt", "values": ["4"]}, {"field": "o.y", "op": "gt", "values": ["0"]}]}
    assert ask([A, few], ["a", "few"]) == [("a", 12, 1), ("b", 4, None), ("c", 2, None)]
    assert ask([A, few], ["few"]) == [("a", 1)]
    assert ask([A, few], ["a", "few"], dimensions=[]) == [(18, 1)]


@pytest.mark.parametrize("bad", [
    {"where": [], "stage": "pre_aggregation"}, {"where": {"field": "o.x", "op": "gt", "values": ["1"]}, "stage": "later"},
    {"where": {"field": "o.x", "op": "gt", "values": ["1"]}, "stage": "post_aggregation"}, {"where": {"field": "o.none", "op": "is_null"}},
    {"expr": "a * 1", "where": {"field": "o.x", "op": "gt", "values": ["1"]}}, {"where": {"and": []}},
])
def test_definition_filters_that_are_rejected(bad):
    with pytest.raises(EngineError):
        load(document(A, {"name": "z", "expr": "SUM(o.x)"} | bad))


def test_aggregates_of_all_kinds(ask):
    more = [{"name": "n", "expr": "COUNT(*)"}, {"name": "f", "expr": "SUM(o.x) FILTER (WHERE o.y > 0)"}, {"name": "i", "expr": "COUNT_IF(`o`.`x` > 4)"}, {"name": "q", "expr": 'MAX("o"."x")'}]
    assert ask(more, ["n", "f", "i", "q"]) == [("a", 2, 5, 2, 7), ("b", 1, 4, 0, 4), ("c", 1, None, 0, 2)]
    assert [c.name for c in aggregates("LISTAGG(o.x, ',') WITHIN GROUP (ORDER BY o.y) || COLLECT_SET(o.x)")] == ["LISTAGG", "COLLECT_SET"]
    assert names_in("v:a.b::int + transform(o.x, q -> q + 1) + INTERVAL 1 DAY") == ["v", "o.x"]
    assert only("SUM(o.x) FILTER (WHERE o.y > 0) + COUNT(*)", "k") == "SUM(o.x) FILTER (WHERE k AND (o.y > 0)) + COUNT(*) FILTER (WHERE k)"


def test_count_of_rows_needs_a_dataset():
    two = document({"name": "n", "expr": "COUNT(*)"})
    two["datasets"].append({"name": "p", "source": "p", "fields": ["k"]})
    with pytest.raises(EngineError, match="INVALID_METRIC"):
        load(two).metric_datasets("n")


def test_algebra_override_lets_an_aggregate_roll_up(spark):
    rows = spark.sql("SELECT DATE'2024-01-05' d, 3L x UNION ALL SELECT DATE'2024-02-05', 5L")
    for algebra, fine in (("max", True), (None, False)):
        doc = document({"name": "top", "expr": "BIT_OR(o.x)", "time": "o.d", "algebra": algebra}, {"name": "run", "cumulative": {"metric": "top"}})
        doc["datasets"][0]["fields"] = [{"name": "d", "type": "date"}, {"name": "x", "type": "integer"}]
        doc["datasets"][0]["primary_key"] = ["d"]
        ask = lambda: Engine(load(doc), lambda _: rows).query({"metrics": ["run"], "dimensions": [{"name": "o.d", "grain": "month"}]}).collect()  # noqa: B023, E731
        if fine:
            assert sorted(r["run"] for r in ask()) == [3, 5]
        else:
            with pytest.raises(EngineError, match="INVALID_METRIC_ROLLUP"):
                ask()


@pytest.mark.parametrize(("expr", "kind"), [
    ("a + b", "additive"), ("-a * 2 / 4", "additive"), ("(a + b) * b", None), ("a / (b)", ("a", "b")), ("abs(a)", None), ("a / 0", None), ("a * b", None), ("(a + b) / b", None), ("SUM(o.x) - COUNT(o.y)", "additive"), ("AVG(o.x)", None),
])
def test_what_decomposes(expr, kind):
    engine = Engine(load(document(A, B, {"name": "z", "expr": expr})), lambda _: None)
    assert analysis.decomposition(engine, "z") == kind


def test_comparison_is_exact(spark):
    rows = spark.sql("SELECT 1L id, 'a' g, DATE'2024-01-01' d, 3L x UNION ALL SELECT 2L, 'a', DATE'2024-02-01', 4L UNION ALL SELECT 3L, NULL, DATE'2024-02-02', 9L")
    doc = document({"name": "s", "expr": "SUM(CAST(o.x AS DECIMAL(20,2)))", "type": "decimal"})
    doc["datasets"][0]["fields"] = [{"name": "id", "type": "integer"}, {"name": "g", "type": "string"}, {"name": "d", "type": "date"}, {"name": "x", "type": "integer"}]
    got = analysis.compare(Engine(load(doc), lambda _: rows), ["s"], ["o.g"], "o.d", ("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-03-01"))
    first, last = got.collect()
    assert (first["g"], str(first["s_delta"]), str(first["s_percent"])) == ("a", "1.000000000000000000", "33.333333333333333333")
    assert (last["g"], last["s_baseline"], last["s_percent"], last["s_change_defined"]) == (None, None, None, False)


def test_attribution_needs_zero_fill_and_one_population(spark):
    sales = queries.engine(spark, "/root/testdata/sf0.001")
    weeks = ("1995-06-10", "1995-06-17"), ("1995-06-17", "1995-06-24")
    for metric in ("revenue", "max_price"):
        with pytest.raises(EngineError, match="UNSUPPORTED_ATTRIBUTION"):
            analysis.attribute_additive(sales, metric, "orders.o_orderpriority", "orders.o_orderdate", *weeks)
    got = analysis.attribute_ratio(sales, "open_sales_share", "customer.c_name", "orders.o_orderdate", *weeks)
    assert got.filter("entry_effect <> 0 OR exit_effect <> 0").count() > 0
    assert analysis.inconsistencies(got).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("orders.parquet") + plan.count("Relation") <= 4 and "Join Cross" not in plan


def test_quotients_are_exact(spark):
    cases = [("1", "3"), ("-200", "3"), ("2", "-7"), ("12345678901234567", "997"), ("5", "0"), ("1", "1000000000000000000"), ("0", "9")]
    df = spark.createDataFrame(cases, "a string, b string").select("a", "b", analysis.exact_quotient(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")).cast("string").alias("q"))
    for a, b, q in df.collect():
        if b == "0":
            assert q is None
            continue
        f = Fraction(int(a), int(b)) * 10**18
        whole = int(abs(f) + Fraction(1, 2)) * (1 if f >= 0 else -1)
        assert Fraction(q) * 10**18 == whole, (a, b, q)


@pytest.mark.parametrize(("value", "kind"), [("1.5", "integer"), ("x", "integer"), ("nan", "decimal"), ("inf", "float"), ("yes", "boolean"), ("2024-13-01", "date"), ("2024-01-01T00:00:00+01:00", "datetime"), ("25:00", "time")])
def test_literals_of_the_wrong_type(value, kind):
    with pytest.raises(EngineError, match="INVALID_FILTER"):
        typed(value, kind)


def test_a_hot_conversion_key_costs_its_rows(spark):
    n = 20000
    base = spark.range(n).select(F.lit(1).alias("bk"), (F.col("id") * 2).alias("bt"), F.col("id").alias("bid"))
    events = spark.range(n).select(F.lit(1).alias("ek"), (F.col("id") * 2 + 1).alias("et"), F.col("id").alias("eid"))
    got = frames.match_conversions(base, events, [("bk", "ek")], "bt", "et", ["bid"], ["eid"], None)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.filter("bid = eid").count() == n == got.count()


def test_bytes_are_bounded_before_rows_are_sent(spark):
    df = spark.range(100).select("id", F.lit("x" * 100).alias("v"))
    assert len(bounded(df, 100, most_bytes=100_000)) == 100 and set(bounded(df, 100, most_bytes=100_000)[0].asDict()) == {"id", "v"}
    with pytest.raises(EngineError, match="RESULT_TOO_LARGE"):
        bounded(df, 100, most_bytes=500)
