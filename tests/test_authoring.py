"""Search, ontologies, differences and findings of small models."""

import copy
import json

import pytest

from quernel import queries
from quernel.discovery import Index, Ontology
from quernel.errors import EngineError
from quernel.model import load
from quernel.review import RULES, difference, formatted, review

DOCUMENT = {
    "name": "m",
    "datasets": [
        {"name": "sales", "source": "sales", "primary_key": ["k"], "fields": [{"name": "k", "type": "integer"}, {"name": "net_amount", "type": "decimal"}]},
        {"name": "alone", "source": "alone", "fields": ["z"]},
    ],
    "metrics": [
        {"name": "turnover", "expr": "SUM(sales.net_amount)", "about": {"aliases": ["gross sales"], "description": "money taken"}},
        {"name": "takings", "expr": "SUM(sales.net_amount)", "about": {"aliases": ["Gross-Sales"], "lifecycle": "deprecated"}},
        {"name": "gross_sales", "expr": "COUNT(sales.k)", "about": {"certification": "certified", "expects": {"aggregation": "sum"}}},
        {"name": "stars", "expr": "COUNT(*)", "type": "integer"},
    ],
}


def test_search_is_ranked_and_paged():
    index = Index(load(DOCUMENT))
    found = index.search("gross sales")
    assert [a.reference for a in found.items] == ["metric.gross_sales", "metric.takings", "metric.turnover", "sales", "sales.k", "sales.net_amount"][: len(found.items)]
    page = index.search("gross sales", ("metric",), limit=2)
    assert page.next == 2 and [a.name for a in index.search("gross sales", ("metric",), 2, page.next).items] == ["turnover"]
    assert [a.name for a in index.list("dataset").items] == ["alone", "sales"] and index.get("field", "sales.k").name == "k"
    for bad in (lambda: index.search(" "), lambda: index.search("x", limit=0), lambda: index.get("metric", "no")):
        with pytest.raises(EngineError):
            bad()


def test_ontology():
    model = load(DOCUMENT)
    concepts = [{"name": "Party", "description": "who acts"}, {"name": "Customer", "extends": ["Party"]}, {"name": "Member", "extends": ["customer"]}]
    own = Ontology.load(model, concepts, [{"concept": "Customer", "field": "sales.k"}, {"concept": "member", "field": "alone.z"}])
    assert [(c.field, c.match) for c in own.resolve("CUSTOMER").items] == [("alone.z", "descendant"), ("sales.k", "direct")]
    assert [c.concept for c in own.resolve("Party").items] == ["Member", "Customer"] and [c.field for c in own.resolve("Member").items] == ["alone.z"]
    assert own.resolve("Integer").items == [] and [c.name for c in own.search("party").items] == ["Party", "Customer"]
    for wrong in ([{"name": "A", "extends": ["B"]}], [{"name": "A", "extends": ["B"]}, {"name": "B", "extends": ["A"]}], [{"name": "A"}, {"name": "a"}]):
        with pytest.raises(EngineError):
            Ontology.load(model, wrong, [])


def test_difference_and_form():
    other = copy.deepcopy(DOCUMENT)
    other["metrics"][0]["scale"] = "0.1"
    other["metrics"].pop()
    other["datasets"][1]["fields"].append({"name": "y"})
    got = [(c.change, c.reference) for c in difference(load(DOCUMENT), load(other))]
    assert got == [("modified", "dataset/alone"), ("added", "dataset/alone/field/y"), ("removed", "metric/stars"), ("modified", "metric/turnover")]
    assert difference(load(DOCUMENT), load(DOCUMENT)) == []
    text = formatted(DOCUMENT)
    assert formatted(json.loads(text)) == text and difference(load(DOCUMENT), load(json.loads(text))) == []


def test_findings():
    found, passed = review(load(DOCUMENT))
    got = {(f.code, f.asset) for f in found}
    assert passed and got == {
        ("EQUIVALENT_METRIC_DEFINITION", "metric/takings"),
        ("ALIAS_CONFLICT", "metric/takings"),
        ("DISCOVERY_IDENTITY_COLLISION", "metric/gross_sales"),
        ("DISCONNECTED_DATASET", "dataset/alone"),
        ("UNREACHABLE_DIMENSION", "dataset/alone/field/z"),
        ("METRIC_SOURCE_UNRESOLVED", "metric/stars"),
        ("METRIC_TYPE_MISMATCH", "metric/gross_sales"),
        ("METRIC_AGGREGATION_MISMATCH", "metric/gross_sales"),
        ("DEPRECATED_WITHOUT_REPLACEMENT", "metric/takings"),
        ("CERTIFIED_WITHOUT_OWNER", "metric/gross_sales"),
    }
    assert not review(load(DOCUMENT), {"ALIAS_CONFLICT": "error"})[1] and not review(load(DOCUMENT), threshold="warning")[1]
    with pytest.raises(EngineError):
        review(load(DOCUMENT), {"NO_RULE": "error"})
    assert {f.code for f in review(load(queries.MODEL))[0]} <= set(RULES)
