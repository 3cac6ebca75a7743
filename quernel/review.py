"""Looking after model documents: one form, what changed between two, and findings about quality."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from dataclasses import asdict, dataclass

from quernel.discovery import plain
from quernel.errors import EngineError
from quernel.functions.expressions import aggregates
from quernel.model import Dataset, Field, Metric, Model, load

SEVERITIES = ("info", "warning", "error")
RULES = (
    "EQUIVALENT_METRIC_DEFINITION", "ALIAS_CONFLICT", "DISCOVERY_IDENTITY_COLLISION", "DISCONNECTED_DATASET", "UNREACHABLE_DIMENSION", "AMBIGUOUS_RELATIONSHIP_PATH",
    "METRIC_SOURCE_UNRESOLVED", "METRIC_TYPE_MISMATCH", "METRIC_AGGREGATION_MISMATCH", "METRIC_EXPRESSION_INCONSISTENT", "DEPRECATED_WITHOUT_REPLACEMENT", "CERTIFIED_WITHOUT_OWNER",
)


@dataclass(frozen=True)
class Change:
    kind: str
    reference: str
    change: str  # added, removed or modified
    before: str | None = None
    after: str | None = None


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    asset: str
    related: tuple[str, ...] = ()
    detail: str = ""


def formatted(document: dict) -> str:
    """A valid document in one form: keys in a fixed order, defaults left out."""
    load(document)

    def tidy(x: object) -> object:
        if isinstance(x, dict):
            ordered = sorted(x, key=lambda k: (k != "name", k))
            return {k: tidy(x[k]) for k in ordered if x[k] not in (None, [], {})}
        return [tidy(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(tidy(document), indent=2, ensure_ascii=False) + "\n"


def _digest(x: object) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()


def _assets(model: Model) -> dict[str, tuple[str, str]]:
    out = {}
    for d in model.datasets.values():
        out[f"dataset/{d.name}"] = ("dataset", _digest(asdict(d)))
        out |= {f"dataset/{d.name}/field/{f.name}": ("field", _digest(asdict(f))) for f in d.fields.values()}
    out |= {f"metric/{m.name}": ("metric", _digest(asdict(m))) for m in model.metrics.values()}
    out |= {f"relationship/{r.name}": ("relationship", _digest(asdict(r))) for r in model.relationships.values()}
    if model.spine:
        out["spine"] = ("spine", _digest(asdict(model.spine)))
    return out


def difference(before: Model, after: Model) -> list[Change]:
    """Assets added, removed or modified, by reference. A dataset is modified when one of its fields is."""
    if before.name != after.name:
        raise EngineError("INVALID_DIFFERENCE", f"{before.name} and {after.name} are different models")
    a, b = _assets(before), _assets(after)
    out = []
    for ref in sorted({*a, *b}):
        if ref not in a:
            out.append(Change(b[ref][0], ref, "added", after=b[ref][1]))
        elif ref not in b:
            out.append(Change(a[ref][0], ref, "removed", before=a[ref][1]))
        elif a[ref] != b[ref]:
            out.append(Change(b[ref][0], ref, "modified", a[ref][1], b[ref][1]))
    return out


def _names(model: Model) -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    own, aliases = defaultdict(set), defaultdict(set)
    for m in model.metrics.values():
        own[plain(m.name)].add(f"metric/{m.name}")
        for alias in (m.about or {}).get("aliases", []):
            aliases[plain(alias)].add(f"metric/{m.name}")
    return own, aliases


def _identity_findings(model: Model):
    same = defaultdict(list)
    for m in model.metrics.values():
        behaviour = {k: v for k, v in asdict(m).items() if k not in ("name", "about")}
        same[_digest(behaviour)].append(f"metric/{m.name}")
    for refs in same.values():
        if len(refs) > 1:
            yield "EQUIVALENT_METRIC_DEFINITION", sorted(refs), "the same in all but name"
    own, aliases = _names(model)
    for name, refs in aliases.items():
        if len(refs) > 1:
            yield "ALIAS_CONFLICT", sorted(refs), name
    for name, refs in own.items():
        every = refs | aliases.get(name, set())
        if len(every) > 1:
            yield "DISCOVERY_IDENTITY_COLLISION", sorted(every), name


def _source(model: Model, name: str) -> set[str]:
    """Datasets that the metric starts from."""
    if model.kind(name) == "conversion":
        o = model.metric(name).conversion
        return {o["base"]["dataset"], o["event"]["dataset"]}
    if model.kind(name) == "source":
        found = model.metric_datasets(name)
        if not found:
            raise EngineError("INVALID_METRIC", f"{name} reads no dataset")
        return {found[0]}
    return set()


def _graph_findings(model: Model):
    sources: set[str] = set()
    for name in model.metrics:
        try:
            sources |= _source(model, name)
        except EngineError as e:
            yield "METRIC_SOURCE_UNRESOLVED", [f"metric/{name}"], e.code
    for d in model.datasets.values():
        connected = False
        for source in sorted(sources & set(model.datasets)):
            try:
                model.path(source, d.name)
                connected = True
            except EngineError as e:
                if e.code == "AMBIGUOUS_RELATIONSHIP_PATH":
                    connected = True
                    yield "AMBIGUOUS_RELATIONSHIP_PATH", [f"dataset/{d.name}"], f"from {source}"
        if not connected:
            yield "DISCONNECTED_DATASET", [f"dataset/{d.name}"], "no metric's source reaches it"
            for f in d.fields.values():
                if f.dimension:
                    yield "UNREACHABLE_DIMENSION", [f"dataset/{d.name}/field/{f.name}"], "its dataset is disconnected"


def _evidence_findings(model: Model):
    for m in model.metrics.values():
        ref, expects = [f"metric/{m.name}"], (m.about or {}).get("expects", {})
        calls = aggregates(m.expr) if model.kind(m.name) == "source" else []
        whole = calls[0] if len(calls) == 1 and calls[0].whole else None
        if whole and whole.name == "COUNT" and m.type != "integer":
            yield "METRIC_TYPE_MISMATCH", ref, f"a count declared {m.type}"
        if "type" in expects and expects["type"] != m.type:
            yield "METRIC_TYPE_MISMATCH", ref, f"{expects['type']} expected, {m.type} declared"
        if "aggregation" in expects and (not whole or expects["aggregation"].upper() != whole.name):
            yield "METRIC_AGGREGATION_MISMATCH", ref, f"{expects['aggregation']} expected, {whole.name if whole else 'none alone'} found"
        if m.algebra and whole and whole.merge and m.algebra != whole.merge:
            yield "METRIC_EXPRESSION_INCONSISTENT", ref, f"{m.algebra} declared, {whole.merge} by its call"


def _governance_findings(model: Model):
    assets: list[tuple[str, Dataset | Field | Metric]] = [(f"metric/{m.name}", m) for m in model.metrics.values()]
    for d in model.datasets.values():
        assets += [(f"dataset/{d.name}", d), *[(f"dataset/{d.name}/field/{f.name}", f) for f in d.fields.values()]]
    for ref, x in assets:
        about = x.about or {}
        if about.get("lifecycle") == "deprecated" and not about.get("replacement"):
            yield "DEPRECATED_WITHOUT_REPLACEMENT", [ref], ""
        if about.get("certification") == "certified" and not about.get("owner"):
            yield "CERTIFIED_WITHOUT_OWNER", [ref], ""


def review(model: Model, severities: dict[str, str] | None = None, threshold: str = "error") -> tuple[list[Finding], bool]:
    """Findings by code and asset, and whether all are below the threshold, so that the model may be published."""
    severities = severities or {}
    if set(severities) - set(RULES) or {*severities.values(), threshold} - set(SEVERITIES):
        raise EngineError("INVALID_QUALITY_POLICY", str(severities or threshold))
    out = []
    for rule in (_identity_findings, _graph_findings, _evidence_findings, _governance_findings):
        out += [Finding(code, severities.get(code, "warning"), refs[0], tuple(refs[1:]), detail) for code, refs, detail in rule(model)]
    passed = all(SEVERITIES.index(f.severity) < SEVERITIES.index(threshold) for f in out)
    return sorted(out, key=lambda f: (RULES.index(f.code), f.asset, f.detail)), passed
