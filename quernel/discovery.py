"""Finding assets of a model by text, in ranked pages, and by the concepts of an ontology."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quernel.errors import EngineError
from quernel.model import Model

# How well a text matches an asset.
EXACT_REFERENCE, EXACT_NAME, IN_NAME, IN_REFERENCE, IN_CONTEXT, A_WORD = 100, 95, 80, 70, 50, 30
# Concepts that are there without being declared.
BUILTINS = ("Any", "Boolean", "Date", "DateTime", "Decimal", "Float", "Integer", "String")
MOST = 100


@dataclass(frozen=True)
class Asset:
    kind: str
    reference: str
    name: str
    context: str = ""


@dataclass(frozen=True)
class Page:
    """items, and where the next page starts; None after the last."""

    items: list
    next: int | None


def plain(text: str) -> str:
    return " ".join(re.sub(r"[_.-]", " ", text.lower()).split())


def score(text: str, asset: Asset) -> int:
    """Of a plain text; 0 for no match."""
    name, reference, context = plain(asset.name), plain(asset.reference), plain(asset.context)
    ways = ((text == reference, EXACT_REFERENCE), (text == name, EXACT_NAME), (text in name, IN_NAME), (text in reference, IN_REFERENCE), (text in context, IN_CONTEXT))
    found = [points for holds, points in ways if holds]
    return max(found) if found else A_WORD * any(w in name or w in context for w in text.split())


def paged(items: list, limit: int, start: int) -> Page:
    if not 1 <= limit <= MOST or not 0 <= start <= len(items):
        raise EngineError("INVALID_PAGE", f"{limit} from {start}")
    return Page(items[start : start + limit], start + limit if start + limit < len(items) else None)


def ranked(assets: list[Asset], text: str, limit: int = 20, start: int = 0) -> Page:
    """Matches from best to least, then by reference."""
    wanted = plain(text)
    if not wanted or len(text) > 1024:
        raise EngineError("INVALID_SEARCH", "a text of 1 to 1024 characters")
    scored = [(-score(wanted, a), a.reference, a) for a in assets]
    return paged([a for points, _, a in sorted(scored, key=lambda x: x[:2]) if points], limit, start)


class Index:
    """Datasets, fields, metrics and relationships of a model, indexed once."""

    def __init__(self, model: Model):
        self.model = model
        self.assets: list[Asset] = []
        for d in model.datasets.values():
            self._add("dataset", d.name, d.name, d.about)
            for f in d.fields.values():
                self._add("field", f"{d.name}.{f.name}", f.name, f.about)
        for m in model.metrics.values():
            self._add("metric", f"metric.{m.name}", m.name, m.about)
        for r in model.relationships.values():
            self._add("relationship", f"relationship.{r.name}", r.name, None)
        self._by_reference = {(a.kind, a.reference): a for a in self.assets}
        self._kinds: dict[str, list[Asset]] = {}
        for a in sorted(self.assets, key=lambda a: a.reference):
            self._kinds.setdefault(a.kind, []).append(a)
        self._places: dict[str, list[int]] | None = None  # assets by each three characters of their texts, made for the first search

    def _near(self, text: str) -> list[Asset]:
        """Assets that a word of the text may be part of; words of one or two characters may be part of any."""
        words = plain(text).split()
        if any(len(w) < 3 for w in words):
            return self.assets
        if self._places is None:
            self._places = {}
            for k, a in enumerate(self.assets):
                whole = plain(f"{a.name} {a.reference} {a.context}")
                for part in {whole[i : i + 3] for i in range(len(whole) - 2)}:
                    self._places.setdefault(part, []).append(k)
        found: set[int] = set()
        for w in words:
            found.update(min((self._places.get(w[i : i + 3], []) for i in range(len(w) - 2)), key=len))
        return [self.assets[k] for k in found]

    def _add(self, kind: str, reference: str, name: str, about: dict | None) -> None:
        about = about or {}
        self.assets.append(Asset(kind, reference, name, " ".join([about.get("description", ""), *about.get("aliases", [])])))

    def list(self, kind: str, limit: int = 20, start: int = 0) -> Page:
        return paged(self._kinds.get(kind, []), limit, start)

    def get(self, kind: str, reference: str) -> Asset:
        if (kind, reference) not in self._by_reference:
            raise EngineError("UNKNOWN_ASSET", f"{kind} {reference}")
        return self._by_reference[kind, reference]

    def search(self, text: str, kinds: tuple[str, ...] = (), limit: int = 20, start: int = 0) -> Page:
        return ranked([a for a in self._near(text) if not kinds or a.kind in kinds], text, limit, start)


@dataclass(frozen=True)
class Concept:
    name: str
    type: str = "EntityType"
    description: str = ""
    extends: tuple[str, ...] = ()


@dataclass(frozen=True)
class Candidate:
    """A field, the concept it is mapped to, and whether that is the one asked for or a descendant."""

    field: str
    concept: str
    match: str


@dataclass
class Ontology:
    """Concepts that extend each other, and the fields they are mapped to. Names are told apart without case."""

    model: Model
    concepts: dict[str, Concept] = field(default_factory=dict)
    mappings: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, model: Model, concepts: list[dict], mappings: list[dict]) -> Ontology:
        out = cls(model)
        for c in concepts:
            if c["name"].lower() in out.concepts:
                raise EngineError("DUPLICATE_CONCEPT", c["name"])
            out.concepts[c["name"].lower()] = Concept(**c | {"extends": tuple(c.get("extends", ()))})
        for b in BUILTINS:
            out.concepts.setdefault(b.lower(), Concept(b, "EntityType" if b == "Any" else "ValueType"))
        for c in out.concepts.values():
            for parent in c.extends:
                if parent.lower() not in out.concepts:
                    raise EngineError("UNKNOWN_CONCEPT", parent)
            if any(c.name.lower() in out.ancestors(parent) for parent in c.extends):
                raise EngineError("CONCEPT_CYCLE", c.name)
        for m in mappings:
            if m["concept"].lower() not in out.concepts:
                raise EngineError("UNKNOWN_CONCEPT", m["concept"])
            d, f = model.field(m["field"])
            out.mappings.append((m["concept"].lower(), f"{d.name}.{f.name}"))
        return out

    def ancestors(self, name: str) -> set[str]:
        """The concept itself and all that it extends, in lower case."""
        seen, open_ = set(), [name.lower()]
        while open_:
            at = open_.pop()
            if at not in seen and at in self.concepts:
                seen.add(at)
                open_ += [p.lower() for p in self.concepts[at].extends]
        return seen

    def search(self, text: str, limit: int = 20, start: int = 0) -> Page:
        """Concepts by their own words alone; what is mapped to them plays no part."""
        assets = [Asset("concept", f"concept.{c.name}", c.name, " ".join([c.description, c.type, *c.extends])) for c in self.concepts.values()]
        page = ranked(assets, text, limit, start)
        return Page([self.concepts[a.name.lower()] for a in page.items], page.next)

    def resolve(self, name: str, limit: int = 20, start: int = 0) -> Page:
        """Fields mapped to the concept or to what descends from it, never to what it extends; one row per field and concept."""
        key = name.lower()
        if key not in self.concepts:
            raise EngineError("UNKNOWN_CONCEPT", name)
        found = {Candidate(f, self.concepts[c].name, "direct" if c == key else "descendant") for c, f in self.mappings if key in self.ancestors(c)}
        return paged(sorted(found, key=lambda x: (x.field, x.concept)), limit, start)
