"""Mapping texts (R2RML and RML in Turtle) read into triples maps, and the changes by which one text serves several sources."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from pathlib import PurePosixPath

from ..sources.turtle import parse_turtle
from .names import RDF
from .rml import Term, TriplesMap

# fixed values: the vocabularies of mappings
RR, RML = "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#"
KINDS = {RR + "IRI": "iri", RR + "BlankNode": "bnode", RR + "Literal": "literal"}


class _Nodes:
    """The triples of a text by subject and predicate, in the order of the text."""

    def __init__(self, text: str):
        self.rows = parse_turtle(text)
        self.by: dict[tuple[str, str], list[tuple]] = defaultdict(list)
        for s, _, p, *o in self.rows:
            self.by[s, p].append(tuple(o))

    def all(self, node: str, name: str) -> list[tuple]:
        return self.by.get((node, name), [])

    def one(self, node: str, name: str) -> str | None:
        return next((o[0] for o in self.all(node, name)), None)

    def term(self, node: str, default: str) -> Term:
        constant = next(iter(self.all(node, RR + "constant")), None)
        kind = KINDS.get(self.one(node, RR + "termType") or "", None)
        if kind is None:
            kind = (constant[1] if constant else None) or (default if not self.all(node, RR + "datatype") else "literal")
        return Term(
            constant=constant[0] if constant else None, reference=self.one(node, RML + "reference") or self.one(node, RR + "column"), template=self.one(node, RR + "template"), kind=kind,
            datatype=self.one(node, RR + "datatype"), language=self.one(node, RR + "language"),
        )


def read_mapping(text: str, languages: bool = False) -> tuple[list[TriplesMap], dict[str, str]]:
    """The triples maps of a mapping text, in its order, and the paths of their logical sources by name (the file's name without its ending).

    Constants go before references, and these before templates. ``languages``: keep the language tags of literals, which some engines don't.
    Subject classes, predicates and predicate maps, objects and object maps may each be several. A map without a subject or a source is left out.
    """
    nodes = _Nodes(text)
    maps, paths = [], {}
    for name in dict.fromkeys(r[0] for r in nodes.rows if r[2] == RDF + "type" and r[3] == RR + "TriplesMap"):
        subject, source = nodes.one(name, RR + "subjectMap"), nodes.one(name, RML + "logicalSource")
        path = nodes.one(source, RML + "source") if source else None
        if subject is None or path is None:
            continue
        key = PurePosixPath(path).stem
        paths[key] = path
        pairs = []
        for both, *_ in nodes.all(name, RR + "predicateObjectMap"):
            predicates = [o[0] for o in nodes.all(both, RR + "predicate")] + [nodes.term(o[0], "iri") for o in nodes.all(both, RR + "predicateMap")]
            objects = [Term(constant=o[0], kind=o[1], datatype=o[2], language=o[3]) for o in nodes.all(both, RR + "object")] + [nodes.term(o[0], "literal") for o in nodes.all(both, RR + "objectMap")]
            pairs.append((tuple(predicates), tuple(o if languages else replace(o, language=None) for o in objects)))
        maps.append(TriplesMap(key, nodes.term(subject, "iri"), tuple(o[0] for o in nodes.all(subject, RR + "class")), tuple(pairs)))
    return maps, paths


def _each_term(m: TriplesMap, change) -> TriplesMap:
    of = lambda t: change(t) if isinstance(t, Term) else t
    return replace(m, subject=of(m.subject), pairs=tuple((tuple(map(of, p)), tuple(map(of, o))) for p, o in m.pairs))


def retarget(maps: list[TriplesMap], sources: dict[str, str] | None = None, columns: dict[str, str] | None = None, predicates: dict[str, tuple[str, str]] | None = None, datatypes: dict[str, str] | None = None) -> list[TriplesMap]:
    """The maps for other tables: ``sources`` renames logical sources, ``columns`` placeholders of templates (``num`` to ``article_key``), ``predicates`` the column that
    a predicate's objects are read from (predicate to (old, new)), and ``datatypes`` sets those of columns."""

    def placed(t: Term) -> Term:
        template = t.template
        for old, new in (columns or {}).items():
            template = template.replace("{" + old + "}", "{" + new + "}") if template else template
        datatype = (datatypes or {}).get(t.reference or "", t.datatype) if t.datatype else t.datatype
        return replace(t, template=template, datatype=datatype)

    out = []
    for m in maps:
        m = _each_term(m, placed)
        pairs = []
        for ps, os in m.pairs:
            for p in ps:
                if isinstance(p, str) and p in (predicates or {}):
                    old, new = predicates[p]
                    os = tuple(replace(o, reference=new) if o.reference == old else o for o in os)
            pairs.append((ps, os))
        out.append(replace(m, source=(sources or {}).get(m.source, m.source), pairs=tuple(pairs)))
    return out


def with_constants(maps: list[TriplesMap], constants: dict[str, str]) -> list[TriplesMap]:
    """The maps with other constants: of the run, its label, model, provider or ontology."""
    return [_each_term(m, lambda t: replace(t, constant=constants.get(t.constant, t.constant)) if t.constant is not None else t) for m in maps]


def from_columns(maps: list[TriplesMap], columns: dict[str, str]) -> list[TriplesMap]:
    """The maps for rows of several providers: constants that differ between them become references to columns."""
    return [_each_term(m, lambda t: replace(t, constant=None, reference=columns[t.constant]) if t.constant in columns else t) for m in maps]
