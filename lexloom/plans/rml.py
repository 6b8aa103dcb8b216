"""Graph construction: triples maps compiled to column expressions, one pass over each source."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bnode_name, expand_template
from ..schema import GRAPH_COLUMNS
from .names import CNT, DCTERMS, ELI, OA, PROV, RDF, RDFS, SCHEMA, SKOS, XSD, Names


@dataclass(frozen=True)
class Term:
    """A term map. Of constant, reference (a column) and template, the first that is given counts. ``kind``: iri, bnode or literal."""

    constant: str | None = None
    reference: str | None = None
    template: str | None = None
    kind: str | None = None
    datatype: str | None = None
    language: str | None = None

    def value(self, columns: list[str]) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        if self.reference is not None:
            return F.coalesce(F.col(self.reference).cast("string"), F.lit("")) if self.reference in columns else F.lit("")
        return expand_template(self.template or "", columns)

    def compiled(self, columns: list[str], default: str) -> Column:
        """A struct of value, kind, datatype and language; null if the whole value is empty."""
        kind = self.kind or ("iri" if self.constant is not None and default != "literal" else default)
        value = self.value(columns)
        shown = bnode_name(value) if kind == "bnode" else value
        text = lambda x: F.lit(x if kind == "literal" else None).cast("string")
        return F.when(value != "", F.struct(shown.alias("value"), F.lit(kind).alias("kind"), text(self.datatype).alias("datatype"), text(self.language).alias("language")))


def iri(template: str) -> Term:
    return Term(template=template, kind="iri")


def literal(column: str, datatype: str | None = None) -> Term:
    return Term(reference=column, kind="literal", datatype=datatype)


@dataclass(frozen=True)
class TriplesMap:
    """For each row of ``source``: a subject, its classes, and the product of predicates and objects of each pair in ``pairs``.

    ``keyed``: rows of the source that differ have different subjects, which no other map has; then equal triples can only come from equal rows.
    """

    source: str
    subject: Term
    classes: tuple[str, ...] = ()
    pairs: tuple[tuple[tuple[Term | str, ...], tuple[Term, ...]], ...] = field(default_factory=tuple)
    keyed: bool = False

    def references(self, columns: list[str]) -> list[str]:
        """The columns that the map reads."""
        terms = [self.subject, *(t for ps, os in self.pairs for t in (*ps, *os) if isinstance(t, Term))]
        named = {t.reference for t in terms} | {n for t in terms for n in re.findall(r"\{([^{}]+)\}", t.template or "")}
        return [c for c in columns if c in named]

    def triples(self, columns: list[str]) -> list[Column]:
        """A column for each triple, null where a term is empty."""
        s = self.subject.compiled(columns, "iri")
        out = []
        make = lambda p, o: F.when(
            s.isNotNull() & s["kind"].isin("iri", "bnode") & p["value"].isNotNull() & o["value"].isNotNull(),
            F.struct(s["value"].alias("s"), s["kind"].alias("s_kind"), p["value"].alias("p"), o["value"].alias("o"), o["kind"].alias("o_kind"), o["datatype"].alias("o_datatype"), o["language"].alias("o_lang")),
        )
        for c in self.classes:
            out.append(make(Term(constant=RDF + "type").compiled(columns, "iri"), Term(constant=c, kind="iri").compiled(columns, "iri")))
        for predicates, objects in self.pairs:
            for p in predicates:
                for o in objects:
                    out.append(make((Term(constant=p) if isinstance(p, str) else p).compiled(columns, "iri"), o.compiled(columns, "literal")))
        return out


def construct(sources: dict[str, DataFrame], maps: list[TriplesMap]) -> DataFrame:
    """The graph of all maps, a set of triples.

    A source is passed over once for its keyed maps, whose triples need no further search for duplicates, and once for all others: those that read the
    same columns go over the distinct rows of those columns together, so an entity that is named in many rows is expanded once. Only the triples
    of the others are compared with each other.
    """
    groups: dict[tuple, list[TriplesMap]] = defaultdict(list)
    for m in maps:
        if m.source in sources:
            groups[m.source, m.keyed or tuple(m.references(sources[m.source].columns))].append(m)
    if not groups:
        raise ValueError("no map has a source")
    expand = lambda rows, own: rows.select(F.explode(F.array(*(t for m in own for t in m.triples(rows.columns)))).alias("t")).where("t IS NOT NULL").select("t.*")
    keyed, others = [], []
    for name in dict.fromkeys(n for n, _ in groups):
        source = sources[name]
        for own in (o for (n, key), o in groups.items() if n == name and key is True):
            columns = [c for c in source.columns if any(c in m.references(source.columns) for m in own)]
            keyed.append(expand(source.select(*columns).distinct() if columns else source.limit(1), own))
        shapes = [(list(key), o) for (n, key), o in groups.items() if n == name and key is not True]
        read = [(c, o) for c, o in shapes if c]
        others += [expand(source.select(F.lit(0).alias("_")).limit(1), o) for c, o in shapes if not c]
        if len(read) == 1:
            others.append(expand(source.select(*read[0][0]).distinct(), read[0][1]))
        elif read:
            # the rows of all shapes in one pass; each shape then reads its own from the one exchange
            row = lambda i, columns: F.struct(F.lit(i).alias("shape"), F.array(*(F.col(c).cast("string") for c in columns)).alias("row"))
            rows = source.select(F.explode(F.array(*(row(i, c) for i, (c, _) in enumerate(read)))).alias("r")).select("r.shape", "r.row").distinct()
            for i, (columns, own) in enumerate(read):
                others.append(expand(rows.where(F.col("shape") == i).select(*(F.col("row")[k].alias(c) for k, c in enumerate(columns))), own))
    united = [reduce(DataFrame.unionByName, keyed)] if keyed else []
    if others:
        united.append(reduce(DataFrame.unionByName, others).dropDuplicates())
    return reduce(DataFrame.unionByName, united).select(*GRAPH_COLUMNS)


def pair(predicate: str, *objects: Term) -> tuple[tuple[str, ...], tuple[Term, ...]]:
    return (predicate,), objects


def standard_maps(names: Names, article: str = "{article_uri}", run: str = "") -> list[TriplesMap]:
    """The maps of the standard sources: documents, triplets, mentions, topics and curation.

    ``article`` is the template of an article's IRI, and ``run`` names the extraction run that statements are attributed to.
    """
    core, res = names.core, names.resource
    activity = Term(constant=f"{res}/activity/{run}", kind="iri") if run else None
    statement = (
        pair(RDF + "subject", iri("{head_uri}")), pair(RDF + "predicate", iri("{predicate_uri}")), pair(RDF + "object", iri("{tail_uri}")),
        pair(PROV + "hadPrimarySource", iri(article)), *((pair(PROV + "wasGeneratedBy", activity),) if activity else ()),
    )
    maps = [
        TriplesMap("documents", iri("{document_uri}"), (ELI + "LegalResource",), (pair(DCTERMS + "title", literal("title")), pair(DCTERMS + "type", literal("type")))),
        TriplesMap("documents", iri(article), (ELI + "LegalResourceSubdivision",), (pair(ELI + "is_part_of", iri("{document_uri}")), pair(ELI + "number", literal("number")), pair(ELI + "id_local", literal("id_local")), pair(OA + "sourceDateStart", literal("date", XSD + "date")))),
        TriplesMap("documents", iri(article), (), (pair(core + "hasContent", iri("{content_uri}")),)),
        TriplesMap("documents", iri("{content_uri}"), (CNT + "ContentAsText",), (pair(CNT + "chars", literal("content")),)),
        TriplesMap("triplets", iri("{statement_uri}"), (core + "ExtractedRelation", RDF + "Statement"), statement, keyed=True),
    ]
    for role in ("head", "tail"):
        maps += [
            TriplesMap("triplets", iri(f"{{{role}_uri}}"), (SKOS + "Concept", PROV + "Entity"), (pair(RDF + "type", iri(f"{{{role}_type_uri}}")), pair(SKOS + "prefLabel", literal(f"{role}_label")), pair(SKOS + "altLabel", literal(f"{role}_alt")))),
        ]
    maps += [
        TriplesMap("mentions", iri("{mention_uri}"), (OA + "Annotation",), (pair(OA + "hasBody", iri("{entity_uri}")), pair(OA + "hasTarget", Term(template="{target_id}", kind="bnode"))), keyed=True),
        TriplesMap("mentions", Term(template="{target_id}", kind="bnode"), (OA + "SpecificResource",), (pair(OA + "hasSource", iri(article)), pair(OA + "hasSelector", Term(template="{selector_id}", kind="bnode"))), keyed=True),
        TriplesMap("mentions", Term(template="{selector_id}", kind="bnode"), (OA + "TextPositionSelector",), (pair(OA + "start", literal("start", XSD + "integer")), pair(OA + "end", literal("end", XSD + "integer"))), keyed=True),
        TriplesMap("topics", iri(article), (), (pair(DCTERMS + "subject", iri("{topic_uri}")),)),
        TriplesMap("topics", iri("{topic_uri}"), (SKOS + "Concept",), (pair(SKOS + "prefLabel", literal("topic_label")),)),
        TriplesMap("curation", iri("{decision_uri}"), (OA + "Annotation",), (
            pair(OA + "hasTarget", iri("{target_uri}")), pair(OA + "hasBody", iri("{status_uri}")), pair(OA + "motivatedBy", iri("{motivation_uri}")), pair(PROV + "wasGeneratedBy", iri("{activity_uri}")),
            pair(PROV + "hadPrimarySource", iri("{source_uri}")), pair(DCTERMS + "source", iri("{dataset_uri}")),
        )),
        TriplesMap("curation", iri("{status_uri}"), (SKOS + "Concept",), (pair(SKOS + "prefLabel", literal("status_label")), pair(SKOS + "definition", literal("status_definition")))),
        TriplesMap("curation", iri("{activity_uri}"), (PROV + "Activity",), (pair(RDFS + "label", literal("activity_label")), pair(RDFS + "comment", literal("activity_comment")), pair(PROV + "used", iri("{source_uri}")), pair(PROV + "startedAtTime", literal("started_at", XSD + "dateTime")), pair(PROV + "endedAtTime", literal("ended_at", XSD + "dateTime")))),
        TriplesMap("curation", iri("{source_uri}"), (PROV + "Entity",), (pair(DCTERMS + "title", literal("source_title")),)),
    ]
    return maps


def activity_maps(names: Names, run: str, model: str = "unspecified-model", strategy: str = "signature-driven", provider: str = "Extraction provider", constraint: str = "unspecified-ontology", article: str = "{article_uri}") -> list[TriplesMap]:
    """The maps of the activities that made a graph, of who ran them and of what constrained them: of the sources triplets and mentions."""
    at = lambda x: Term(constant=f"{names.resource}/{x}", kind="iri")
    text = lambda x: Term(constant=x, kind="literal")
    extraction, mentions, generator = at(f"activity/{run}"), at("mentionExtractionActivity"), at("generator")
    return [
        TriplesMap("triplets", at("kgCreationActivity"), (PROV + "Activity",), (pair(RDFS + "label", text("Knowledge graph creation")), pair(PROV + "used", at("dataset"), generator), pair(PROV + "wasInformedBy", extraction, mentions))),
        TriplesMap("triplets", extraction, (PROV + "Activity", names.core + "LLMRelationExtraction"), (
            pair(RDFS + "label", text("Signature-driven relation extraction")), pair(PROV + "wasAssociatedWith", at("extractionProvider")), pair(names.core + "usesModel", text(model)), pair(names.core + "extractionStrategy", text(strategy)),
            pair(names.core + "constrainedBy", at("extendedOntology")), pair(PROV + "used", iri(article)),
        )),
        TriplesMap("mentions", mentions, (PROV + "Activity", names.core + "MentionExtraction"), (pair(RDFS + "label", text("Mention annotation generation")), pair(PROV + "wasInformedBy", extraction), pair(PROV + "wasAssociatedWith", generator), pair(PROV + "used", iri(article)))),
        TriplesMap("triplets", at("extractionProvider"), (PROV + "Agent", SCHEMA + "Organization"), (pair(RDFS + "label", text(provider)),)),
        TriplesMap("triplets", at("extendedOntology"), (PROV + "Entity", names.core + "ExtractionConstraint"), (pair(RDFS + "label", text("Extended extraction ontology")), pair(DCTERMS + "source", text(constraint)))),
    ]


def for_provider(maps: list[TriplesMap], provider: str) -> list[TriplesMap]:
    """The maps with blank nodes in a scope of their own, so that graphs of several providers can be united."""
    scoped = lambda t: replace(t, template=f"{provider}_{t.template}") if t.kind == "bnode" and t.template else t
    return [replace(m, subject=scoped(m.subject), pairs=tuple((p, tuple(map(scoped, o))) for p, o in m.pairs)) for m in maps]


def extraction_rules(signatures: DataFrame) -> DataFrame:
    """A rule for each class, relation and (domain, relation, range) of an ontology: ``kind``, ``subject``, ``property``, ``object``."""
    none = F.lit(None).cast("string")
    classes = signatures.select(F.col("domain").alias("subject")).union(signatures.select(F.col("range"))).where("subject IS NOT NULL").distinct()
    return (
        classes.select(F.lit("class").alias("kind"), "subject", none.alias("property"), none.alias("object"))
        .unionByName(signatures.select(F.lit("relation").alias("kind"), none.alias("subject"), "property", none.alias("object")).distinct())
        .unionByName(signatures.where("domain IS NOT NULL AND range IS NOT NULL").select(F.lit("signature").alias("kind"), F.col("domain").alias("subject"), "property", F.col("range").alias("object")).distinct())
    )
