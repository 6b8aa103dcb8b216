"""Namespaces and the IRIs that identify documents, articles, entities, statements and mentions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import first_filled, fold_latin, iri_part, is_current_act, short_hash, slug

# fixed values: public vocabularies
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
OA = "http://www.w3.org/ns/oa#"
CNT = "http://www.w3.org/2011/content#"
DCTERMS = "http://purl.org/dc/terms/"
ELI = "http://data.europa.eu/eli/ontology#"
DCAT = "http://www.w3.org/ns/dcat#"


SCHEMA = "https://schema.org/"


@dataclass(frozen=True)
class Names:
    """A graph's own namespaces: of the core classes, of the domain's relations, and of instances."""

    core: str = "https://example.org/law#"
    domain: str = "https://example.org/law/maintenance#"
    resource: str = "https://example.org/law/resource"

    def document_key(self, title: Column, corpus_id: Column, row_id: Column) -> Column:
        name = first_filled(title, corpus_id, row_id, default="document")
        return F.concat(slug(name, 80, "document"), F.lit("-"), short_hash(name))

    def article_key(self, number: Column, article_id: Column, row_id: Column) -> Column:
        return F.concat_ws("-", iri_part(first_filled(number, default="article")), *(F.when(first_filled(c) != "", iri_part(c.cast("string"))) for c in (article_id, row_id)))

    def document(self, key: Column) -> Column:
        return F.concat(F.lit(f"{self.resource}/document/"), key)

    def article(self, document_key: Column, article_key: Column) -> Column:
        return F.concat(self.document(document_key), F.lit("/article/"), article_key)

    def entity(self, kind: Column, label: Column) -> Column:
        """By type and label, folded: variants that fold alike are one entity."""
        return F.concat(F.lit(f"{self.resource}/entity/"), slug(kind, 32), F.lit("/"), slug(label), F.lit("-"), short_hash(fold_latin(kind), fold_latin(label)))

    def resolved(self, kind: Column, label: Column, document_key: Column) -> Column:
        """The document's IRI for a label that stands for the act itself, else the entity's."""
        return F.when(is_current_act(label, kind), self.document(document_key)).otherwise(self.entity(kind, label))

    def statement(self, article_id: Column, article_key: Column, place: Column, provider: Column | None = None) -> Column:
        scope = F.lit("") if provider is None else F.concat(F.lit("/"), iri_part(provider.cast("string")))
        return F.concat(F.lit(f"{self.resource}/extraction"), scope, F.lit("/"), iri_part(article_id.cast("string")), F.lit("/article/"), article_key, F.lit("/triple/"), place.cast("string"))

    @staticmethod
    def mention(statement: Column, role: str) -> Column:
        return F.concat(statement, F.lit(f"/mention/{role}"))

    def topic(self, name: Column) -> Column:
        return F.concat(F.lit(f"{self.resource}/topic/"), name)


NAMES = Names()
