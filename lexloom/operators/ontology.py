"""Ontologies as tables: classes, properties, signatures, growth and shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, local_name
from ..plans.names import OWL, RDF, RDFS, XSD
from ..session import ensure_checkpoint_dir
from .joins import maybe_broadcast


def simple_signatures(graph: DataFrame) -> DataFrame:
    """domain, property, range of named domains and ranges alone; a property without one has null there."""
    of = lambda p, c: graph.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.col("s").alias("property"), F.col("o").alias(c))
    properties = graph.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "ObjectProperty") & (F.col("s_kind") == "iri")).select(F.col("s").alias("property")).distinct()
    return properties.join(of(RDFS + "domain", "domain"), "property", "left").join(of(RDFS + "range", "range"), "property", "left").select("domain", "property", "range").distinct()


def _grown(start: DataFrame, step, most: int = 64) -> DataFrame:
    """``start`` united with ``step`` of it until nothing is new. Each round is kept by a checkpoint, so that plans stay short."""
    ensure_checkpoint_dir(start.sparkSession)
    found = start.distinct().checkpoint()
    n = found.count()
    for _ in range(most):
        found = found.unionByName(step(found)).distinct().checkpoint()
        if (now := found.count()) == n:
            return found
        n = now
    raise RuntimeError(f"still growing after {most} rounds")


def list_members(graph: DataFrame) -> DataFrame:
    """``list``, ``member`` of every RDF list: steps along rdf:rest are doubled until all are reached."""
    first = graph.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member"))
    rest = graph.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select(F.col("s").alias("a"), F.col("o").alias("b"))
    reach = _grown(rest, lambda r: r.join(r.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
    cells = first.select(F.col("cell").alias("a"), F.col("cell").alias("b")).unionByName(reach)
    return cells.join(first, F.col("b") == F.col("cell")).select(F.col("a").alias("list"), "member").distinct()


def class_sets(graph: DataFrame) -> DataFrame:
    """``node``, ``cls``: the named classes of each union, at any depth."""
    unions = graph.where(F.col("p") == OWL + "unionOf").select(F.col("s").alias("node"), F.col("o").alias("list"))
    member = unions.join(list_members(graph), "list").select("node", F.col("member").alias("cls"))
    member = _grown(member, lambda m: m.join(m.select(F.col("node").alias("cls"), F.col("cls").alias("c")), "cls").select("node", F.col("c").alias("cls")))
    return member.join(unions.select(F.col("node").alias("u")).distinct(), F.col("cls") == F.col("u"), "left_anti")


def full_signatures(graph: DataFrame) -> DataFrame:
    """Signatures with unions expanded. A restriction of a class on a property replaces the property's ranges for that domain, or adds the domain."""
    expanded = class_sets(graph)

    def of(predicate: str, name: str) -> DataFrame:
        links = graph.where(F.col("p") == predicate).select(F.col("s").alias("property"), F.col("o").alias("node"), F.col("o_kind").alias("kind"))
        named = links.where("kind = 'iri'").select("property", F.col("node").alias(name))
        return named.unionByName(links.join(expanded, "node").select("property", F.col("cls").alias(name))).distinct()

    domains, ranges = of(RDFS + "domain", "domain"), of(RDFS + "range", "range")
    on = graph.where(F.col("p") == OWL + "onProperty").select(F.col("s").alias("r"), F.col("o").alias("property"))
    values = graph.where(F.col("p").isin(OWL + "allValuesFrom", OWL + "someValuesFrom")).select(F.col("s").alias("r"), F.col("o").alias("node"), F.col("o_kind").alias("kind"))
    targets = values.where("kind = 'iri'").select("r", F.col("node").alias("range")).unionByName(values.join(expanded, "node").select("r", F.col("cls").alias("range")))
    holders = graph.where(F.col("p").isin(RDFS + "subClassOf", OWL + "equivalentClass")).select(F.col("s").alias("domain"), F.col("o").alias("r"))
    scoped = holders.join(on, "r").join(targets, "r").select("domain", "property", "range").distinct()
    plain = domains.join(ranges, "property").join(scoped.select("domain", "property").distinct(), ["domain", "property"], "left_anti").select("domain", "property", "range")
    return plain.unionByName(scoped).distinct()


def property_constraints(candidates: DataFrame) -> DataFrame:
    """Of each property its sorted domains and ranges, mean confidence, evidence, and whether scoped restrictions are due (several of both)."""
    out = candidates.groupBy("property").agg(
        F.sort_array(F.collect_set("domain")).alias("domains"), F.sort_array(F.collect_set("range")).alias("ranges"), F.avg("confidence").alias("confidence"), F.sum("evidence").alias("evidence"),
    )
    return out.withColumn("scoped", (F.size("domains") > 1) & (F.size("ranges") > 1))


def ranges_by_domain(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("property", "domain").agg(F.array_join(F.sort_array(F.collect_set("range")), "; ").alias("ranges"), F.count(F.lit(1)).alias("n"))


def repeated_expressions(graph: DataFrame) -> DataFrame:
    """Properties that state a domain or a range more than once."""
    return graph.where(F.col("p").isin(RDFS + "domain", RDFS + "range")).groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"), F.collect_set("o").alias("parts")).where("n > 1")


def reuse_terms(names: DataFrame, column: str, terms: DataFrame, namespace: str) -> DataFrame:
    """``iri`` of an existing term of that local name, else one in ``namespace``."""
    known = terms.groupBy(local_name(F.col("iri")).alias("_n")).agg(F.min("iri").alias("_iri"))
    out = names.join(maybe_broadcast(known), local_name(F.col(column)) == F.col("_n"), "left")
    return out.withColumn("iri", F.coalesce("_iri", F.concat(F.lit(namespace), local_name(F.col(column))))).drop("_n", "_iri")


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """Candidate relations over a confidence: mean confidence, evidence count and first texts of each (domain, range, property).

    ``rows``: place, object_prop_candidate, domain, range, textual_evidence, definition, aligned_CQ, confidence.
    """
    sure = F.col("confidence").try_cast("double")
    kept = rows.withColumn("confidence", sure).where(F.col("confidence") > least).withColumn("_e", F.greatest(F.size(F.coalesce("textual_evidence", F.array().cast("array<string>"))), F.lit(0)))
    text = lambda c: F.coalesce(F.min_by(c, F.when(first_filled(F.col(c)) != "", F.col("place"))), F.lit("")).alias(c)
    return kept.groupBy("domain", "range", F.col("object_prop_candidate").alias("property")).agg(F.avg("confidence").alias("confidence"), F.sum("_e").alias("evidence"), text("definition"), text("aligned_CQ"))


def preferred_relation(agreement: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], order: str = "agreement") -> DataFrame:
    """A relation for each key, by the shared one, else the first provider's, else the second's; or of one provider before the other."""
    a, b, c = (df.select(*keys, F.col("relation").alias(n)) for df, n in ((agreement, "_a"), (first, "_f"), (second, "_s")))
    ranks = {"agreement": ("_a", "_f", "_s"), "first": ("_f", "_a", "_s"), "second": ("_s", "_a", "_f")}[order]
    joined = a.join(b, keys, "full").join(c, keys, "full")
    return joined.select(*keys, F.coalesce(*ranks).alias("relation"))


# fixed values: columns that candidates of canonical relations may have, and how they are summed up
OPTIONAL = {"confidence_value_prom": F.avg, "textual_evidence_count_total": F.sum}


def canonical_relations(rows: DataFrame, order: str = "place") -> DataFrame:
    """Candidates by (domain, range, canonical_relation): mean confidence, evidence in all and the first definition that isn't null, as far as there are such columns; else distinct ones."""
    keys = ["domain", "range", "canonical_relation"]
    found = [f(c).alias(c) for c, f in OPTIONAL.items() if c in rows.columns]
    if "definition_text" in rows.columns:
        found.append(F.min_by("definition_text", F.when(F.col("definition_text").isNotNull(), F.col(order))).alias("definition_text"))
    known = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return known.groupBy(*keys).agg(*found) if found else rows.select(*keys).distinct()


def combined(graphs: list[DataFrame]) -> DataFrame:
    """The union of ontologies as a set of triples. Blank nodes of different files are different, so each file's get names of its own."""
    name = lambda c, kind, i: F.when(F.col(kind) == "bnode", F.concat(F.lit(f"g{i}_"), F.col(c))).otherwise(F.col(c))
    own = (g.withColumns({"s": name("s", "s_kind", i), "o": name("o", "o_kind", i)}) for i, g in enumerate(graphs))
    return reduce(DataFrame.unionByName, own).distinct()


def _triple(s: Column, p: str, o: Column, kind: str = "iri", s_kind: str = "iri", datatype: str | None = None) -> Column:
    text = lambda x: F.lit(x).cast("string")
    return F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), text(datatype).alias("o_datatype"), text(None).alias("o_lang"))


def _list_of(node: Column, items: Column, kind: str, datatype: str | None = None) -> Column:
    """The cells of an RDF list with the items of an array; its first cell is ``node`` with ``_0``."""
    cell = lambda i: F.concat(node, F.lit("_"), i.cast("string"))
    last = F.size(items) - 1
    made = lambda x, i: F.array(
        _triple(cell(i), RDF + "first", x, kind, "bnode", datatype),
        F.when(i < last, _triple(cell(i), RDF + "rest", cell(i + 1), "bnode", "bnode")).otherwise(_triple(cell(i), RDF + "rest", F.lit(RDF + "nil"), "iri", "bnode")),
    )
    return F.flatten(F.transform(items, made))


def _expression(subject: Column, predicate: str, node: Column, classes: Column, s_kind: str = "iri") -> Column:
    """``subject predicate`` the class, or the union of the classes."""
    one = F.array(_triple(subject, predicate, classes[0], "iri", s_kind))
    many = F.concat(
        F.array(_triple(subject, predicate, node, "bnode", s_kind), _triple(node, RDF + "type", F.lit(OWL + "Class"), "iri", "bnode"), _triple(node, OWL + "unionOf", F.concat(node, F.lit("_0")), "bnode", "bnode")),
        _list_of(node, classes, "iri"),
    )
    return F.when(F.size(classes) == 1, one).otherwise(many)


def _literals(subject: Column, predicate: str, node: Column, values: Column, datatype: str, one_of: bool) -> Column:
    """A triple for each of the values, or one to a data range of all of them if there are several."""
    each = F.transform(values, lambda v: _triple(subject, predicate, v, "literal", datatype=datatype))
    if not one_of:
        return each
    whole = F.concat(
        F.array(_triple(subject, predicate, node, "bnode"), _triple(node, RDF + "type", F.lit(RDFS + "Datatype"), "iri", "bnode"), _triple(node, OWL + "oneOf", F.concat(node, F.lit("_0")), "bnode", "bnode")), _list_of(node, values, "literal", datatype)
    )
    return F.when(F.size(values) > 1, whole).otherwise(each)


def extension(candidates: DataFrame, base: str, metadata: bool = True, one_of: bool = False) -> DataFrame:
    """The triples by which candidates (domain, range, property: IRIs; confidence, evidence) extend an ontology.

    All classes and properties are declared. A property has the union of its domains and that of its ranges, and, if there are several of both, each domain
    is restricted to the ranges it has there. ``metadata``: the confidences and counts of evidence as annotations, one by one or (``one_of``) as a data range.
    """
    node = lambda kind, *key: F.concat(F.lit(f"{kind}_"), F.substring(F.sha1(F.concat_ws(" ", *key)), 1, 16))
    sets = {c: F.sort_array(F.collect_set(c)) for c in ("domain", "range")}
    props = candidates.groupBy("property").agg(*(v.alias(f"{k}s") for k, v in sets.items()), F.sort_array(F.collect_set(F.col("confidence").cast("decimal(18,6)"))).alias("confidences"), F.sort_array(F.collect_set(F.col("evidence").cast("long"))).alias("evidences"))
    p = F.col("property")
    parts = [F.array(_triple(p, RDF + "type", F.lit(OWL + "ObjectProperty"))), _expression(p, RDFS + "domain", node("d", p), F.col("domains")), _expression(p, RDFS + "range", node("r", p), F.col("ranges"))]
    if metadata:
        parts.append(_literals(p, f"{base}confidenceValue", node("c", p), F.transform("confidences", lambda x: x.cast("string")), XSD + "decimal", one_of))
        parts.append(_literals(p, f"{base}textualEvidenceCount", node("e", p), F.transform("evidences", lambda x: x.cast("string")), XSD + "integer", one_of))
    scoped = props.where("size(domains) > 1 AND size(ranges) > 1").select(F.col("property").alias("_p"))
    by_domain = candidates.groupBy("property", "domain").agg(sets["range"].alias("ranges")).join(scoped, p == F.col("_p"))
    d, own = F.col("domain"), node("x", F.col("property"), F.col("domain"))
    restricted = F.concat(
        F.array(_triple(d, RDFS + "subClassOf", own, "bnode"), _triple(own, RDF + "type", F.lit(OWL + "Restriction"), "iri", "bnode"), _triple(own, OWL + "onProperty", p, "iri", "bnode")),
        _expression(own, OWL + "allValuesFrom", node("y", p, d), F.col("ranges"), "bnode"),
    )
    classes = candidates.select(F.explode(F.array("domain", "range")).alias("c")).distinct().select(F.array(_triple(F.col("c"), RDF + "type", F.lit(OWL + "Class"))).alias("t"))
    tables = [props.select(F.concat(*parts).alias("t")), by_domain.select(restricted.alias("t")), classes]
    if metadata:
        notes = [_triple(F.lit(f"{base}{n}"), RDF + "type", F.lit(OWL + "AnnotationProperty")) for n in ("confidenceValue", "textualEvidenceCount")]
        tables.append(candidates.sparkSession.range(1).select(F.array(*notes).alias("t")))
    return reduce(DataFrame.unionByName, tables).select(F.explode("t").alias("t")).select("t.*").distinct()
