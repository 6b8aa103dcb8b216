"""More registered queries: flat tables, fusion of one column, ontologies, labels, and the functions on texts and values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text, values
from .operators import analytics, corpus, curation, filters, fusion, joins, ontology, reshape
from .plans import graph_fixture, mapping_text
from .plans.fixture import table, triplets
from .plans.graph_fixture import CORE, DOMAIN, RES, graph
from .plans.names import DCTERMS, NAMES, OWL, PROV, RDF, RDFS, SKOS, XSD
from .plans.rml import activity_maps, construct
from .queries import CLASSES, K, T, register
from .schema import GRAPH_COLUMNS
from .sources import writers

# --- flat tables -----------------------------------------------------------------------------------------------


def _layouts(spark, d):
    """Texts that hold the head as it is and the tail in lower case, or neither; some heads have spans of their own, some tails stand for the act itself."""
    t = triplets(spark, d)
    act = F.col("relation") == "justifiedBy"
    t = t.withColumns({"tail": F.when(act, "le Présent décret").otherwise(F.col("tail")), "tail_type": F.when(act, "Source").otherwise(F.col("tail_type"))})
    content = F.when(F.col("relation") == "hasTime", "nothing here").otherwise(F.concat(F.lit("> "), "head", F.lit(": "), F.lower("tail")))
    none = lambda x: F.lit(None).cast(x)
    spans = "array<struct<start:int,end:int>>"
    own = F.when(F.col("provider") == 1, F.array(F.struct(F.lit(-3).alias("start"), F.lit(4).alias("end")), F.struct(F.lit(900).alias("start"), F.lit(950).alias("end"))))
    triple = F.struct(
        "head", "head_type", "relation", "tail", "tail_type", F.when(F.col("provider") == 1, F.col("topic")).alias("topic"), none("int").alias("triplet_index"), own.cast(spans).alias("head_spans"), none(spans).alias("tail_spans"),
        none("int").alias("head_start"), none("int").alias("head_end"), none("int").alias("tail_start"), none("int").alias("tail_end"),
    )
    rows = t.select(
        F.when(F.col("provider") == 0, "NaN").otherwise("A1").alias("num"), none("string").alias("number"), F.col("article").alias("id"), F.lit("x").alias("id_local"), F.lit("y").alias("article_id"), F.col("topic").alias("title"), F.lit("p").alias("prov_title"),
        F.lit("null").alias("corpus_id"), F.lit("C").alias("prov_corpus_id"), F.lit("03/02/2020").alias("date"), content.alias("content"), F.col("stmt").alias("source_row_id"), F.lit("T0").alias("main_topic"), F.array(triple).alias("triples"),
    )
    return reshape.layouts(reshape.article_context(rows), "triples", main_topic="main_topic")


_FLAT = """, b AS (SELECT *, CASE WHEN relation = 'justifiedBy' THEN 'le Présent décret' ELSE tail END AS tl, CASE WHEN relation = 'justifiedBy' THEN 'Source' ELSE tail_type END AS tt FROM t),
c AS (SELECT *, relation <> 'hasTime' AS held, lower(topic) || '-' || substr(sha1(topic), 1, 12) AS document_key, CASE WHEN provider = 0 THEN '' ELSE 'A1' END AS article_number, CASE WHEN provider = 0 THEN article || '-' || stmt ELSE 'A1' END AS article_key,
  CASE WHEN relation = 'hasTime' THEN 'nothing here' ELSE '> ' || head || ': ' || lower(tl) END AS content, CASE WHEN provider = 1 THEN topic ELSE 'T0' END AS tp FROM b),
f AS (SELECT document_key, article AS article_id, article_key, article_number, 'C' AS corpus_id, '2020-02-03' AS date, '0' AS triplet_index, head, head_type, 'global_entity' AS head_resolution_mode, '' AS head_resolved_entity_id, relation, tl AS tail, tt AS tail_type,
  CASE WHEN relation = 'justifiedBy' THEN 'current_legal_act' ELSE 'global_entity' END AS tail_resolution_mode, CASE WHEN relation = 'justifiedBy' THEN document_key ELSE '' END AS tail_resolved_entity_id, tp AS topic,
  CASE WHEN provider = 1 THEN '0' WHEN held THEN '2' ELSE '' END AS head_start, CASE WHEN provider = 1 THEN '4' WHEN held THEN (2 + length(head))::VARCHAR ELSE '' END AS head_end,
  CASE WHEN provider = 1 THEN '0-4' WHEN held THEN '2-' || (2 + length(head)) ELSE '' END AS head_spans, CASE WHEN provider = 1 THEN trim(substr(content, 1, 4)) WHEN held THEN head ELSE '' END AS head_span_text,
  CASE WHEN provider = 1 THEN 'embedded' WHEN held THEN 'inferred' ELSE '' END AS head_span_mode, CASE WHEN held THEN (4 + length(head))::VARCHAR ELSE '' END AS tail_start, CASE WHEN held THEN (4 + length(head) + length(tl))::VARCHAR ELSE '' END AS tail_end,
  CASE WHEN held THEN (4 + length(head)) || '-' || (4 + length(head) + length(tl)) ELSE '' END AS tail_spans, CASE WHEN held THEN lower(tl) ELSE '' END AS tail_span_text, CASE WHEN held THEN 'inferred' ELSE '' END AS tail_span_mode FROM c)"""
_CONTEXT = ", ".join(reshape.CONTEXT) + ", triplet_index"


def _entity_sql(role):
    return (
        f"SELECT {_CONTEXT}, '{role}' AS entity_role, {role} AS entity, {role}_type AS entity_type, {role}_resolution_mode AS entity_resolution_mode, {role}_resolved_entity_id AS resolved_entity_id, CASE WHEN {role}_span_mode <> '' THEN 'true' ELSE 'false' END AS has_mention, "
        f"{role}_start AS entity_start, {role}_end AS entity_end, {role}_spans AS entity_spans, {role}_span_text AS entity_span_text, {role}_span_mode AS entity_span_mode FROM f"
    )


@register(T.rstrip() + _FLAT + " SELECT * FROM f")
def triplet_layout(spark, d):
    return _layouts(spark, d)[0]


@register(T.rstrip() + _FLAT + f" {_entity_sql('head')} UNION ALL {_entity_sql('tail')}")
def entity_layout(spark, d):
    return _layouts(spark, d)[1]


@register(T.rstrip() + _FLAT + f""", e AS ({_entity_sql('head')} UNION ALL {_entity_sql('tail')}) SELECT {_CONTEXT}, entity_role AS mention_role, entity AS mention, entity_type AS mention_type, entity_resolution_mode AS mention_resolution_mode, resolved_entity_id,
entity_start AS mention_start, entity_end AS mention_end, entity_spans AS mention_spans, entity_span_text AS mention_text, entity_span_mode AS mention_span_mode FROM e WHERE has_mention = 'true'""")
def mention_layout(spark, d):
    return _layouts(spark, d)[2]


@register(T.rstrip() + _FLAT + """ SELECT count(*) AS triplets, 2 * count(*) AS entities, count(*) FILTER (head_span_mode <> '') + count(*) FILTER (tail_span_mode <> '') AS mentions, count(*) FILTER (head_span_mode = '') AS missing_head_spans,
count(*) FILTER (tail_span_mode = '') AS missing_tail_spans FROM f""")
def missing_spans(spark, d):
    return _layouts(spark, d)[3]


_ACTS = ["le présent arrêté", "Du  présent Décret", "la présente loi", "les présents textes", "présent", "l’arrêté présent", "au présent ACTE", "le présent arrêté ministériel"]


@register(f"WITH a AS (SELECT n_nationkey AS k, ({_ACTS!r})[n_nationkey % 8 + 1] AS label, CASE n_nationkey % 3 WHEN 0 THEN 'Artifact' WHEN 1 THEN 'source' ELSE 'Action' END AS kind FROM nation), b AS (SELECT *, k % 8 IN (0, 1, 2, 6) AND k % 3 <> 2 AS own FROM a) "
          f"SELECT k, own, CASE WHEN own THEN '{RES}/document/D' ELSE '{RES}/entity/' || lower(kind) END AS iri FROM b")  # fmt: skip
def current_acts(spark, d):
    k = F.col("n_nationkey")
    label, kind = F.element_at(F.array(*map(F.lit, _ACTS)), (k % 8 + 1).cast("int")), F.when(k % 3 == 0, "Artifact").when(k % 3 == 1, "source").otherwise("Action")
    rows = table(spark, d, "nation").select(k.alias("k"), label.alias("label"), kind.alias("kind"))
    iri = NAMES.resolved(F.col("kind"), F.col("label"), F.lit("D"))
    return rows.select("k", text.is_current_act(F.col("label"), F.col("kind")).alias("own"), F.regexp_extract(iri, f"^({RES}/document/D|{RES}/entity/[^/]*)", 1).alias("iri"))


# --- fusion ----------------------------------------------------------------------------------------------------


def _by_letter(labels):
    """Vectors that are alike for labels of one first letter, and at right angles for others."""
    letter = F.ascii(F.lower(F.substring("label", 1, 1)))
    return labels.select("label", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (i == letter).cast("float")).alias("vector"))


_TAILS = "x AS (SELECT regexp_replace(tail, '#.*', '') AS label, tail_type AS type FROM t)"


@register(T + f""", {_TAILS}, n AS (SELECT label, count(*) AS n FROM x GROUP BY label), u AS (SELECT DISTINCT type, label FROM x), y AS (SELECT u.type, u.label, n.n, lower(left(u.label, 1)) AS letter FROM u JOIN n ON u.label = n.label),
z AS (SELECT *, first_value(label) OVER (PARTITION BY type, letter ORDER BY n DESC, length(label) DESC, label DESC) AS canonical FROM y) SELECT type, label, canonical FROM z""")
def merge_tails(spark, d):
    """Labels of one side by its type: each cluster's canonical is its most frequent label."""
    rows = triplets(spark, d).select(F.regexp_replace("tail", "#.*", "").alias("tail"), "tail_type")
    labels = fusion.side_labels(rows, "tail", "tail_type")
    return fusion.merge_one_side(rows, _by_letter(labels.select("label").distinct()), 0.9, "tail", "tail_type")[1]


@register(T + """, y AS (SELECT relation AS label, count(*) AS n, lower(left(relation, 1)) AS letter FROM t GROUP BY relation), z AS (SELECT label, first_value(label) OVER (PARTITION BY letter ORDER BY n DESC, length(label) DESC, label DESC) AS canonical FROM y),
m AS (SELECT canonical AS relation, count(*) AS n FROM t JOIN z ON relation = label GROUP BY 1) SELECT relation, n FROM m""")
def merge_relation_column(spark, d):
    """All relations as one group, without folding; the rows counted by what they are renamed to."""
    rows = triplets(spark, d).select("stmt", "relation")
    out, _ = fusion.merge_column(rows, _by_letter(rows.select(F.col("relation").alias("label")).distinct()), 0.9, "relation", "stmt")
    return out.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


# --- ontologies ------------------------------------------------------------------------------------------------

_O = "http://onto.example/"


def _ontology(spark, d):
    """Nations as properties of regions: ranges are a class, or a union of two, one of them a union itself."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    iri = lambda c: F.concat(F.lit(_O), c)
    p, key, odd = iri(F.col("n_name")), F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 2 == 1
    node = lambda x: F.concat(F.lit(f"{x}"), key)
    t = lambda s, pred, o, kind="iri", s_kind="bnode": F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(pred).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    even = F.array(t(p, RDF + "type", F.lit(OWL + "ObjectProperty"), s_kind="iri"), t(p, RDFS + "domain", iri(F.col("r_name")), s_kind="iri"), t(p, RDFS + "range", F.lit(_O + "Even"), s_kind="iri"))
    union = F.array(
        t(p, RDF + "type", F.lit(OWL + "ObjectProperty"), s_kind="iri"), t(p, RDFS + "domain", iri(F.col("r_name")), s_kind="iri"), t(p, RDFS + "range", node("u"), "bnode", "iri"), t(node("u"), OWL + "unionOf", node("a"), "bnode"),
        t(node("a"), RDF + "first", F.lit(_O + "Odd")), t(node("a"), RDF + "rest", node("b"), "bnode"), t(node("b"), RDF + "first", node("w"), "bnode"), t(node("b"), RDF + "rest", F.lit(RDF + "nil")),
        t(node("w"), OWL + "unionOf", node("c"), "bnode"), t(node("c"), RDF + "first", iri(F.col("r_name"))), t(node("c"), RDF + "rest", F.lit(RDF + "nil")),
    )
    rows = n.select(F.explode(F.when(odd, union).otherwise(even)).alias("t")).select("t.*")
    return rows.withColumns({"o_datatype": F.lit(None).cast("string"), "o_lang": F.lit(None).cast("string")}).select(*GRAPH_COLUMNS)


_NATIONS = f"WITH n AS (SELECT '{_O}' || n_name AS property, '{_O}' || r_name AS domain, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey) "


@register(_NATIONS + f"SELECT domain, property, CASE WHEN k % 2 = 0 THEN '{_O}Even' END AS range FROM n")
def simple_signatures(spark, d):
    return ontology.simple_signatures(_ontology(spark, d))


@register(_NATIONS + f"SELECT domain, property, '{_O}Even' AS range FROM n WHERE k % 2 = 0 UNION SELECT domain, property, '{_O}Odd' FROM n WHERE k % 2 = 1 UNION SELECT domain, property, domain FROM n WHERE k % 2 = 1")
def full_signatures(spark, d):
    """Unions expanded at any depth."""
    return ontology.full_signatures(_ontology(spark, d))


@register(_NATIONS + f"SELECT 'a' || k AS list, '{_O}Odd' AS member FROM n WHERE k % 2 = 1 UNION ALL SELECT 'a' || k, 'w' || k FROM n WHERE k % 2 = 1 UNION ALL SELECT 'b' || k, 'w' || k FROM n WHERE k % 2 = 1 UNION ALL SELECT 'c' || k, domain FROM n WHERE k % 2 = 1")
def list_members(spark, d):
    return ontology.list_members(_ontology(spark, d))


@register(_NATIONS + "SELECT property AS s, count(*) AS n FROM (SELECT property FROM n UNION ALL SELECT property FROM n) GROUP BY 1")
def repeated_expressions(spark, d):
    """Each property states its domain twice here."""
    g = _ontology(spark, d)
    more = g.where(F.col("p") == RDFS + "domain").withColumn("o", F.concat("o", F.lit("2")))
    return ontology.repeated_expressions(g.unionByName(more)).where(F.col("p") == RDFS + "domain").select("s", "n")


@register(_NATIONS + f"SELECT property AS name, CASE WHEN k % 2 = 0 THEN property ELSE 'http://new/' || replace(property, '{_O}', '') END AS iri FROM n")
def reuse_terms(spark, d):
    n = table(spark, d, "nation")
    terms = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit(_O), "n_name").alias("iri"))
    return ontology.reuse_terms(n.select(F.concat(F.lit(_O), "n_name").alias("name")), "name", terms, "http://new/")


@register("""WITH a AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT k, CASE WHEN k % 2 = 0 THEN 'A' || n_name WHEN k % 3 = 0 THEN 'F' || n_name ELSE 'S' || n_name END AS relation FROM a WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0""")
def preferred_relations(spark, d):
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    of = lambda m, mark: n.where(F.col("k") % m == 0).select("k", F.concat(F.lit(mark), "n_name").alias("relation"))
    return ontology.preferred_relation(of(2, "A"), of(3, "F"), of(5, "S"), ["k"])


@register(T + """SELECT head_type AS domain, tail_type AS range, relation AS canonical_relation, round(avg(length(head)), 6) AS confidence_value_prom, sum(length(tail))::BIGINT AS textual_evidence_count_total, arg_min(tail, stmt) AS definition_text FROM t GROUP BY ALL""")
def canonical_relations(spark, d):
    rows = triplets(spark, d).select(
        F.col("stmt").alias("place"), F.col("head_type").alias("domain"), F.col("tail_type").alias("range"), F.col("relation").alias("canonical_relation"), F.length("head").cast("double").alias("confidence_value_prom"),
        F.length("tail").cast("long").alias("textual_evidence_count_total"), F.col("tail").alias("definition_text"),
    )
    return ontology.canonical_relations(rows).withColumn("confidence_value_prom", F.round("confidence_value_prom", 6))


@register(T + "SELECT DISTINCT head_type AS domain, tail_type AS range, relation AS canonical_relation FROM t")
def distinct_relations(spark, d):
    """Without any of the columns that are summed up."""
    return ontology.canonical_relations(triplets(spark, d).select(F.col("head_type").alias("domain"), F.col("tail_type").alias("range"), F.col("relation").alias("canonical_relation")))


@register(_NATIONS + f"""SELECT p, count(*) AS n FROM (SELECT '{RDF}type' AS p FROM n UNION ALL SELECT '{RDFS}domain' FROM n UNION ALL SELECT '{RDFS}range' FROM n WHERE k % 2 = 0 UNION ALL SELECT x FROM n, (VALUES ('{RDFS}range'), ('{OWL}unionOf'), ('{OWL}unionOf'), ('{RDF}first'), ('{RDF}first'), ('{RDF}first'), ('{RDF}rest'), ('{RDF}rest'), ('{RDF}rest'),
('{RDFS}range'), ('{OWL}unionOf'), ('{OWL}unionOf'), ('{RDF}first'), ('{RDF}first'), ('{RDF}first'), ('{RDF}rest'), ('{RDF}rest'), ('{RDF}rest')) v(x) WHERE k % 2 = 1) GROUP BY p""")
def combined_ontology(spark, d):
    """An ontology with itself: named terms are one, blank nodes are not."""
    g = _ontology(spark, d)
    return ontology.combined([g, g]).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@register(T + f""", a AS (SELECT '{CORE}' || head_type AS d, '{CORE}' || tail_type AS r, '{DOMAIN}' || relation AS p, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT p, count(DISTINCT d) AS nd, count(DISTINCT r) AS nr, count(DISTINCT n) AS ne FROM a GROUP BY p),
q AS (SELECT a.p, a.d, count(*) AS nr FROM a JOIN g ON a.p = g.p WHERE g.nd > 1 AND g.nr > 1 GROUP BY ALL), u AS (SELECT nd AS n FROM g UNION ALL SELECT nr FROM g UNION ALL SELECT nr FROM q), w AS (SELECT n FROM u WHERE n > 1),
x AS (SELECT '{RDF}type' AS p, (SELECT count(*) FROM g) + (SELECT count(DISTINCT c) FROM (SELECT d AS c FROM a UNION SELECT r FROM a)) + 2 + (SELECT count(*) FROM w) + (SELECT count(*) FROM q) + (SELECT count(*) FROM g WHERE ne > 1) AS n
  UNION ALL SELECT '{RDFS}domain', count(*) FROM g UNION ALL SELECT '{RDFS}range', count(*) FROM g UNION ALL SELECT '{OWL}unionOf', count(*) FROM w UNION ALL SELECT '{OWL}oneOf', count(*) FROM g WHERE ne > 1
  UNION ALL SELECT unnest(['{RDF}first', '{RDF}rest']), (SELECT coalesce(sum(n), 0) FROM w)::BIGINT + (SELECT coalesce(sum(ne), 0) FROM g WHERE ne > 1)::BIGINT UNION ALL SELECT unnest(['{RDFS}subClassOf', '{OWL}onProperty', '{OWL}allValuesFrom']), count(*) FROM q
  UNION ALL SELECT 'http://m/confidenceValue', count(*) FROM g UNION ALL SELECT 'http://m/textualEvidenceCount', count(*) FROM g)
SELECT p, n FROM x WHERE n > 0""")
def ontology_extension(spark, d):
    """An extension as a graph, counted by predicate: unions, lists, restrictions, and counts of evidence as data ranges."""
    rows = triplets(spark, d).groupBy(F.concat(F.lit(CORE), "head_type").alias("domain"), F.concat(F.lit(CORE), "tail_type").alias("range"), F.concat(F.lit(DOMAIN), "relation").alias("property")).agg(F.count(F.lit(1)).alias("evidence"))
    made = ontology.extension(rows.withColumn("confidence", F.lit(0.5)), "http://m/", one_of=True)
    return made.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_KNOWN = [c for c in CLASSES if c != "Location"]


@register(K + f"""SELECT s AS entity, s_class AS cls FROM k WHERE s_class IN ({', '.join(f"'{CORE}{c}'" for c in _KNOWN)}) GROUP BY ALL""")
def entity_classes(spark, d):
    """Classes of subjects by their types, and for actors, whose types are withheld here, by their IRIs; one class isn't known."""
    g = graph(spark, d)
    entities = g.statements("entity", "p", "o").select("entity")
    return curation.entity_classes(entities, g.types("node", "cls").where(F.col("cls") != CORE + "Actor"), _KNOWN, [CORE, DOMAIN], CORE)


@register(K + "SELECT entity, min(label) AS label FROM (SELECT o AS entity, upper(tail) AS label FROM k WHERE o_class <> '" + CORE + "Source' UNION ALL SELECT o, tail FROM k WHERE o_class = '" + CORE + "Source') GROUP BY entity")
def first_labels(spark, d):
    """The alternative label, else the preferred one; sources have no alternative one here."""
    g = graph(spark, d)
    sources = g.types("_n", "_c", [CORE + "Source"]).select("_n")
    triples = g.triples.join(sources, (F.col("s") == F.col("_n")) & (F.col("p") == SKOS + "altLabel"), "left_anti")
    nodes = g.statements("s", "p", "entity").select("entity").distinct()
    return analytics.first_label(nodes, "entity", triples, [SKOS + "altLabel", SKOS + "prefLabel", RDFS + "label"])


# --- mappings --------------------------------------------------------------------------------------------------

_MAPPING = f"""
@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix m: <http://map.example/> . @prefix x: <{_O}> .
m:Source rml:source "data/in/nations.csv" .
m:Nation a rr:TriplesMap ; rml:logicalSource m:Source ;
  rr:subjectMap [ rr:template "{_O}region/{{id}}/nation/{{num}}" ; rr:class x:Nation, x:Place ] ;
  rr:predicateObjectMap [ rr:predicate x:name ; rr:objectMap [ rml:reference "name" ; rr:datatype xsd:string ] ] ;
  rr:predicateObjectMap [ rr:predicate x:number ; rr:objectMap [ rml:reference "num" ; rr:datatype xsd:string ] ] ;
  rr:predicateObjectMap [ rr:predicate x:in, x:of ; rr:objectMap [ rr:template "{_O}region/{{id}}" ; rr:termType rr:IRI ] ; rr:object x:World ] ;
  rr:predicateObjectMap [ rr:predicate x:note ; rr:objectMap [ rr:template "note-{{num}}" ; rr:termType rr:BlankNode ] ] .
m:Note a rr:TriplesMap ; rml:logicalSource m:Source ; rr:subjectMap [ rr:template "note-{{num}}" ; rr:termType rr:BlankNode ] ;
  rr:predicateObjectMap [ rr:predicate x:text ; rr:objectMap [ rml:reference "comment" ; rr:language "en" ] ] ;
  rr:predicateObjectMap [ rr:predicateMap [ rr:template "{_O}p{{id}}" ] ; rr:objectMap [ rr:constant "run" ] ] .
m:Empty a rr:TriplesMap ; rml:logicalSource m:Source ; rr:subjectMap [ rml:reference "nothing" ] ; rr:predicateObjectMap [ rr:predicate x:never ; rr:object x:World ] .
"""


@register(f"""WITH n AS (SELECT n_nationkey, n_name, 'R' || n_regionkey AS r, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey END AS c, 'K' || n_nationkey AS k FROM nation), s AS (SELECT *, '{_O}region/' || r || '/nation/' || k AS s, 'note_' || k AS b FROM n)
SELECT s, '{RDF}type' AS p, unnest(['{_O}Nation', '{_O}Place']) AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_datatype FROM s UNION ALL SELECT s, '{_O}name', n_name, 'literal', '{XSD}string' FROM s UNION ALL SELECT s, '{_O}number', k, 'literal', '{XSD}string' FROM s
UNION ALL SELECT s, '{_O}' || x, '{_O}region/' || r, 'iri', NULL FROM s, (VALUES ('in'), ('of')) v(x) UNION ALL SELECT s, '{_O}' || x, '{_O}World', 'iri', NULL FROM s, (VALUES ('in'), ('of')) v(x) UNION ALL SELECT s, '{_O}note', b, 'bnode', NULL FROM s
UNION ALL SELECT b, '{_O}text', c, 'literal', NULL FROM s WHERE c IS NOT NULL UNION ALL SELECT b, '{_O}p' || r, 'second', 'literal', NULL FROM s""")
def mapping_triples(spark, d):
    """A mapping text, read and aimed at other columns, over nations."""
    maps, paths = mapping_text.read_mapping(_MAPPING)
    maps = mapping_text.retarget(maps, {"nations": "rows"}, {"num": "key", "id": "region"}, {f"{_O}number": ("num", "key")})
    maps = mapping_text.with_constants(maps, {"run": "second"})
    n = table(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("region"), F.concat(F.lit("K"), "n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("c"), "n_nationkey")).alias("comment"))
    return construct({"rows": rows}, maps).select("s", "p", "o", "o_kind", "o_datatype")


@register(K + f""", used AS (SELECT DISTINCT a FROM k), fixed AS (SELECT * FROM (VALUES
  ('kgCreationActivity', '{RDF}type', '{PROV}Activity'), ('kgCreationActivity', '{RDFS}label', 'Knowledge graph creation'), ('kgCreationActivity', '{PROV}used', '{RES}/dataset'), ('kgCreationActivity', '{PROV}used', '{RES}/generator'),
  ('kgCreationActivity', '{PROV}wasInformedBy', '{RES}/activity/run1'), ('kgCreationActivity', '{PROV}wasInformedBy', '{RES}/mentionExtractionActivity'), ('activity/run1', '{RDF}type', '{PROV}Activity'), ('activity/run1', '{RDF}type', '{CORE}LLMRelationExtraction'),
  ('activity/run1', '{RDFS}label', 'Signature-driven relation extraction'), ('activity/run1', '{PROV}wasAssociatedWith', '{RES}/extractionProvider'), ('activity/run1', '{CORE}usesModel', 'model-x'), ('activity/run1', '{CORE}extractionStrategy', 'signature-driven'),
  ('activity/run1', '{CORE}constrainedBy', '{RES}/extendedOntology'), ('extractionProvider', '{RDF}type', '{PROV}Agent'), ('extractionProvider', '{RDF}type', 'https://schema.org/Organization'), ('extractionProvider', '{RDFS}label', 'Extraction provider'),
  ('extendedOntology', '{RDF}type', '{PROV}Entity'), ('extendedOntology', '{RDF}type', '{CORE}ExtractionConstraint'), ('extendedOntology', '{RDFS}label', 'Extended extraction ontology'), ('extendedOntology', '{DCTERMS}source', 'unspecified-ontology')) v(s, p, o))
SELECT '{RES}/' || s AS s, p, o FROM fixed UNION ALL SELECT '{RES}/activity/run1', '{PROV}used', a FROM used""")
def activity_triples(spark, d):
    """The activities behind the triples, with each article that they used."""
    rows = graph_fixture.sources(spark, d, ("triplets",))
    return construct(rows, activity_maps(NAMES, "run1", "model-x")).select("s", "p", "o")


@register("""WITH d AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'inst:ValidatedForMaintenance' ELSE 'inst:NotSelected' END AS status FROM nation)
SELECT 'http://b/curation/id%20' || k AS decision_uri, 'http://b/document/' || k AS target_uri, replace(status, 'inst:', 'http://b/') AS status_uri, CASE WHEN k % 4 = 1 THEN 'Validated for maintenance' ELSE 'Not selected for maintenance' END AS status_label, 'http://b/act' AS activity_uri FROM d WHERE status <> '' AND k % 5 <> 0""")
def curation_source(spark, d):
    """Decisions on nations: some without a status, some on documents that aren't allowed."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    status = F.when(k % 4 == 0, "nan").when(k % 4 == 1, "inst:ValidatedForMaintenance").otherwise("inst:NotSelected")
    target = F.concat(F.lit("http://b/document/"), k.cast("string"))
    rows = n.select(F.concat(F.lit("id "), k.cast("string")).alias("id"), target.alias("target"), status.alias("status"))
    return curation.curation_rows(rows, n.where(k % 5 != 0).select(target.alias("document")), "http://b", {"activity_uri": "http://b/act"}).drop("status_definition")


@register("""SELECT conv_id, string_agg('<mark class="mention ' || role || '" data-id="' || turn || '">' || replace(replace(replace(replace(substr(text, 1, 5), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</mark>', '' ORDER BY turn) AS html FROM (SELECT * FROM conversations WHERE text NOT LIKE '%''%') GROUP BY conv_id""")
def mention_pages(spark, d):
    """The first five characters of each turn, marked by role, one conversation a page."""
    c = table(spark, d, "conversations").where("text NOT LIKE '%\\'%'")
    width = 5
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.rpad(F.substring("text", 1, width), width, "\0").alias("t")))), lambda x: x["t"]), "").alias("text"))
    spots = c.withColumn("n", nth).select("conv_id", (F.col("n") * width).alias("start"), (F.col("n") * width + F.length(F.substring("text", 1, width))).alias("end"), F.col("turn").cast("string").alias("active"))
    return writers.mention_pages(docs, spots, "conv_id", "text", c.select("conv_id", F.col("turn").alias("id"), F.col("role").alias("label")))


# --- rows by words and order -----------------------------------------------------------------------------------


@register("SELECT doc_id, len(regexp_extract_all(text, '(?i)tion')) AS hits FROM documents WHERE contains(lower(lang || source), 'en') AND regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)tion')")
def demo_rows(spark, d):
    docs = table(spark, d, "documents").withColumn("topic", F.concat("lang", "source"))
    return corpus.demo_rows(docs, "topic", "text", ("en", "nothing"), "the", "tion").select("doc_id", F.col("hits").cast("long").alias("hits"))


@register("SELECT p_partkey, upper(p_name) AS title FROM part")
def by_title(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("title"))
    return analytics.by_title(p, "title", "p_partkey")


@register("SELECT event_id::VARCHAR AS index, event_type FROM events")
def in_request_order(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("index"), "event_type")
    return analytics.in_request_order(e)


@register("""WITH r AS (SELECT n_nationkey AS place, CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE (n_nationkey % 7)::VARCHAR END AS idx FROM nation) SELECT place, r_name FROM r LEFT JOIN region ON r_regionkey = coalesce(try_cast(idx AS BIGINT), place)""")
def corpus_rows(spark, d):
    """The corpus row of a result by its index, else by its place, else none."""
    k = F.col("n_nationkey")
    results = table(spark, d, "nation").select(k.cast("long").alias("place"), F.when(k % 3 == 0, "x").otherwise((k % 7).cast("string")).alias("idx"))
    return joins.corpus_row(results, table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), "r_name"), "idx", "place", "key").select("place", "r_name")


@register("SELECT c_custkey, regexp_replace(c_mktsegment, '[^A-Z]+', '_', 'g') || ' | ' || replace(c_name, '#', '_') || ' | Unknown' AS id FROM customer WHERE c_acctbal > 5000")
def group_ids(spark, d):
    """Groups by several parts, of rows over a confidence that is a text."""
    c = table(spark, d, "customer").where(filters.confident(F.col("c_acctbal").cast("string"), 5000))
    return c.select("c_custkey", text.group_id(F.col("c_mktsegment"), F.col("c_name"), F.lit(" # ")).alias("id"))


# --- functions -------------------------------------------------------------------------------------------------

@register(r"""WITH a AS (SELECT p_partkey, p_name || ' (' || p_brand || ')' AS x, p_name, p_brand, p_type FROM part)
SELECT p_partkey, regexp_replace(p_name || '   (' || p_brand || ')', '\s+', ' ', 'g') AS squeezed, trim(regexp_replace(x, '[^\p{L}\p{N}]+', '_', 'g'), '_') AS grouped, regexp_replace(x, '[^A-Za-z0-9_]', '_', 'g') AS bnode,
trim(regexp_replace(x, '[^A-Za-z0-9_-]+', '-', 'g'), '-') AS css, replace(replace(p_type, ' ', '%20'), '#', '%23') AS part_of_iri, 'http://a.example/b#' || p_brand AS expanded, 'b:' || p_brand AS shortened, '\"a\\b\"' AS quoted,
substr(p_type, 1, 2) || ' [...] ' || substr(p_type, 4, 2) AS at_spans, lower(replace(p_type, ' ', '-')) AS topic_slug, p_name AS last_part, regexp_extract(p_brand, '[^#]*$') AS local, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'own ' || p_name END AS alternative,
p_name || '/' || p_brand || '/' AS template, 'ITEM12' AS opened FROM a""")
def text_functions(spark, d):
    p = table(spark, d, "part").withColumn("x", F.concat(F.lit("  "), "p_name", F.lit("   ("), "p_brand", F.lit(")  ")))
    both = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(5).alias("end")))
    prefixes = {"b": "http://a.example/b#", "a": "http://a.example/"}
    return p.select(
        "p_partkey", text.squeeze(F.col("x")).alias("squeezed"), text.group_part(F.col("x")).alias("grouped"), text.bnode_name(both).alias("bnode"), text.css_name(both).alias("css"), text.iri_part(F.col("p_type")).alias("part_of_iri"),
        text.expand_prefix(F.concat(F.lit("b:"), "p_brand"), prefixes).alias("expanded"), text.shorten_iri(F.concat(F.lit("http://a.example/b#"), "p_brand"), prefixes).alias("shortened"), text.escape_literal(F.lit('"a\\b"')).alias("quoted"),
        text.at_spans(F.col("p_type"), spans).alias("at_spans"), text.topic_slug(F.col("p_type")).alias("topic_slug"), text.last_part(F.concat(F.lit("http://a.example/x/"), "p_name")).alias("last_part"),
        text.local_name(F.concat(F.lit("http://a.example/b#"), "p_brand")).alias("local"), text.alternative_label(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" etc"))).otherwise(F.concat(F.lit("own "), "p_name")), F.col("p_name")).alias("alternative"),
        text.expand_template("{p_name}/{p_brand}/{missing}", p.columns).alias("template"), text.article_number(F.lit(" ARTICLE ITEM12.- of it")).alias("opened"),
    )


@register("""SELECT event_id, strftime(ts, '%d.%m.%Y') AS day, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END::INTEGER AS whole, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE event_id / (event_id % 2) END AS share, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id + 0.75 END AS sure,
(event_id * 2 + 3.0)::DOUBLE AS dot, CASE WHEN event_id % 4 = 0 THEN 32000 ELSE 128000 END AS window, '0-5;7-9' AS spans, 0 AS first, 9 AS last, [3, 1, 2] AS uniq FROM events""")
def value_functions(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    shown = F.when(k % 3 == 0, "nan").otherwise(F.concat(k.cast("string"), F.lit(".75")))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    clipped = values.clip_spans(F.array(span(-4, 5), span(7, 99), span(20, 30)), F.lit(9))
    first, last = values.span_bounds(clipped)
    return e.select(
        "event_id", values.french_date(F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).alias("day"), values.as_int(shown).alias("whole"), values.ratio(k, k % 2).alias("share"), values.confidence(F.when(k % 3 == 0, "x").otherwise(shown)).alias("sure"),
        values.dot(F.array(k.cast("double"), F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))).alias("dot"), values.context_window(F.when(k % 4 == 0, "model-32k").otherwise("model-x")).alias("window"), values.span_text(clipped).alias("spans"),
        first.alias("first"), last.alias("last"), values.ordered_unique(F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(2), F.lit(1))).alias("uniq"),
    )

