import json
import sys
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexloom.operators import compliance, curation, extraction, filters, fusion, ontology, reshape
from lexloom.plans import config, workload
from lexloom.plans.names import NAMES
from lexloom.plans.rml import Term, TriplesMap, construct, for_provider, pair, standard_maps
from lexloom.sources import readers, turtle, writers
from lexloom.streaming import resume


def walk(x, theta):
    """Leader clustering as a plain walk."""
    x = np.asarray(x, np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    out = [-1] * len(x)
    for i in range(len(x)):
        if out[i] < 0:
            out[i] = i
            for j in range(i + 1, len(x)):
                if out[j] < 0 and x[i] @ x[j] >= theta:
                    out[j] = i
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.sampled_from([0.3, 0.7, 0.9]), st.sampled_from([3, 7, 2048]))
def test_leaders_against_a_walk(seed, n, theta, block):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 5))
    x[rng.random(n) < 0.2] = x[0]
    x[rng.random(n) < 0.05] = 0
    got = fusion.lead(x, theta, block).tolist()
    assert got == walk(x, theta)
    assert all(got[g] == g for g in got)


def test_a_chain_is_not_one_cluster(spark):
    angle = np.array([0, 30, 60])
    x = np.stack([np.cos(np.radians(angle)), np.sin(np.radians(angle))], axis=1)
    rows = [("T", i, f"l{i}", x[i].tolist()) for i in range(3)] + [("U", 0, "one", [1.0, 0.0])]
    got = fusion.leader_clusters(spark.createDataFrame(rows, "type string, place int, label string, v array<double>"), "type", "place", "label", "v", 0.8).collect()
    assert {r.label: r.leader for r in got} == {"l0": "l0", "l1": "l0", "l2": "l2", "one": "one"}


def test_merge_entities(spark):
    rows = [("Le Délai", "Time", "p", "pompe", "Artifact"), ("le delai", "Time", "p", "pompes", "Artifact"), ("le delai", "Time", "p", "art 3", "Source"), (None, None, "p", "x", "Reference")]
    t = spark.createDataFrame(rows, "head string, head_type string, relation string, tail string, tail_type string")
    vectors = fusion.embed(fusion.entity_labels(t), "label", fusion.hashed_embedding)
    out, mapping = fusion.merge_entities(t, vectors, 0.6)
    got = [tuple(r) for r in out.select("head", "tail").collect()]
    assert sorted(got, key=str) == sorted([("le delai", "pompes"), ("le delai", "pompes"), ("le delai", "art 3"), (None, "x")], key=str)
    assert {r.label for r in mapping.collect()} == {"Le Délai", "le delai", "pompe", "pompes"}


def test_merge_relations_prefers_the_ontology(spark):
    rows = [(i, "Action", r, "Time") for i, r in enumerate(["hasTimes", "hasTimes", "hasTime", "other"])]
    t = spark.createDataFrame(rows, "row_id int, head_type string, relation string, tail_type string")
    vectors = fusion.embed(t.select(F.col("relation").alias("label")), "label", fusion.hashed_embedding)
    known = spark.createDataFrame([("Action", "hasTime", "Time")], "domain string, property string, range string")
    by_count = {r.relation for r in fusion.merge_relations(t, vectors, 0.7)[0].collect()}
    by_ontology = {r.relation for r in fusion.merge_relations(t, vectors, 0.7, signatures=known)[0].collect()}
    assert by_count == {"hasTimes", "other"} and by_ontology == {"hasTime", "other"}


TURTLE = """@prefix ex: <http://e/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
# a comment
ex:p a owl:ObjectProperty ; rdfs:domain [ a owl:Class ; owl:unionOf ( ex:A ex:B ex:C ) ] ; rdfs:range ex:R .
ex:q a owl:ObjectProperty ; rdfs:domain ex:A ; rdfs:range ex:R , ex:S ; rdfs:label "q\\u00e9 \\"x\\""@fr, 'plain', \"\"\"long
one\"\"\" , 12 , 1.5 , true , "2020-01-01"^^<http://www.w3.org/2001/XMLSchema#date> .
ex:A rdfs:subClassOf [ a owl:Restriction ; owl:onProperty ex:q ; owl:allValuesFrom ex:T ] .
ex:D rdfs:subClassOf [ a owl:Restriction ; owl:onProperty ex:p ; owl:someValuesFrom [ owl:unionOf ( ex:X ex:Y ) ] ] ."""


def graph_of(spark, text, tmp_path, name="g.ttl"):
    (tmp_path / name).write_text(text)
    return turtle.read_turtle(spark, str(tmp_path / name))


def test_ontology_signatures(spark, tmp_path):
    g = graph_of(spark, TURTLE, tmp_path)
    local = lambda df: {tuple(x and x.rsplit("/", 1)[1] for x in r) for r in df.select("domain", "property", "range").collect()}
    assert local(ontology.full_signatures(g)) == {("A", "p", "R"), ("B", "p", "R"), ("C", "p", "R"), ("A", "q", "T"), ("D", "p", "X"), ("D", "p", "Y")}
    assert local(ontology.simple_signatures(g)) == {(None, "p", "R"), ("A", "q", "R"), ("A", "q", "S")}
    assert ontology.repeated_expressions(g).count() == 1
    light = writers.light_ontology(ontology.full_signatures(g))
    assert "property q: A -> T" in light and "class A\n" in light


def test_turtle_round_trips(spark, tmp_path):
    g = graph_of(spark, TURTLE, tmp_path)
    labels = {(r.o, r.o_lang, r.o_datatype and r.o_datatype.rpartition("#")[2]) for r in g.where("p like '%label'").collect()}
    assert labels == {('qé "x"', "fr", None), ("plain", None, None), ("long\none", None, None), ("12", None, "integer"), ("1.5", None, "decimal"), ("true", None, "boolean"), ("2020-01-01", None, "date")}
    for form in ("nt", "turtle"):
        out = str(tmp_path / form)
        turtle.write_graph(g, out, form)
        again = turtle.read_turtle(spark, out) if form == "turtle" else turtle.read_ntriples(spark, out)
        ground = lambda df: sorted(map(tuple, df.where("s_kind = 'iri' AND o_kind <> 'bnode'").collect()), key=str)
        assert ground(again) == ground(g) and again.count() == g.count()
    turtle.write_graph(g.limit(2), str(tmp_path / "nt"), mode="append")
    assert turtle.read_ntriples(spark, str(tmp_path / "nt")).count() == g.count()
    for form in ("json-ld", "xml"):
        turtle.write_graph(g, str(tmp_path / form), form)
    objects = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json-ld")).collect()]
    assert sum(len(v) for o in objects for k, v in o.items() if k != "@id") == g.count()
    q = next(o for o in objects if o["@id"] == "http://e/q")
    assert {"@value": 'qé "x"', "@language": "fr"} in q["http://www.w3.org/2000/01/rdf-schema#label"]
    trees = [ElementTree.fromstring(x.read_text()) for x in (tmp_path / "xml").glob("part-*") if x.stat().st_size]
    assert sum(len(d) for t in trees for d in t) == g.count()
    writers.write_partitioned(g, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).where("predicate = 'label'").count() == 7
    with pytest.raises(ValueError):
        turtle.parse_turtle("<a> <b> } .")


def test_extended_ontology_text_reads_back(spark, tmp_path):
    rows = [("http://e/A", "http://e/p", "http://e/R", 0.9, 2), ("http://e/B", "http://e/p", "http://e/S", 0.7, 1), ("http://e/A", "http://e/q", "http://e/R", 0.8, 1)]
    c = spark.createDataFrame(rows, "domain string, property string, range string, confidence double, evidence int")
    text = writers.ontology_turtle(ontology.property_constraints(c), ontology.ranges_by_domain(c))
    got = {tuple(r) for r in ontology.full_signatures(graph_of(spark, text, tmp_path)).collect()}
    assert got == {(a, p, r) for a, p, r, *_ in rows}
    shapes = writers.shapes_turtle(compliance.shapes(c))
    assert shapes.count("sh:targetClass") == 3 and turtle.parse_turtle(shapes)


def test_rml_terms(spark):
    rows = spark.createDataFrame([("1", "a", None), ("", "b", "x"), ("1", "a", None)], "id string, v string, w string")
    maps = [
        TriplesMap("t", Term(template="h/{id}"), ("C",), (pair("p", Term(reference="v"), Term(constant="k", kind="literal", datatype="d"), Term(reference="w"), Term(reference="none")), pair("q", Term(template="n-{id}", kind="bnode")))),
        TriplesMap("t", Term(reference="id"), (), (((Term(template="pred/{v}"), "r"), (Term(template="{w}", kind="iri"),)),)),
    ]
    got = {(r.s, r.p.rpartition("#")[2], r.o, r.o_kind, r.o_datatype) for r in construct({"t": rows}, maps).collect()}
    assert got == {
        ("h/1", "type", "C", "iri", None), ("h/", "type", "C", "iri", None), ("h/1", "p", "a", "literal", None), ("h/", "p", "b", "literal", None), ("h/1", "p", "k", "literal", "d"), ("h/", "p", "k", "literal", "d"),
        ("h/", "p", "x", "literal", None), ("h/1", "q", "n_1", "bnode", None), ("h/", "q", "n_", "bnode", None),
    }
    scoped = for_provider(maps, "prov")
    assert "prov_n_1" in {r.o for r in construct({"t": rows}, scoped).collect()}
    assert len(standard_maps(NAMES, run="r")) >= 14


def test_workload_semantics(spark):
    """Several labels multiply rows, both kinds of sources count, unbound terms give no triple."""
    c, d = NAMES.core, NAMES.domain
    rdf, skos, prov = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/ns/prov#"
    t = [("s", rdf + "type", c + "ExtractedRelation"), ("s", rdf + "subject", "a"), ("s", rdf + "predicate", d + "hasSource"), ("s", rdf + "object", "b"), ("s", prov + "hadPrimarySource", "art"), ("s", prov + "wasDerivedFrom", "art"),
         ("a", rdf + "type", c + "Action"), ("b", rdf + "type", c + "Source"), ("a", skos + "prefLabel", "A1"), ("a", skos + "prefLabel", "A2"), ("x", rdf + "subject", "a"), ("a", d + "justifiedBy", "b")]
    g = workload.Graph(spark.createDataFrame([(s, "iri", p, o, "iri", None, None) for s, p, o in t], "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"), NAMES)
    assert workload.justified_elements(g).count() == 2 and workload.action_sources_with_mentions(g).count() == 4
    assert workload.action_sources(g).count() == 2
    assert workload.construct_article(g, "art").count() == 6 and workload.construct_entities(g, "art").count() == 8
    told = workload.run_all(g, {"good": workload.signature_counts, "bad": lambda g: g.none})
    assert [x["status"] for x in told] == ["ok", "error"]


def test_refs_and_topics(spark):
    rows = spark.sql("SELECT 1 AS id, map('d1', array(struct('c' AS CID, 't' AS Title, array(struct('h' AS chapterTitle, 'x' AS content), struct('h' AS chapterTitle, 'y' AS content)) AS Articles))) AS refs")
    rows = rows.unionByName(rows.select(F.lit(2).alias("id"), F.map_filter("refs", lambda k, v: F.lit(False)).alias("refs")))
    out = reshape.expand_refs(rows, dated_refs="refs").orderBy("id", "content").collect()
    assert [(r.id, r.corpus_id, r.content) for r in out] == [(1, "c", "x"), (1, "c", "y"), (2, None, None)]
    cells = spark.createDataFrame([(1, "['Sécurité', \"Eau\"]"), (2, "Gaz"), (3, "nan"), (4, None)], "k int, domain string")
    assert {(r.k, r.topic_slug) for r in reshape.topics(cells, "domain", "k").collect()} == {(1, "securite"), (1, "eau"), (2, "gaz")}


def test_renest_keeps_rows_without_new_triples(spark):
    schema = "id int, t array<struct<head:string,topic:string>>"
    rows = spark.createDataFrame([(1, [("a", "x"), ("b", "y")]), (2, [("c", "x"), ("d", "y")]), (3, None)], schema)
    flat = spark.createDataFrame([(1, 1, "B", "y"), (1, 0, "A", "x")], "id int, pos int, head string, topic string")
    out = {r.id: r.t and [x.head for x in r.t] for r in reshape.renest_triples(rows, flat, "t", "id", ["head", "topic"], keep=lambda t: t["topic"] == "y").collect()}
    assert out == {1: ["A", "B"], 2: ["d"], 3: None}


def test_curated_predicates(spark):
    rows = [("http://n#includesArtifacts", "http://n#Time", None, "http://n#includesTimes"), ("http://n#hasX", "http://n#Time", None, "http://n#hasXTime"), ("http://n#hasX", "http://n#Time", "http://m#own", "http://m#own")]
    d = spark.createDataFrame(rows, "p string, r string, iri string, want string")
    got = d.select("want", curation.curated_predicate(F.col("p"), F.col("r"), ["Artifact", "Time"], iri=F.col("iri"), namespace="http://n#").alias("y")).collect()
    assert all(r.want == r.y for r in got)
    notes = spark.createDataFrame([("1",), ("-1",), ("0",)], "a string")
    assert curation.checked_annotations(notes, "a").count() == 3
    with pytest.raises(Exception, match="not an annotation"):
        curation.checked_annotations(spark.createDataFrame([("2",)], "a string"), "a").collect()


def test_curation_layer(spark):
    s = spark.createDataFrame([("s1", "a", "p", "b")], "stmt string, s string, p string, o string")
    t = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "C")], "node string, cls string")
    notes = spark.createDataFrame([("p", "B", "C", 0, "p2"), ("p", "A", "C", -1, None)], "predicate string, domain string, range string, annotation int, curated string")
    curated = curation.curate(s, t, notes)
    assert curated.first().asDict()["status"] == "not_verified"
    assert curation.curation_triples(curated, "http://x").count() == 5


def test_graph_compliance_of_several_types(spark):
    rows = spark.createDataFrame([("s", "a", "n#p", "b"), ("u", "a", "n#z", "b"), ("v", "q", "n#p", "b"), ("w", "a", "other#z", "b")], "stmt string, s string, p string, o string")
    types = spark.createDataFrame([("a", "n#A"), ("a", "n#B"), ("b", "n#C"), ("q", "n#Unknown")], "node string, cls string")
    known = spark.createDataFrame([("n#B", "n#p", "n#C"), ("n#A", "n#y", "n#A")], "domain string, property string, range string")
    got = {r.stmt: r.reason for r in compliance.check_graph(rows, types, known, ["n#"]).collect()}
    assert got == {"s": "none", "u": "predicate_not_in_ontology", "v": "resource_type_missing_in_kg"}
    terms = spark.createDataFrame([("n#A",), ("m#B",), ("k#B",)], "iri string")
    words = spark.createDataFrame([("A",), ("B",), ("n#A",)], "x string")
    assert sorted(r.x for r in compliance.normalise(words, "x", terms).collect()) == ["B", "n#A", "n#A"]


def test_boilerplate(spark):
    jo = "au Journal officiel de la République française"
    rows = [
        (" Arrête:\n", True), ("ARRÊTENT:", True), ("Arrête :", False), ("arrête: x", False), (None, False), ("Décrète:", False),
        (f"Le présent arrêté sera publié {jo}.", True), (f"L'ARRÊTÉ du 3 mai,\ndont la Publication  {jo} suit, " + "x" * 90, True), (f"Publié {jo}", False), (f"Les arrêtés publié {jo}", False), (f"Le présent arrêté sera publié {jo}e", False),
        ("Le présent arrêté entre en vigueur le 1er juillet 2015.", True), ("Le présent arrêté entrera en vigueur le 12 août 2015", True), ("Le présent arrêté entre en vigueur le 1er juillet 2015 " + "x" * 60, False),
        ("Le présent décret entre en vigueur le 1er mars 2020", False), ("Le présent arrêté entre en vigueur demain", False),
    ]
    got = spark.createDataFrame(rows, "x string, want boolean").select("want", filters.boilerplate(F.col("x")).alias("y")).collect()
    assert all(r.want == r.y for r in got)


def test_config():
    files = {"base": {"a": 1, "p": {"x": 1, "y": "${a}"}, "stages": []}, "top": {"inherits": "base", "p": {"x": 2}, "stages": [{"name": n, "action": "f", "options": {"v": "${p.y}", "w": "n-${p.x}"}, "enabled": n != "two"} for n in ("one", "two", "three")]}, "loop": {"inherits": ["loop"]}}
    c = config.resolve("top", files.get)
    assert c["p"] == {"x": 2, "y": "${a}"}
    calls = []
    told = config.run(c, {"f": lambda **o: calls.append(o)}, first="one", last="two")
    assert calls == [{"v": 1, "w": "n-2"}] and len(told) == 1
    assert len(config.run(c, {}, dry=True)) == 2 and config.arguments({"a_b": True, "c": [1, 2], "d": None, "e": False, "f": "x"}) == ["--a-b", "--c", "1", "--c", "2", "--f", "x"]
    with pytest.raises(ValueError):
        config.resolve("loop", files.get)
    with pytest.raises(ValueError):
        config.choose(c["stages"], only=["none"])
    with pytest.raises(KeyError):
        config.render("${nope}", c)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    def __init__(self):
        self.n = 0

    def __call__(self, prompt):
        self.n += 1
        if "broken" in prompt:
            raise TimeoutError("no answer")
        return extraction.Stub()(prompt)[0], (7, 3)


def test_extraction(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The operator must inspect. The owner must pay."), (2, "broken"), (3, None), (4, "Nothing.")], "id long, content string")
    options = {"text": "content", "make_provider": Flaky, "types": ["Actor", "Action"], "topics": ["maintenanceActivity"], "tries": 2, "wait": 0.0}
    for two_steps in (True, False):
        got = {r.id: r for r in extraction.extract(docs, "id", two_steps=two_steps, **options).collect()}
        assert [t["tail"] for t in json.loads(got[1].legal_triplets)] == ["inspect", "pay"]
        assert got[2].error == "ERROR: no answer" and not got[2].valid_json and got[3].legal_triplets == "[]"
        assert (got[1].context_main_topic == "maintenanceActivity") == (not two_steps)
        assert got[1].input_tokens == 14
    again = extraction.reparse(extraction.extract(docs, "id", **options).drop("legal_triplets"))
    assert "inspect" in again.where("id = 1").first().legal_triplets
    folder = str(tmp_path / "done")
    assert extraction.extract_resumable(docs.limit(2), "id", folder=folder, **options).count() == 2
    assert extraction.extract_resumable(docs, "id", folder=folder, **options).count() == 4
    assert spark.read.parquet(folder).count() == 4
    models = [{"candidates_object_props": [{"a": 1, "b": 2}]}, {"candidates_object_props": [{"b": 2, "a": 1}, {"a": 3}]}]
    assert extraction.merge_models(models)["candidates_object_props"] == [{"a": 1, "b": 2}, {"a": 3}]
    batches = spark.createDataFrame([(0, ["x", "y"])], "batch int, items array<string>")
    assert json.loads(extraction.discover(batches, "batch", "items", extraction.Stub).first().model)["legal_triplets"] == []


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿\"id\";text\n1;\"two\nlines \"\"q\"\"\"\n2;é\n".encode())
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), None)
    assert rows.columns == ["id", "text"] and {r.text for r in rows.collect()} == {'two\nlines "q"', "é"}
    (tmp_path / "b.csv").write_bytes("id,text\n1,é\n".encode("cp1252"))
    assert readers.read_csv_any_encoding(spark, str(tmp_path / "b.csv")).first().text == "é"
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "d.json").write_text('[{"id": 1}, {"id": 2}, {"id": 3}]')
    assert [readers.read_articles(spark, str(tmp_path / n)).count() for n in ("c.jsonl", "d.json", "a.csv")] == [2, 3, 2]
    (tmp_path / "m.json").write_text(json.dumps({"candidates_object_props": [{"object_prop_candidate": "p", "domain": "A", "range": "B", "confidence": c, "textual_evidence": ["x"], "definition": d} for c, d in ((0.9, None), ("0.8", "def"), ("bad", "z"), (0.7, "q"))]}))
    found = readers.read_candidates(spark, str(tmp_path / "m.json"), 0.7).first()
    assert (found.evidence, found.definition) == (2, "def") and abs(found.confidence - 0.85) < 1e-9
    writers.write_csv(rows.withColumn("b", F.lit(1)).withColumn("a", F.lit(2)), str(tmp_path / "out"), ["text", "missing"], quote_all=True)
    assert readers.read_csv(spark, str(tmp_path / "out")).columns == ["text", "missing", "a", "b", "id"]
    writers.write_texts(rows, str(tmp_path / "texts"), "id", "text")
    assert readers.graph_paths(spark, files=["/z.ttl"], globs=[str(tmp_path / "*.jsonl")])[0] == "/z.ttl"
    assert {r.name for r in readers.term_lookup(spark, "<http://a/b#c> <http://a/d>").collect()} == {"c", "d"}


def test_html_marks():
    assert writers.mention_html("a<b cd", [(0, 1, ""), (1, 3, "M1,M2"), (3, 6, "")]) == 'a<mark class="mention" data-id="M1"><mark class="mention" data-id="M2">&lt;b</mark></mark> cd'


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = resume.stream_articles(spark, str(tmp_path / "in"), events.schema, files_each=1)
    for _ in range(2):  # the second run finds nothing new
        resume.extract_stream(stream, lambda b: b.select("event_id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == done.select("event_id").distinct().count() == events.count()
    query = resume.window_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()


def test_timeouts_topics_contexts_and_batches(spark):
    import time as clock

    calls = []

    def slow(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            clock.sleep(2)
        return "answer", None

    assert extraction.ask(slow, "p", tries=2, wait=0, timeout=0.2)[0] == "answer" and len(calls) == 2
    assert extraction.ask(lambda p: clock.sleep(2), "p", tries=1, wait=0, timeout=0.1)[0].startswith("ERROR: no answer")

    stored = spark.createDataFrame([(1, "The owner must check"), (2, "nothing")], "id long, text string")
    raw = extraction.extract(stored, "id", "text", extraction.Stub, ["Actor"], [], True).drop("legal_triplets")
    again = extraction.reparse(raw, make_provider=extraction.Stub, topics=["a"]).collect()
    assert {r.id: (json.loads(r.legal_triplets) or [{}])[0].get("topic") for r in again} == {1: "maintenanceActivity", 2: None}
    assert {r.context_main_topic for r in again} == {"maintenanceActivity", None}

    asked = []

    def proposes(prompt):
        asked.append(prompt)
        return json.dumps({"candidates_object_props": [{"name": f"p{len(asked)}"}]}), None

    model, own = extraction.discover_in_turn([("a", [1]), ("b", [2])], proposes)
    assert [x["name"] for x in model["candidates_object_props"]] == ["p1", "p2"] and [k for k, _ in own] == ["a", "b"]
    assert "p1" not in asked[0] and '"p1"' in asked[1]

    class Service:
        def __init__(self):
            self.jobs, self.polls = [], 0

        def upload(self, lines):
            self.jobs.append(lines)
            return str(len(self.jobs) - 1)

        def status(self, job):
            self.polls += 1
            return "running" if self.polls % 2 else "failed" if "bad" in "".join(self.jobs[int(job)]) else "completed"

        def download(self, job):
            rows = [json.loads(x) for x in self.jobs[int(job)]]
            return [json.dumps({"custom_id": r["custom_id"], "output": r["prompt"].upper()}) for r in reversed(rows) if r["prompt"] != "lost"]

    requests = spark.createDataFrame([(1, "a"), (2, "lost"), (3, "bad"), (4, "d"), (5, "e")], "id long, prompt string").coalesce(1)
    got = {r.id: (r.output, r.error) for r in extraction.run_batch(requests, "id", "prompt", Service, per_job=2, poll=0).collect()}
    assert got == {1: ("A", None), 2: (None, "no output"), 3: (None, "failed"), 4: (None, "failed"), 5: ("E", None)}


def test_vectors_at_hand_are_not_asked_for(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("b",)], "label string")
    known = spark.createDataFrame([("s", "m", "a", [9.0]), ("s", "other", "b", [8.0])], "service string, model string, text string, vector array<double>")

    def provider(texts):
        assert texts == ["b"]
        return [[1.0]]

    assert sorted(map(tuple, fusion.embed(labels, "label", provider, known=known, service="s", model="m").collect())) == [("a", [9.0]), ("b", [1.0])]


def test_configurations_in_files(tmp_path):
    (tmp_path / "base.json").write_text('{"a": 1, "b": {"c": 2}}')
    (tmp_path / "top.json").write_text('{"inherits": "base", "b": {"d": 3}}')
    assert config.resolve("top", config.loader(str(tmp_path))) == {"a": 1, "b": {"c": 2, "d": 3}}
    with pytest.raises(FileNotFoundError):
        config.loader(str(tmp_path))("none")


def test_names_are_taken_for_their_only_term(spark):
    s = spark.createDataFrame([("http://x/A", "http://x/p", "http://x/B")], "domain string, property string, range string")
    terms = spark.createDataFrame([("http://x/A",), ("http://x/p",), ("http://x/B",), ("http://y/B",)], "iri string")
    rows = spark.createDataFrame([("A", "p", "B"), ("A", "p", "http://x/B")], "head_type string, relation string, tail_type string")
    got = {r.tail_type: (r.head_type, r.full_match, r.local_match) for r in compliance.check_triples(rows, s, terms).collect()}
    assert got == {"B": ("http://x/A", False, True), "http://x/B": ("http://x/A", True, True)}
