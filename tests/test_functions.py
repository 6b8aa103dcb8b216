import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import spans, text, values
from lexloom.plans.names import NAMES


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def each(spark, pairs, f):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == [b for _, b in pairs]


def test_blank(spark):
    each(spark, [("", True), (" ", True), ("NaN", True), ("None", True), ("NULL", True), ("na", True), (None, True), ("n", False), ("0", False)], text.blank)


FOLDED = ["L’Arrêté du 12", "œuvre", "ﬁn", "a b", "été", "🙂 x", "Ĳssel Ж½", "", "…", "straße", "ÀÉÎõü-Ç"]


def test_fold_is_the_same_with_and_without_python(spark):
    want = [(x, text.fold_text(x)) for x in FOLDED]
    assert want[0][1] == "l arrete du 12" and want[2][1] == "fin" and want[4][1] == "ete"
    each(spark, want, text.fold)
    each(spark, want, text.fold_latin)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_folding_twice_changes_nothing(x):
    assert text.fold_text(text.fold_text(x)) == text.fold_text(x)


def test_names_and_numbers(spark):
    each(spark, [("http://a/b#c", "c"), ("http://a/b/c/", "c"), ("p:q", "q"), ("plain", "plain"), (None, None)], text.local_name)
    each(spark, [("http://a/x/maintenance#hasSource", "maintenance#hasSource"), ("http://a/x#y", "x#y"), ("a#b", "b")], text.namespace_cut)
    each(spark, [("a b/é*~+", "a%20b%2F%C3%A9%2A~%2B")], text.iri_part)
    each(spark, [("Art. 12.- Le", "12"), ("article L1-2 : x", "L1"), ("  ARTICLE 3", "3"), ("The Article 3", ""), ("Art. 4) x", "4")], text.article_number)
    each(spark, [("<p>a  b</p>..... c", "a b. c"), ("x....y", "xy")], text.clean_markup)
    each(spark, [("Ünï cöde!", "uni-code"), ("***", "unnamed"), (None, "unnamed")], text.slug)
    each(spark, [("http://h/other/legal-act/x", "Unknown"), ("http://h/entity/legal-act/x", "LegalAct"), (None, None)], text.entity_class)
    each(spark, [("é!x", "é_x"), ("", "Unknown"), (None, "Unknown"), ("!!", "Unknown")], text.group_part)
    assert one(spark, 'a"b\\c\nd', text.escape_literal(F.col("x"))) == 'a\\"b\\\\c\\nd'
    assert one(spark, "v", text.expand_template("h/{x}/{none}-{x}", ["x"])) == "h/v/-v"
    assert one(spark, "ex:a", text.expand_prefix(F.col("x"), {"ex": "http://e/"})) == "http://e/a"
    assert one(spark, "http://e/f/a", text.shorten_iri(F.col("x"), {"e": "http://e/", "f": "http://e/f/"})) == "f:a"
    assert one(spark, "one two, three", text.token_budget(F.col("x"), 3)) == "one two,"
    assert one(spark, "one two, three", text.token_estimate(F.col("x"))) == 4
    assert one(spark, "a🙂bcd", text.at_spans(F.col("x"), F.expr("array(struct(0 as start, 2 as end), struct(3 as start, 4 as end))"))) == "a🙂 [...] c"


def test_swap_class_name(spark):
    rows = [("includesArtifacts", "Artifact", "Time", "includesTimes"), ("hasARTIFACTandArtifact", "artifact", "X", "hasXandArtifact"), ("plain", "Time", "X", "plain"), ("plain", None, "X", "plain")]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string").select("d", text.swap_class_name("a", "b", "c").alias("y")).collect()
    assert all(r.d == r.y for r in got)


DATES = [
    ("1994-06-27", "1994-06-27"), ("1994-06-27T10:00", "1994-06-27"), ("27.06.1994", "1994-06-27"), ("27/06/1994", "1994-06-27"), ("27-06-1994", "1994-06-27"), ("31.02.2001", "2001-02-31"),
    ("772675200", "1994-06-27"), ("772675200000", "1994-06-27"), ("1994", "1970-01-01"), ("x", ""), ("", ""), ("NaN", ""),
]


def test_dates(spark):
    each(spark, DATES, values.iso_date)
    assert one(spark, "772675200000", values.french_date(F.col("x"))) == "27.06.1994"


def test_keys(spark):
    d = spark.createDataFrame([("Arrêté du 20", None, "7")], "title string, corpus string, id string")
    got = d.select(NAMES.document_key(F.col("title"), F.col("corpus"), F.col("id")).alias("k"), NAMES.article_key(F.col("corpus"), F.col("id"), F.lit(3)).alias("a"), NAMES.entity(F.lit("Time"), F.lit("Le Délai")).alias("e"), NAMES.entity(F.lit("time"), F.lit("le  delai")).alias("f")).first()
    assert got.k.startswith("arrete-du-20-") and got.a == "article-7-3" and got.e == got.f


def test_cells(spark):
    cells = [
        ('[{"head": "a"}]', "json", 1), ('{"triplets": [{"head": "a"}, {"head": "b"}]}', "json", 2), ("[{'head': nan}]", "none", 1), ("[{'head': None}]", "python_literal", 1), ('{"x": 1}', "none", None), ("{bad", "none", None),
        ("", "none", None), (None, "none", None), ('{"legal_triplets": []}', "json", 0), ("(1, 2)", "none", None),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(cells)], "i int, c string")
    got = rows.select("i", values.parse_cell("c").alias("p"), values.any_triples(F.col("c")).alias("t")).orderBy("i").collect()
    assert [(r.p.parser, None if r.t is None else len(r.t)) for r in got] == [(p, n) for _, p, n in cells]
    assert got[6].p.error == "blank" and got[4].p.error == "json_payload_not_triplets" and got[3].p.json_valid and not got[3].p.syntax_valid
    assert got[0].p.error == "none" and got[2].p.error == got[3].p.error == got[5].p.error == "json_decode_error:Expecting property name enclosed in double quotes" and not got[2].p.json_valid
    fenced = "Sure:\n```json\n{\"a\": 1}\n```\nbye"
    each(spark, [(fenced, '{"a": 1}'), ('{"a": 2}', '{"a": 2}'), ("x {\"a\": 3} y", '{"a": 3}'), ("none", None)], values.json_in_text)


def test_span_columns(spark):
    row = spark.sql("SELECT array(struct(-2 as start, 3 as end), struct(5 as start, 99 as end), struct(4 as start, 4 as end)) as s, 1 as a, 6 as b")
    got = row.select(values.clip_spans(F.col("s"), F.lit(10)).alias("c"), values.spans_of(F.col("s"), F.col("a"), F.col("b")).alias("v"), values.spans_of(F.lit(None).cast("array<struct<start:int,end:int>>"), F.col("a"), F.col("b")).alias("w")).first()
    assert [tuple(x) for x in got.c] == [(0, 3), (5, 10)] and len(got.v) == 2 and [tuple(x) for x in got.w] == [(1, 6)]


GROUNDED = [
    ("the pump", "Check the pump now.", "exact", [(6, 14)]), ("The Pump", "check the pump now", "exact", [(6, 14)]), ("«pump» ", "a pump, b", "approx", [(2, 6)]), ("(pump). ", "a Pump, b", "exact", [(2, 6)]), ("foo bar", "a foo-bar", "approx", [(2, 9)]), ("l’eau chaude", "dans l'eau chaude", "approx", [(5, 17)]),
    ("ete froid", "un été froid", "approx", [(3, 12)]), ("red valve cold pipe", "red big valve near cold old pipe", "discontinuous", [(0, 3), (8, 13), (19, 23), (28, 32)]), ("absent", "nothing here", "none", []), ("", "x", "none", []), (None, "x", "none", []),
]


@pytest.mark.parametrize("mention, where, mode, found", GROUNDED)
def test_grounding(mention, where, mode, found):
    assert spans.ground_text(mention, where) == (mode, found)


def test_determiners():
    assert spans.ground_with_determiners("le contrôle", "après les contrôles") == [(6, 19)]
    assert spans.ground_with_determiners("la porte", "à la porte des portes") == [(2, 10)] and spans.ground_with_determiners("son poste", "des postes") == []
    assert spans.ground_with_determiners("le poste de travail", "à la  postes de travails") == [(0, 24)]
    assert spans.ground_with_determiners("l'eau", "de l'eau") == [(3, 8)] and spans.ground_with_determiners("zzz", "abc") == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=12), st.text(max_size=60))
def test_spans_lie_in_the_text(mention, where):
    _, found = spans.ground_text(mention, where)
    assert all(0 <= a < b <= len(where) for a, b in found)


def test_chosen_spans(spark):
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    some = F.expr("array(struct(1 as start, 2 as end))")
    got = spark.createDataFrame([("abc",)], "t string").select(*(spans.choose_spans(a, b, F.col("t")).alias(n) for n, a, b in (("x", some, none), ("y", values.spans_of(none, F.lit(0), F.lit(0)), some), ("z", values.spans_of(none, F.lit(0), F.lit(0)), values.spans_of(none, F.lit(0), F.lit(0)))))).first()
    assert [got.x.mode, got.y.mode, got.z.mode] == ["embedded", "inferred", "missing"]
    assert datetime.date  # the session's dates are UTC
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
