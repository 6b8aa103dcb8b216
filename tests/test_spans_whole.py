"""The span queries against brute force, over a small fixture with long texts and several items."""

import difflib
import re
import unicodedata
from pathlib import Path

import duckdb
import pytest

from lexloom import queries

ITEMS = ["The inspection of the lifts, twice a year.", "Zürich requires fire doors in hallways", "Handrails along every staircase today", "owners keep records of maintenance work"]
PAD = "unrelated filler prose about nothing whatsoever. " * 60  # 2,940 characters
TEXTS = [
    PAD + ITEMS[0] + PAD,
    PAD + "zürich REQUIRES fire doors in hallways",
    PAD + "handrails, along\nevery - staircase today!",
    PAD + "the owners often keep all records of regular maintenances work",
    PAD,
    "Zurich requires fire doors in hallway and " + ITEMS[0] + " " + ITEMS[3],
    "xx " + ITEMS[0][:41] + "? " + PAD + "handrails along every stair",
    "",
    None,
    "ſtaircase HANDRAILS ALONG EVERY ſTAIRCASE TODAY",
    "The inspection of the lifts, twice a decade",
]


def plain(text):
    """Characters without marks, in lower case, others as spaces; with their places, runs of spaces as one, none at the ends."""
    pairs = []
    for i, c in enumerate(text):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        pairs += [(x, i) for x in (base if base.isalnum() or not base else " ")]
    kept = [p for k, p in enumerate(pairs) if p[0] != " " or k and pairs[k - 1][0] != " "]
    while kept and kept[0][0] == " ":
        kept.pop(0)
    while kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


def token(word):
    return "".join(x for x in unicodedata.normalize("NFKD", word) if not unicodedata.combining(x) and x.isalnum()).lower()


def brute(mention, text):
    """The tiers, each tried in full: as it is, in any case, without outer marks; the longest common block; the words in order."""
    if not mention or not text:
        return "none", []
    if mention in text:
        return "exact", [(text.find(mention), text.find(mention) + len(mention))]
    if m := re.search(re.escape(mention), text, re.I):
        return "exact", [m.span()]
    core = mention.strip().strip(".,;:!?\"'()[]{}")
    if core and (m := re.search(rf"(?<!\w){re.escape(core)}(?:[\s\.,;:!?]|$)", text, re.I)):
        return "exact", [(m.start(), m.start() + len(m[0].rstrip(" \t\r\n.,;:!?")))]
    (short, _), (long_, places) = plain(mention), plain(text)
    block = difflib.SequenceMatcher(None, short, long_, autojunk=False).find_longest_match()
    if short and short in long_:
        at = long_.find(short)
        return "approx", [(places[at], places[at + len(short) - 1] + 1)]
    if short and block.size >= 0.55 * len(short):
        return "approx", [(places[block.b], places[block.b + block.size - 1] + 1)]
    words, at, spans = [(token(m[0]), *m.span()) for m in re.finditer(r"\w+", text) if token(m[0])], 0, []
    last = None
    for word in filter(None, map(token, re.findall(r"\w+", mention))):
        k = next((k for k in range(at, len(words)) if words[k][0] == word or min(len(word), len(words[k][0])) >= 5 and difflib.SequenceMatcher(None, word, words[k][0], autojunk=False).ratio() >= 0.88), None)
        if k is None:
            return "none", []
        spans = [*spans[:-1], (spans[-1][0], words[k][2])] if last is not None and k == last + 1 else [*spans, words[k][1:]]
        last, at = k, k + 1
    return ("discontinuous", spans) if spans else ("none", [])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("spans"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    # the query of round 1 looked only for the item of number doc_id % 40
    items = [(i, ITEMS[i % len(ITEMS)]) for i in range(len(TEXTS))] + [(40, "nothing whatsoever. unrelated"), (41, "An item that no text has at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(items)


def test_cascade_reads_long_documents_whole(spark, tables):
    d, items = tables
    got = {(r.doc_id, r.item_id): (r.mode, r.n) for r in queries.queries()["span_cascade"](spark, d).collect()}
    want = {(i, i): brute(items[i], t) for i, t in enumerate(TEXTS)}
    assert {k: got.get(k) for k in want if TEXTS[k[0]] is not None} == {k: (m, len(s)) for k, (m, s) in want.items() if TEXTS[k[0]] is not None}
    assert {m for m, _ in want.values()} == {"exact", "approx", "discontinuous", "none"}


def test_tiers_equal_brute_force():
    from lexloom.functions.spans import ground_text

    more = ["œuvre à Œrsted, ½ part", "foo-bar baz", "(foo bar)", "İİ xx ABC", "l’été \u0301 prochain", ". . ."]
    for mention in [*ITEMS, "nothing whatsoever. unrelated", "a", "ſtaircase", "?!", "foo bar", "«foo bar».", "abc", "Œuvre a œrsted", "ete prochaine", " padded "]:
        for text in [*TEXTS, *more]:
            if mention:
                assert ground_text(mention, text) == brute(mention, text), (mention, text)


def test_offsets_when_lower_case_is_longer(spark):
    from pyspark.sql import functions as F

    from lexloom.functions.spans import exact_span

    rows = spark.createDataFrame([("İİ xx ABC", "abc"), ("ΟΔΟΣ ab", "οδοσ"), ("x İstanbul", "istanbul"), ("", "a"), ("a", "")], "t string, m string")
    got = [[(x["start"], x["end"]) for x in r.s] for r in rows.select(exact_span(F.col("m"), F.col("t")).alias("s")).collect()]
    assert got == [[(6, 9)], [(0, 4)], [(2, 10)], [], []]


def test_cascade_of_every_item(spark, tables):
    d, items = tables
    got = sorted((r.doc_id, r.item_id, r.mode, r.n) for r in queries.queries()["span_cascade"](spark, d).collect())
    want = ((i, k, *brute(m, t)) for i, t in enumerate(TEXTS) for k, m in items.items())
    assert got == sorted((i, k, mode, len(s)) for i, k, mode, s in want)


def test_exact_of_every_whole_item(spark, tables):
    d, items = tables
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in queries.queries()["span_exact"](spark, d).collect()}
    want = {(i, k, t.find(m), t.find(m) + len(m)) for i, t in enumerate(TEXTS) if t for k, m in items.items() if m in t}
    assert want and {x for x in got if (t := TEXTS[x[0]]) and items[x[1]] in t} == want


WHOLE_SQL = """WITH p AS (SELECT doc_id, item_id, b.text AS mention, CASE WHEN instr(d.text, b.text) > 0 THEN instr(d.text, b.text) ELSE instr(lower(d.text), lower(b.text)) END AS i FROM documents d CROSS JOIN benchmark b)
SELECT doc_id, item_id, (i - 1)::INTEGER AS start, (i - 1 + length(mention))::INTEGER AS "end" FROM p WHERE i > 0 AND mention <> ''"""


def in_duckdb(d, sql):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        path = Path(d, f"{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return sorted(c.execute(sql).fetchall())


@pytest.mark.parametrize("place", ["fixture", "/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_exact_in_both_tiers(spark, tables, place):
    d = tables[0] if place == "fixture" else place
    got = sorted(tuple(r) for r in queries.queries()["span_exact"](spark, d).select("doc_id", "item_id", "start", "end").collect())
    assert got == in_duckdb(d, WHOLE_SQL)
    if place == "fixture":
        assert (1, 1, len(PAD), len(PAD) + len(ITEMS[1])) in got  # in another case
