import pytest
from pyspark.sql import functions as F

from lexloom.llm.queries import RULES
from lexloom.llm.url_filter import judge_urls

URLS = [
    "http://example.org/es/x", "https://WWW.Example.ORG/en/1", "https://a.example.org/en/123?q", "http://notexample.org/es/", "http://x.com/fr/", "http://com/de/1", "http://example.org",
    "http://example.org?x=/es/", "ftp://b.c.com/de/#frag", None, "", "no scheme", "http:///es/", "x://y.net/fr/", "http://exämple.org/es/", "http://example.org/es", "a://org/", "http://a.org./x", "http://com/fr/de/",
]


def brute(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(h, p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, action string")


def test_against_brute_force(spark, rules):
    rows = [(i, u, "host") for i, u in enumerate(URLS + URLS[:3])]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted((i, *brute(u)) for i, u, _ in rows)


def test_same_without_broadcast(spark, rules, monkeypatch):
    monkeypatch.setattr("lexloom.llm.url_filter.BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    assert judge_urls(rows, rules).first().rule == "example.org/es/"


def test_empty_tables_and_ties(spark, rules):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(none, rules).count() == 0
    pages = spark.createDataFrame([(None, "http://a.org/x"), (1, None)], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, rules.limit(0)).collect()] == ["allow", "allow"]
    twice = rules.limit(0).union(spark.createDataFrame([("a.org", "/", "allow"), ("a.org", "/", "block"), (None, "/", "block"), ("", "/", "block")], rules.schema))
    assert {r.verdict for r in judge_urls(pages, twice).where(F.col("host") == "a.org").collect()} == {"block"}


def test_very_long_urls_and_many_rule_lengths(spark):
    dots = "http://" + "a." * 20_000 + "example.org/en/1" + "x" * 100_000
    many = [("b.net", "/" + "p" * n, "block" if n % 2 else "allow") for n in range(300)]
    listed = spark.createDataFrame([*RULES, *many], "host string, path string, action string")
    pages = spark.createDataFrame([(1, dots), (2, "http://c.b.net/" + "p" * 150), (3, "http://b.net/" + "p" * 1000)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, listed).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("b.net/" + "p" * 150, "allow"), 3: ("b.net/" + "p" * 299, "block")}
