import hashlib
import random
import re

import pytest

from lexloom.llm.secrets import BASE, MORE, digest_spans, find_secrets, redact, trigram_query, trigrams

PLAIN = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def brute(text):
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def some_texts(n=300):
    r = random.Random(4)
    parts = ["password", "Token = ", "SECRET: '", "api_key=", "apiKey\":  \"", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", " ", "\n", "=", "x", "A" * 15, "abcdefghijkl", "paſſword", "K"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = [*some_texts(), None, "", "no secret", "z" * 300_000 + " password=abcdefghijklmnop " + "y" * 300_000]
    docs = spark.createDataFrame([(i % 280, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = digest_spans(find_secrets(docs)).collect()
    want = sorted((i % 280, *(sum(x[2] == k for x in brute(t)) for k in PLAIN), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in brute(t)).encode()).hexdigest()) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_more_kinds_add_spans_only(spark):
    text = "token=ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY----- AKIA" + "B" * 16
    row = digest_spans(find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    kinds = [s.split(":")[0] for s in row.spans.split(",")]
    assert kinds == ["assign", "github", "pem", "access"]
    assert row.base_sha256 == hashlib.sha256(",".join(s for s in row.spans.split(",") if s.split(":")[0] in PLAIN).encode()).hexdigest()


@pytest.mark.parametrize("rule", BASE + MORE, ids=lambda r: r.kind)
def test_queries_are_mandatory(rule):
    """Every match holds what the query asks for."""

    def meets(query, text):
        op = query[0]
        return op == "all" or op == "tri" and query[1] in text or op == "and" and all(meets(q, text) for q in query[1:]) or op == "or" and any(meets(q, text) for q in query[1:])

    query = trigram_query(rule.pattern)
    for text in some_texts(2000):
        if re.search(rule.pattern, text):
            assert meets(query, bytes(b + 32 if 65 <= b < 91 else b for b in text.encode()))
    assert (rule.kind == "hex") == (not trigrams(query))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é token=abcdef0123456789abcdef, AKIA" + "C" * 16 + " end", "q"), (2, "clean", "q"), (3, None, "q")], "doc_id long, text string, spans string")
    out = redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é [secret], [secret] end", 2: "clean", 3: None}
    assert redact(docs.limit(0)).count() == find_secrets(docs.limit(0)).count() == 0
