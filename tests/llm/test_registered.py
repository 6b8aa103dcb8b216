"""The registered queries themselves, with their production parameters over the whole smallest tables, against brute force."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import lexloom.llm.queries as registered
from lexloom.llm import packing

from .test_html_text import article_text
from .test_minhash import brute as near_classes
from .test_repeats import brute as without_repeats
from .test_secrets import PLAIN
from .test_secrets import brute as secrets_of
from .test_vectors import brute_links

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return registered.queries()[name](spark, SF)


def test_op1(spark):
    found = {r.doc_id: r for r in run(spark, "op1_language_id").collect()}
    docs = rows("documents")
    assert sorted(found) == sorted(d["doc_id"] for d in docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in found.items())
    assert all((found[d["doc_id"]].lang_pred == "und") == (not any(map(str.isalpha, d["text"] or ""))) for d in docs)
    held = [d for d in docs if found[d["doc_id"]].held_out and d["lang"] and found[d["doc_id"]].lang_pred != "und"]
    assert np.mean([found[d["doc_id"]].lang_pred == d["lang"] for d in held]) >= 0.95


def test_op2(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {}
    for d in rows("documents"):
        ids = [*coder.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (len(ids) - 1) // 2048 * 2048
        marks = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(marks[:-1], marks[1:])):
            want[d["doc_id"], k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    got = run(spark, "op2_packing").collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    sizes = {}
    for _, n, _ in want.values():
        sizes[n] = sizes.get(n, 0) + 1
    assert len(sequences) <= packing.lower_bound(sizes, 2048) * 1.01 + 1


@pytest.mark.parametrize("name", ["op3_url_filters", "op5_mixing"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = c.execute(registered.oracle_sql()[name])
    columns = sorted(x[0] for x in found.description)
    order = [[x[0] for x in found.description].index(k) for k in columns]
    df = run(spark, name)
    assert sorted(df.columns) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(tuple(plain(r[k]) for k in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_op4(spark):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op4_suffix_dedup").collect())
    assert got == sorted(without_repeats([(d["doc_id"], d["text"]) for d in rows("documents")], 200))


def test_op6(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, "op6_html_extraction").collect()}
    for p in rows("pages"):
        want = article_text(p["html"])
        assert got[p["page_id"]] == (p["url"], want, len(want))


def test_op7(spark):
    docs = [(d["doc_id"], d["text"]) for d in rows("documents")]
    got = run(spark, "op7_minhash_dedup").collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == near_classes(docs)


def test_op8(spark):
    vectors = [(v["vec_id"], v["embedding"], v["label"]) for v in rows("embeddings")]
    got = run(spark, "op8_grid_join").collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(vectors)


def test_op9(spark):
    vectors = [(v["vec_id"], np.array(v["embedding"], float)) for v in rows("embeddings")]
    ids, unit = np.array([i for i, _ in vectors]), np.array([v / np.linalg.norm(v) for _, v in vectors])
    got, hits, total = {}, 0, 0
    for r in run(spark, "op9_nearest").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0)
    for q, found in got.items():
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        best = sorted(zip((-score).tolist(), ids.tolist()))[:5]
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - score[ids == i][0]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best})
        total += 5
    assert hits / total >= 0.9


def test_op10(spark):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in run(spark, "op10_secret_scan").collect()}
    for d in rows("documents"):
        found = secrets_of(d["text"])
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()
        assert got[d["doc_id"]] == (*(sum(x[2] == k for x in found) for k in PLAIN), digest)
