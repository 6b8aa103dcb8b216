import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import minhash
from lexloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text, width=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute(rows, least=0.8):
    sets, bags = Sets(), [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= least:
                sets.join(i, j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(sets.find(i), []).append(d)
    return sorted((d, min(groups[sets.find(i)])) for i, (d, _) in enumerate(rows))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice("stuvw") * r.randint(1, 4)
    return " ".join(words)


def some_rows(seed, families=12):
    r = random.Random(seed)
    texts = []
    for _ in range(families):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(r.choice([3, 20, 80, 300]))]
        texts += [edited(r, words, r.randint(0, max(1, len(words) // 30))) for _ in range(r.randint(1, 14))]
        texts += [" ".join(words * 2)]
    texts += texts[:5] + [None, "", " \n", "one", "one", "two three"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_classes_against_brute_force(spark, seed):
    rows = some_rows(seed)
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, key string, node long")
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


@pytest.mark.parametrize("rows, feats", [(3, 1 << 16), (256, 40)])
def test_small_blocks_lose_nothing(spark, monkeypatch, rows, feats):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_FEATURES", feats)
    table = some_rows(11)
    got = minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(table)


def test_very_long_texts(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, edited(r, words, 2000)), (3, " ".join(words[:60_000])), (4, "a " * 200_000), (5, "a " * 190_000), (6, "a " * 100_000)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_what_leaders_leave_apart(spark):
    """A chain: each text is near the next, but the ends are far from the middle."""
    words = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(12):
        texts.append(" ".join([f"x{i}" for i in range(k * 4)] + words[k * 4 :]))
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute(rows)


def test_left_apart_finds_all_links(spark):
    """The second phase alone, on one family of which nothing is joined yet."""
    rows = [(i, t) for i, t in some_rows(7, 6) if t and t.strip()]
    rows = list({t: (i, t) for i, t in rows}.values())
    family = spark.createDataFrame([(-1, i, i) for i, _ in rows], "head long, node long, own long")
    packed = minhash.bags(pa.array([t for _, t in rows])).to_pylist()
    texts = spark.createDataFrame([(i, len(b) // 6, bytearray(b)) for (i, _), b in zip(rows, packed)], "node long, size long, bag binary")
    found = components(minhash._left_apart(family, texts, 0.8)).collect()
    got = {r.node: r.component for r in found}
    want = dict(brute(rows))
    assert sorted((i, got.get(i, i)) for i, _ in rows) == sorted(want.items())


def test_empty_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (3, "d e f g h"), (2, "d e f g h"), (2, "d e f g h"), (2, "x"), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in got), key=str) == sorted([(None, None, True)] * 2 + [(3, 2, False), (2, 2, True), (2, 2, True), (2, 2, True), (9, 9, True)], key=str)


def test_keep_one(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, "a b c d e f", "z"), (1, "other", "x"), (5, None, "x"), (5, None, "x"), (6, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = minhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text and r.text.strip()) == [(1, "a b c d e f"), (1, "other")]
    assert out.where(F.col("doc_id") > 4).count() == 3
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(0), []
    for k in range(150):
        a = rng.integers(0, 9, 40) * rng.integers(0, 2, 40)
        b = np.where(rng.random(40) < 0.7, a, rng.integers(0, 12, 40))
        key = minhash.mix(np.arange(40, dtype=np.uint64) + np.uint64(1000 * k)) >> np.uint64(16)
        text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = minhash.bag_minhash(text, np.concatenate([key[a > 0], key[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]).astype(float), 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.055


def test_a_signature_does_not_depend_on_its_batch():
    texts = [t for _, t in some_rows(3)]
    whole = minhash._sketch(pa.array(texts), 5)
    assert all((whole[i] == minhash._sketch(pa.array([t]), 5)[0]).all() for i, t in enumerate(texts))


def test_shingles_and_overlap():
    texts = [t for _, t in some_rows(5)]
    raw, starts, ends = minhash.utf8_column(pa.array(texts))
    row, _, count = minhash.shingles(raw, starts, ends)
    for i, t in enumerate(texts):
        assert sorted(count[row == i]) == sorted(bag(t).values())
    other = texts[1:] + texts[:1]
    got = minhash.overlap(*(minhash.bags(pa.array(t)).to_pylist() for t in (texts, other)))
    assert np.allclose(got, [similarity(bag(a), bag(b)) for a, b in zip(texts, other)])


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(5, 5), (None, 3)]
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: sets.find(x) for x in list(sets)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
