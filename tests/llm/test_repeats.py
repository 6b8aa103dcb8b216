import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import repeats


def brute(rows, least):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[p : p + least] for _, x in texts for p in range(len(x) - least + 1))
    out = []
    for i, x in texts:
        m = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - least + 1):
            if seen[x[p : p + least]] > 1:
                m[p : p + least] = True
        m = m[: len(x)]
        out.append((i, len(x), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~m])).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, least, crowd=2048):
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, key string, spans string")
    got = repeats.remove_repeats(docs, least, crowd).collect()
    assert all(len(r.spans) == r.n_spans and sum(b - a for a, b in r.spans) == r.n_removed for r in got)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)


def some_rows(seed, letters):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(20, 300))) for _ in range(12)]
    rows = []
    for i in range(50):
        parts = [r.choice(base)[r.randint(0, 10) : r.randint(30, 300)] if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(parts) if r.random() > 0.05 else None))
    return [*rows, *rows[:3], (100, "x" * 500), (101, "xy" * 200), (102, ""), (None, base[0])]


@pytest.mark.parametrize("least, crowd, letters", [(200, 2048, "abcdefgh é"), (40, 2048, "ab"), (25, 0, "ab"), (64, 2, "abc🙂"), (5, 2048, "abcdefghijkl")])
def test_against_brute_force(spark, least, crowd, letters):
    rows = some_rows(least, letters)
    assert run(spark, rows, least, crowd) == brute(rows, least)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    r = random.Random(0)
    long_ = "".join(r.choice("abcdef") for _ in range(7000))
    rows = [(1, long_), (2, long_[900:4321] + "x" + long_[5000:]), (3, long_[10:200]), (4, "y" + long_[1990:2200])]
    assert run(spark, rows, 100) == brute(rows, 100)


def test_no_repeats_and_empty(spark):
    assert run(spark, [(1, "abc"), (2, "abc"), (3, None)], 200) == brute([(1, "abc"), (2, "abc"), (3, None)], 200)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_merged_transforms(seed):
    r = random.Random(seed)
    least, rows = 8, []  # group, shard, bytes left of the anchor, block
    for g in range(6):
        core = bytes(r.choice(b"ab") for _ in range(4))
        for _ in range(r.randint(1, 9)):
            left, right = (bytes(r.choice(b"ab") for _ in range(r.randint(4, 9))) for _ in "xy")
            rows.append((g, r.randint(0, 2), len(left), left + core + right))
    rows.sort(key=lambda x: x[:2])
    shards = sorted({x[:2] for x in rows})
    parts = [[x for x in rows if x[:2] == s] for s in shards]
    transforms = [repeats.Transform.of([x[3] for x in p], np.array([x[2] for x in p])) for p in parts]
    row, at = repeats.merge_transforms(np.array([g for g, _ in shards]), transforms, least)
    got = set(zip(row.tolist(), (at + np.array([x[2] for x in rows])[row]).tolist()))
    want = set()
    for i, (g, _, b, x) in enumerate(rows):
        for p in range(len(x) - least + 1):
            for j, (h, _, c, y) in enumerate(rows):
                q = p - b + c
                if i != j and g == h and 0 <= q <= len(y) - least and x[p : p + least] == y[q : q + least]:
                    want.add((i, p))
    assert got == want


def test_a_transform_holds_the_symbols_by_what_stands_before_them():
    r = random.Random(1)
    data = [bytes(r.choice(b"abc") for _ in range(12)) for _ in range(40)]
    t = repeats.Transform.of(data, np.full(40, 3))
    for c in range(12):
        order = sorted(range(40), key=lambda i: (data[i][:c][::-1], i))
        assert t.columns[c].tobytes() == bytes(data[i][c] for i in order)


def test_a_passage_in_very_many_surroundings(spark):
    """One passage with others around it everywhere: its keys are crowded, and are made narrower until they fit."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(130)
    rows = [(i, word(r.randint(0, 60)) + r.choice(["", "x" * 30]) + passage + word(r.randint(0, 60))) for i in range(150)]
    assert run(spark, rows, 60, 8) == brute(rows, 60)
    assert run(spark, rows, 60, 0) == brute(rows, 60)


def test_anchors_take_every_string_once():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 100, 6000).astype(np.uint8)
    starts, ends = np.array([0, 1500, 1500, 1540]), np.array([1500, 1500, 1540, 6000])
    row, a, lo, hi, *_ = repeats.anchors(raw, starts, ends, 50)
    for i in range(4):
        own = sorted((x, y) for x, y, k in zip(lo, hi, row) if k == i)
        assert [p for x, y in own for p in range(x, y + 1)] == list(range(max(0, ends[i] - starts[i] - 49)))
    assert ((a >= hi) & (a <= lo + 50 - repeats.GRAM)).all()
