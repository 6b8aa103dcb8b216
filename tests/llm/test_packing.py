import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm.packing import best_fit, bin_completion, completions, lower_bound, pack


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(150):
        capacity = r.choice([10, 20, 50, 100])
        items = [r.randint(1, capacity) if r.random() < 0.5 else r.randint(capacity // 5, capacity // 2 + 1) for _ in range(r.randint(1, 11))]
        sizes = {x: items.count(x) for x in items}
        plan = bin_completion(sizes, capacity)
        got = {}
        for pattern, bins in plan:
            assert sum(s * t for s, t in pattern) <= capacity
            for s, t in pattern:
                got[s] = got.get(s, 0) + t * bins
        assert got == sizes
        assert lower_bound(sizes, capacity) <= sum(n for _, n in plan) == optimum(items, capacity) <= sum(n for _, n in best_fit(sizes, capacity))


def test_plans_do_not_grow_with_the_items():
    r = random.Random(1)
    sizes = {}
    for _ in range(50_000):
        x = min(2048, max(1, int(r.lognormvariate(6.2, 1))))
        sizes[x] = sizes.get(x, 0) + 1
    small, large = bin_completion(sizes, 2048), bin_completion({s: n * 10**6 for s, n in sizes.items()}, 2048)
    assert len(large) < 2 * len(small) + 100
    assert sum(n for _, n in large) <= sum(n for _, n in small) * 10**6
    assert sum(n for _, n in small) <= 1.003 * lower_bound(sizes, 2048)


def test_bad_sizes():
    assert bin_completion({}, 10) == []
    with pytest.raises(ValueError):
        bin_completion({11: 1}, 10)


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        k = -(-len(ids) // capacity)
        first = len(ids) - (k - 1) * capacity
        for piece in range(k):
            a = 0 if piece == 0 else first + (piece - 1) * capacity
            b = first + piece * capacity
            want.append((i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_round_trip(spark):
    r = random.Random(2)
    words = "the of tionné über <|endoftext|> 12 🙂 \n ñ".split(" ")
    rows = [(i, None if r.random() < 0.1 else " ".join(r.choice(words) for _ in range(r.choice([0, 3, 50, 400])))) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, "a"), (500, "x" * 100_000), (501, "\n" * 5000)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, length int, offset int")
    got = pack(docs, 256).collect()
    n = check(rows, got, 256)
    sizes = {}
    for x in got:
        sizes[x.length] = sizes.get(x.length, 0) + 1
    assert n == sum(k for _, k in bin_completion(sizes, 256)) <= sum(k for _, k in best_fit(sizes, 256))


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_filling_of_many_short_pieces_is_found():
    assert completions({1: 5000}, [1], 1, 2048, 0) == [((1, 2048),)]
    assert completions({2000: 1, 3: 9000}, [3, 2000], 2000, 2048, 0) == [((2000, 1), (3, 16))]
    assert completions({7: 900, 5: 900}, [5, 7], 7, 2048, 0)


def test_lengths_are_not_copied_by_python_workers(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    leaves, nodes = [], [pack(docs)._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        nodes += below
        leaves += [] if below else [node]
    made = [x.rdd().toDebugString() if x.nodeName() == "LogicalRDD" else x.nodeName() for x in leaves]
    assert "LocalRelation" in made and not any("PythonRDD" in x for x in made), made
