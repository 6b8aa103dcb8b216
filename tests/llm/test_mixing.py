import hashlib
import random
import re

import pytest

from lexloom.llm.mixing import apply_mix, mix_sources

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what is above a cap is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * level > cap * sizes[n]}
        if not over:
            return out | {n: weight[n] * level for n in open_}
        out |= {n: float(cap * sizes[n]) for n in over}
        open_ -= over
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size string, key string")


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    sources = ["a", "b", "ä", None, "B", ""]
    rows = [(i if r.random() > 0.05 else None, None if r.random() < 0.1 else " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 30))) + "\t\n", sources[min(5, int(r.random() ** 3 * 6))], "x", "y", "z") for i in range(300)]
    rows += rows[:2]
    got = mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = targets(sizes)
    for source, target in want.items():
        own = [x for x in got if x.source == source]
        assert all(abs(x.target - target) < 1e-6 for x in own)
        assert abs(sum(x.taken for x in own) - int(target + 1e-9)) <= 1
        assert all(0 <= x.taken <= 3 * x["size"] for x in own)
        assert all(x.source_size == sizes[source] for x in own)


def test_order_is_by_hash_and_reruns_agree(spark):
    rows = [(i, "a b c d", "s" if i % 3 else "t", "", "", "") for i in range(60)]
    one, two = (sorted(mix_sources(table(spark, rows)).collect()) for _ in range(2))
    assert one == two
    partly = [x for x in one if x.source == "t"]
    ranked = sorted(partly, key=lambda x: hashlib.md5(str(x.doc_id).encode()).hexdigest())
    taken = [x.taken for x in ranked]
    assert taken == sorted(taken, reverse=True)


def test_nothing_to_mix(spark):
    assert mix_sources(table(spark, [])).count() == 0
    got = mix_sources(table(spark, [(1, None, None, "", "", ""), (2, " ", "a", "", "", "")])).collect()
    assert [(x["size"], x.target, x.taken) for x in got] == [(0, 0.0, 0)] * 2


def test_apply(spark):
    rows = [(i, f"one two\tthree {i}", "a" if i < 4 else "b", "x", "y", "z") for i in range(24)]
    docs = table(spark, rows)
    mixed = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    out = apply_mix(docs)
    assert out.columns == docs.columns
    words, texts = {}, {i: t for i, t, *_ in rows}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
        assert r.text == texts[r.doc_id] or texts[r.doc_id].split()[: size(r.text)] == r.text.split(" ")
    assert words == {k: v for k, v in mixed.items() if v}
    assert apply_mix(docs.limit(0)).count() == 0


def test_apply_is_exact_on_repeated_rows(spark):
    """Equal rows at a source's cut, in differing company; words are neither lost nor added."""
    same = [(7, " ".join(f"w{k}" for k in range(14)), "a", f"x{i}", "", "") for i in range(7)]
    rows = [*same, *((i, "one two three four five", "b", "", "", "") for i in range(40)), *((3, None, "a", "", "", ""),) * 2, (None, "null id here", None, "", "", ""), (None, "null id here", None, "", "", "")]
    for n in (1, 3):
        docs = table(spark, rows).repartition(n)
        got = mix_sources(docs).collect()
        want = {}
        for r in got:
            want[r.source] = want.get(r.source, 0) + r.taken
        out = {}
        for r in apply_mix(docs).collect():
            out[r.source] = out.get(r.source, 0) + size(r.text)
        assert out == {s: n for s, n in want.items() if n}
    # a budget that ends within the equal rows: 7 * 14 words of "a" are 98, the other source is far smaller
    few = [*same, *((i, "one two three", "b", "", "", "") for i in range(3))]
    taken = [r.taken for r in mix_sources(table(spark, few), weights=(1, 1)).collect() if r.source == "a"]
    assert sum(size(r.text) for r in apply_mix(table(spark, few), weights=(1, 1)).collect() if r.source == "a") == sum(taken)
    assert 0 < sum(taken) < 98


def test_many_sources(spark):
    """Targets over several ranges of sources agree with brute force."""
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 9))), f"s{r.randint(0, 400)}", "", "", "") for i in range(1500)]
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = targets(sizes)
    for x in mix_sources(table(spark, rows)).collect():
        assert abs(x.target - want[x.source]) < 1e-6


def test_a_very_long_text(spark):
    docs = table(spark, [(1, "word " * 400_000, "a", "", "", ""), (2, "w " * 10, "b", "", "", "")])
    taken = {r.doc_id: r.taken for r in mix_sources(docs).collect()}
    out = {}
    for x in apply_mix(docs).collect():
        out[x.doc_id] = out.get(x.doc_id, 0) + size(x.text)
    assert out == {k: v for k, v in taken.items() if v}


def test_main_path_is_native(spark):
    plan = mix_sources(table(spark, [(1, "a", "s", "", "", "")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
