import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, grid_join

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, n_links string"


def some_vectors(seed=0, n=260, d=20, groups=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n // 2, 2):  # neighbours, copies and scaled copies
        x[i + 1] = x[i] * rng.uniform(0.5, 2) + rng.standard_normal(d) * rng.choice([0, 0.05, 0.2, 0.35])
    x[200:230] = x[7] + rng.standard_normal((30, d)) * 0.02
    label = [None if r < 0.05 else int(r * groups) for r in rng.random(n)]
    rows = [(i, x[i].astype(np.float32).tolist(), label[i], 0, "c") for i in range(n)]
    bad = [(900, None, 0, 0, "c"), (901, [0.0] * d, 0, 0, "c"), (902, [None] * d, 0, 0, "c"), (903, [float("nan")] * d, 0, 0, "c"), (904, [float("inf")] * d, 0, 0, "c"), (905, [1.0], 0, 0, "c"), (906, [], 0, 0, "c")]
    few = [rng.standard_normal(3) for _ in range(4)]
    other = [(950 + i, (few[i % 4] * (1 + i % 3)).tolist(), i % 2, 0, "c") for i in range(16)] + [(970, x[0][:19].astype(np.float32).tolist(), label[0], 0, "c"), (971, [0.0] * 19 + [-0.0], 0, 0, "c")]
    return rows + bad + other + [(3, rows[2][1], label[2], 0, "c"), (None, rows[4][1], label[4], 0, "c")]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, least=0.93):
    n = len(rows)
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if usable(r[1]) else None for r in rows]
    hit = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                hit[i, j] = unit[i] @ unit[j] >= least
    comp = np.arange(n)
    while True:
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    ids = {c: [rows[i][0] for i in range(n) if comp[i] == c] for c in set(comp)}
    least_id = {c: min((x for x in v if x is not None), default=None) for c, v in ids.items()}
    return sorted(((rows[i][0], int(hit[i].sum()), least_id[comp[i]]) for i in range(n)), key=str)


@pytest.mark.parametrize("seed, block, fan", [(0, 1024, 8), (1, 16, 2), (2, 7, 3), (3, 1, 2)])
def test_grid_join_against_brute_force(spark, monkeypatch, seed, block, fan):
    monkeypatch.setattr(grid_join, "BLOCK", block)
    monkeypatch.setattr(grid_join, "FAN", fan)
    rows = some_vectors(seed)
    got = grid_join.join_similar(spark.createDataFrame(rows, SCHEMA), axes=4).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None and r.component_id is not None)


def test_blocks_that_are_far_apart_are_skipped(spark):
    """Two distant crowds: their blocks never meet."""
    rng = np.random.default_rng(3)
    a, b = np.eye(8)[0] * 5, np.eye(8)[1] * 5
    x = np.concatenate([a + rng.standard_normal((40, 8)) * 0.1, b + rng.standard_normal((40, 8)) * 0.1])
    boxes = spark.createDataFrame([("0", k, [float(c)] * 1, [float(c) + 0.1]) for k, c in enumerate([-0.7, -0.65, 0.6, 0.7])], "grp string, nth long, lo array<double>, hi array<double>")
    pairs = {(r.a, r.b) for r in grid_join._near_pairs(boxes, 1, 0.37).collect()}
    assert pairs == {(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)}
    assert len(x) == 80


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 16)
    rows = some_vectors(4)
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).collect()
    keep = [r for r in rows if usable(r[1])]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in keep]
    found, total, by = 0, 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i, r in enumerate(keep) if r[0] is not None and r[0] % 5 == 0]
    lengths = [len(r[1]) for r in keep]
    assert set(by) == {keep[i][0] for i in asked if lengths.count(lengths[i]) > 1}
    for i in asked:
        score = [u @ unit[i] if len(u) == len(unit[i]) else -2 for u in unit]
        order = sorted((j for j in range(len(keep)) if j != i and score[j] > -2), key=lambda j: (-score[j], keep[j][0] is None, keep[j][0] or 0))[:5]
        mine = sorted(by.get(keep[i][0], []))
        assert [m[0] for m in mine] == list(range(1, len(order) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(mine, mine[1:]))
        found += sum(np.isclose(a[2], score[j]) for a, j in zip(mine, order))
        total += len(order)
    assert found / total >= 0.95


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(5)
    x = ann.scale(rng.standard_normal((500, 64)))
    q = ann.scale(rng.standard_normal((40, 64)))
    centre = x.mean(axis=0)
    words, scalars = ann.encode(x, centre)
    guess, wide = ann.estimate(q, centre, words, scalars, 3.0)
    off = np.abs(guess - q @ x.T)
    assert (off <= wide).mean() > 0.995 and abs((guess - q @ x.T).mean()) < 0.01
    turned = ann.rotate(rng.standard_normal((5, 70)))
    assert words.shape == (500, 1) and turned.shape == (5, 128)
    eye = ann.rotate(np.eye(70))
    assert np.allclose(eye @ eye.T, np.eye(70))


def test_rings_that_hold_nothing_near_are_not_asked(spark, monkeypatch):
    """Tight clusters: a query goes to few blocks, and still finds all that brute force finds."""
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(8)
    x = np.repeat(rng.standard_normal((20, 16)), 60, axis=0) + rng.standard_normal((1200, 16)) * 0.05
    rows = [(i, x[i].tolist(), 0, 0, "c") for i in range(1200)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    unit = ann.scale(x.astype(np.float32).astype(float))
    for q in range(0, 1200, 50):
        score = unit @ unit[q]
        score[q] = -2
        want = np.sort(score)[::-1][:5]
        assert np.allclose([r.score for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])], want)


def test_few_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert grid_join.join_similar(empty).count() == 0 and ann.search(empty, F.lit(True)).count() == 0
    only_bad = spark.createDataFrame([r for r in some_vectors() if r[0] in (900, 901, 902)], SCHEMA)
    assert {(r.n_links, r.vec_id == r.component_id) for r in grid_join.join_similar(only_bad).collect()} == {(0, True)}
    assert ann.search(only_bad, F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0], 1, 0, "c"), (2, [1.0, 0.0], 1, 0, "c"), (3, [0.0, 1.0], None, 0, "c")], SCHEMA)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(two, F.col("vec_id") == 2).collect()) == [(2, 1, 1), (2, 2, 3)]
