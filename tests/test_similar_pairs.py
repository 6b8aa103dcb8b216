"""Similar pairs by tiles of blocks against all pairs in plain Python."""

import math

from lexloom.operators import joins


def test_tiles_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 7)
    rows = [(i, "a" if i % 3 else "b", [math.sin(i * k + k) for k in range(1, 6)]) for i in range(60)]
    rows += [(100, "a", [0.0] * 5), (101, "a", None), (102, "a", [1.0, None, 0.0, 0.0, 0.0]), (103, None, [1.0] * 5), (104, "a", [1.0, 2.0]), (105, "a", [2.0, 4.0]), (106, "b", [math.nan, 0.0, 0.0, 0.0, 0.0]), (107, "a", rows[1][2]), (108, "a", [])]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    usable = [r for r in rows if r[1] and r[2] is not None and None not in r[2]]

    def cos(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(a, b) / ((math.sqrt(dot(a, a)) or 1.0) * (math.sqrt(dot(b, b)) or 1.0))

    want = {(a[1], a[0], b[0]): cos(a[2], b[2]) for a in usable for b in usable if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and not cos(a[2], b[2]) < 0.3}
    found = joins.similar_pairs(df, "g", "k", "v", 0.3)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()  # blocks, not a row for each pair
    got = found.collect()
    assert len(got) == len(want)
    for r in got:
        x = want[r.g, r.left_id, r.right_id]
        assert r.similarity == x or abs(r.similarity - x) < 1e-12 or math.isnan(x) and math.isnan(r.similarity)
