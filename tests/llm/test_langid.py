import random
import zlib

import numpy as np

from lexloom.llm.langid import ByteConvNet, cut_windows, is_held_out, predict, read_windows, train
from pyspark.sql import functions as F

WORDS = {"en": "the of and tion ing that with was her rest".split(), "de": "der die und ung keit schließlich über ein zu nicht".split(), "fr": "le la les été que est aux ment où une".split()}


def corpus(n=600):
    r = random.Random(3)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([2, 30, 200]))), lang, "src", "x"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string"


def test_held_out_accuracy_and_contract(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    net = train(docs, per_label=150)
    got = {r.doc_id: r for r in predict(docs, net).withColumn("held", is_held_out(F.col("doc_id"))).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held == (i in set(held)) for i in got)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_and_labels_of_others_are_not_used(spark):
    rows = corpus(200)
    spoiled = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, p) for i, t, lang, s, p in rows]
    one, two = (train(spark.createDataFrame(x, SCHEMA), per_label=60) for x in (rows, spoiled))
    assert one.labels == two.labels and np.array_equal(one.conv, two.conv)


def test_edge_cases(spark):
    net = ByteConvNet(["a", "b"], 32)
    texts = [None, "", " 123 !", "é", "x" * 500_000, "a b", "a b"]
    docs = spark.createDataFrame([(min(i, 5), t, None, None, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = predict(docs, net).collect()
    assert len(got) == len(texts)
    by = {(r.doc_id): r for r in got}
    assert [by[i].lang_pred for i in range(3)] == ["und"] * 3 and all(by[i].score == 0 for i in range(3))
    assert by[3].lang_pred in "ab" and by[4].lang_pred in "ab"
    assert train(docs) is None
    assert {r.lang_pred for r in predict(docs, None).collect()} == {"und"}
    assert predict(docs.limit(0), net).count() == 0
    kept = predict(docs, net, keep=("lang_pred",), out=("p", "s"))
    assert kept.columns == ["doc_id", "lang_pred", "p", "s"] and kept.first().lang_pred == "clash"


def test_windows_cover_every_patch():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, ends = np.array([0, 10, 10, 300]), np.array([10, 10, 300, 5000])
    row, a, b = cut_windows(raw, starts, ends, 64)
    for i in range(4):
        seen = {raw[p : p + 4].tobytes() + bytes([p % 251]) for x, y in zip(a[row == i], b[row == i]) for p in range(x, max(x + 1, y - 3))}
        want = {raw[p : p + 4].tobytes() + bytes([p % 251]) for p in range(starts[i], max(starts[i] + 1, ends[i] - 3))} if ends[i] > starts[i] else set()
        assert seen == want
    w = read_windows(raw, a, b, 64)
    assert (w[:, 0] == raw[a]).all() and ((w == 256).sum(axis=1) == 64 - (b - a)).all()


def test_gradient():
    """The loss falls along the negative gradient: one small step on one batch."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (32, 16)).astype(np.int16), rng.integers(0, 2, 32)
    net = ByteConvNet(["a", "b"], 16)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(32), y]).mean()
    before = loss()
    net.fit(x, y, epochs=8, rate=0.01, batch=32)
    assert loss() < before


def test_a_batch_is_judged_and_given_back_in_parts(spark):
    """Texts come back as they were, null and empty ones too, and judgements don't depend on where a batch is cut."""
    net = train(spark.createDataFrame(corpus(), SCHEMA), per_label=60)
    rows = [(i, None if i % 7 == 3 else "" if i % 7 == 5 else t, lang, s, p) for i, t, lang, s, p in corpus(1300)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = predict(docs, net, keep=("source", "text"), out=("p", "q"))
    assert got.columns == ["doc_id", "source", "text", "p", "q"]
    got = got.withColumn("part", F.spark_partition_id()).collect()
    assert [(r.doc_id, r.text) for r in got] == [x[:2] for x in rows] and {r.part for r in got} == {0}
    few = {r.doc_id: r for r in predict(docs.repartition(40), net).collect()}
    assert all(r.p == few[r.doc_id].lang_pred and abs(r.q - few[r.doc_id].score) < 1e-6 for r in got)
