import random
import subprocess
import sys
import zlib
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import langid, minhash, mixing, secrets

from .test_minhash import brute

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit(" 12 ")))
    docs = docs.unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10_000))
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, docs, SF))
        assert name == "packing" or out.columns == columns
        seen[name] = docs, out
        docs = out
    before, after = seen["language_id"]
    lettered = {r.doc_id for r in before.collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in after.collect()} == lettered
    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in brute(rows)})
    before, after = seen["secret_scan"]
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(before).collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: r.text for r in after.collect() if not spans[r.doc_id]} == {i: t for i, t in texts.items() if not spans[i]}
    assert not any(r.spans for r in secrets.find_secrets(after).collect())
    before, after = seen["mixing"]
    want = {r.doc_id: r.taken for r in mixing.mix_sources(before).collect() if r.taken}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == want
    before, after = seen["packing"]
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert after.where("piece = 0").count() == before.count()


def test_odd_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None)], schema).withColumns({"_key": F.lit(1), "spans": F.lit("s"), "score": F.lit(0.5)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() <= 3, name
    packed = corpus_pipeline.pack_sequences(spark, odd, SF).collect()
    assert sorted((r.doc_id is None, r.piece, r.start) for r in packed) == [(False, 0, 0), (False, 0, 0), (True, 0, 0)]
    assert len({(r.sequence_id, r.offset) for r in packed}) == 3 and [r.length for r in packed if r.doc_id is None] == [1]


def test_very_long_texts_go_through_every_stage(spark):
    """Two near copies and another, of some hundred thousand words, with many secrets."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    long_ = [r.choice(words) for _ in range(120_000)]
    near = [*long_[:60_000], "edited", *long_[60_000:]]
    other = [r.choice(words) if k % 20 else f"password={'q' * 12}{k:06d}" for k in range(60_000)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, " ".join(long_), "en", "a", 0), (2, " ".join(near), "en", "a", 0), (3, " ".join(other), "de", "b", 0)]
    docs = spark.createDataFrame([(d, t, lang, s, len(t)) for d, t, lang, s, _ in rows], schema)
    out = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stash(stage(spark, out, SF))
        kept[name] = out
    assert sorted(x.doc_id for x in kept["near_dedup"].collect()) == [1, 3]
    hidden = next(x.text for x in kept["secret_scan"].collect() if x.doc_id == 3)
    assert hidden.count("[secret]") == 3000 and "qqqq" not in hidden and len(hidden.split(" ")) == 60_000
    pieces = kept["packing"].orderBy("doc_id", "piece").collect()
    assert {x.doc_id for x in pieces} <= {1, 3} and all(x.length <= 2048 for x in pieces)


def test_the_library_stands_without_this_subpackage():
    code = "import sys; sys.modules['lexloom.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_learned_network_is_the_same_on_a_rerun(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (langid.train(docs, per_label=30) for _ in range(2))
    assert (a.conv == b.conv).all() and minhash.REGISTERS % minhash.ROWS == 0


def test_without_labels_documents_keep_their_language(spark):
    rows = [(1, "some text", None), (2, "é", None), (3, None, None), (4, " 12 !", None), (5, "", None), (1, "some text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.identify_language(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.lang) for r in got.collect()) == [(1, "some text", None), (1, "some text", None), (2, "é", None)]
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "some text", "en") for i in held], "doc_id long, text string, lang string")
    assert [r.lang for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == ["en"] * len(held)


def test_a_text_goes_to_a_language_worker_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    node = corpus_pipeline.identify_language(spark, docs, SF)._jdf.queryExecution().analyzed()
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert node.child().output().size() == len(docs.columns) - 1  # all but lang, which isn't an input
