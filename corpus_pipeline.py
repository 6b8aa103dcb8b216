"""The corpus pipeline: language ID, near-dedup, secret scan, mixing, packing; each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import langid, minhash, mixing, packing, secrets
from lexloom.llm.common import stash, table, unstash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text, or no letter); ``lang`` becomes what the text is judged to be.

    If no row can be learned from (none with a text and a label that isn't held out), the same documents are dropped, and
    the others keep their ``lang`` as it is.
    """
    net = langid.train(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = tuple(c for c in docs.columns if c not in ("doc_id", "lang"))
    judged = langid.predict(docs, net, keep=others, out=("_judged", "_judged_score"))
    return judged.where("_judged != 'und'").withColumn("lang", F.col("_judged")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, the one of least id; rows of that id whose texts differ from it are in classes of their own."""
    return minhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; texts without one stay as they are. All documents are kept."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks: whole copies, and at a source's cut the first words of one."""
    return mixing.apply_mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2,048; a row for each piece. Null and empty texts are one token; equal rows are packed one by one."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: SQL can express neither a trained network nor signatures; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table is deleted once the next one's is written, and the last one's stays."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stash(stage(spark, docs, sf_dir))
        if k:
            unstash(docs)
        docs = made
    return docs
