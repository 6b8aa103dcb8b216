"""Scans of CSV, JSON and graph files. Files are opened by Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ontology import candidates
from ..schema import CANDIDATE


def _head(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("﻿") if first else ""


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """``;`` if the first line has more of them than commas."""
    line = _head(spark, path)
    return ";" if line.count(";") > line.count(",") else ","


#: The characters that windows-1252 has where ISO 8859-1 has control codes.
_C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}


def _from_c1(c):
    own = {k: v for k, v in _C1.items() if v}
    return F.translate(c, "".join(own), "".join(own.values()))


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str | None = ",", schema=None, most: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A header, quoted line breaks, doubled quotes; all strings without ``schema``. ``delimiter`` None: by the first line. ``most``: row cap.

    A byte order mark and quotes around names are removed from the header. Empty cells are null.
    """
    one = path if isinstance(path, str) else path[0]
    western = encoding.lower() in ("windows-1252", "cp1252")  # which Spark's readers don't know by name
    encoding = "ISO-8859-1" if western else encoding
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("sep", delimiter or sniff_delimiter(spark, one))
    rows = (reader.schema(schema) if schema is not None else reader).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip().strip('"') for c in rows.columns))
    if western:
        rows = rows.select(*((_from_c1(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(c) for c, t in rows.dtypes))
    return rows.limit(most) if most is not None else rows


def read_csv_any_encoding(spark: SparkSession, path: str, delimiter: str | None = None, encodings: tuple[str, ...] = ("UTF-8", "windows-1252")) -> DataFrame:
    """The first encoding that leaves no replacement character."""
    rows = None
    for encoding in encodings:
        rows = read_csv(spark, path, delimiter, encoding=encoding)
        text = F.concat_ws(" ", *(F.col(f"`{c}`") for c in rows.columns))
        if not any("�" in c for c in rows.columns) and not rows.where(F.contains(text, F.lit("�"))).limit(1).count():
            break
    return rows


def read_json(spark: SparkSession, path: str | list[str], lines: bool = True, schema=None) -> DataFrame:
    """JSON lines, or with ``lines`` False one array or object a file."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """By extension: ``.csv``, ``.jsonl``, or a JSON array."""
    name = path.lower()
    return read_csv(spark, path, None) if name.endswith(".csv") else read_json(spark, path, lines=name.endswith((".jsonl", ".ndjson")))


def read_candidates(spark: SparkSession, path: str, least: float) -> DataFrame:
    """Candidate relations of a model file with a confidence over ``least``, aggregated."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("candidates_object_props", T.ArrayType(CANDIDATE))])
    rows = read_json(spark, path, lines=False, schema=schema).select(F.posexplode("candidates_object_props").alias("place", "c")).select("place", "c.*")
    return candidates(rows, least)


def graph_paths(spark: SparkSession, files: list[str] = (), folders: list[str] = (), globs: list[str] = (), suffix: str = ".ttl") -> list[str]:
    """All graph files that are named, in folders, or match globs; sorted, each once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = set(files)
    for pattern in [*(f"{d.rstrip('/')}/*{suffix}" for d in folders), *globs]:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found |= {s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or []}
    return sorted(found)


def term_lookup(spark: SparkSession, mapping: str) -> DataFrame:
    """``name``, ``iri`` of the IRIs that a mapping's text states as constants."""
    found = sorted({m for m in re.findall(r"<(https?://[^<>\s]+)>", mapping)})
    return spark.createDataFrame([(re.split(r"[/#]", i)[-1], i) for i in found], "name string, iri string")


def embedded_selectors(graph: DataFrame) -> DataFrame:
    """``mention``, ``role``, ``statement``, ``article``, ``start``, ``end`` of the text selectors of a graph."""
    from ..plans.names import OA

    link = lambda p, a, b: graph.where(F.col("p") == OA + p).select(F.col("s").alias(a), F.col("o").alias(b))
    rows = link("hasTarget", "mention", "t").join(link("hasSource", "t", "article"), "t").join(link("hasSelector", "t", "x"), "t").join(link("start", "x", "start"), "x").join(link("end", "x", "end"), "x")
    return rows.select(
        "mention", F.regexp_extract("mention", "/mention/(head|tail)$", 1).alias("role"), F.regexp_replace("mention", "/mention/(head|tail)$", "").alias("statement"),
        "article", F.expr("try_cast(start as int)").alias("start"), F.expr("try_cast(end as int)").alias("end"),
    )


def read_batch_outputs(spark: SparkSession, path: str) -> DataFrame:
    """``custom_id``, ``output`` of a provider's batch file (JSON lines)."""
    return read_json(spark, path, schema="custom_id string, output string")


def as_json(df: DataFrame) -> list[dict]:
    """The rows of a small table as objects, for a report."""
    return [json.loads(x) for x in df.toJSON().collect()]
