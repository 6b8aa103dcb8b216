"""Sinks."""

from __future__ import annotations

import html
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import css_name


def write_csv(df: DataFrame, path: str, columns: list[str], quote_all: bool = False, mode: str = "errorifexists") -> None:
    """``columns`` in their order (missing ones empty), then all others by name."""
    extra = sorted(c for c in df.columns if c not in columns)
    rows = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns), *extra)
    rows.write.mode(mode).option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_texts(df: DataFrame, path: str, key: str, text: str, mode: str = "errorifexists") -> None:
    """A folder of text files for each key."""
    df.select(F.col(key), F.col(text).alias("value")).write.mode(mode).partitionBy(key).text(path)


def write_partitioned(graph: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A triple table in Parquet by predicate, so that a query's scan prunes to its predicates."""
    graph.withColumn("predicate", css_name(F.regexp_extract("p", "([^/#]+)$", 1))).repartition("predicate", F.pmod(F.xxhash64("s"), F.lit(64))).write.mode(mode).partitionBy("predicate").parquet(path)


def shapes_turtle(shapes: DataFrame) -> str:
    """The property shapes of (domain, property, ranges joined by '; ') as text, for a small ontology."""
    lines = ["@prefix sh: <http://www.w3.org/ns/shacl#> ."]
    for r in shapes.orderBy("domain", "property").collect():
        options = " ".join(f"[ sh:class <{x}> ]" for x in r["ranges"].split("; "))
        lines.append(f"[] a sh:NodeShape ; sh:targetClass <{r['domain']}> ; sh:property [ sh:path <{r['property']}> ; sh:or ( {options} ) ] .")
    return "\n".join(lines) + "\n"


def light_ontology(signatures: DataFrame) -> str:
    """Short text of an ontology for prompts: classes, then properties with their domains and ranges, by local names."""
    name = lambda s: s.rstrip("/").replace("#", "/").rpartition("/")[2] if s else "?"
    rows = signatures.distinct().collect()
    classes = sorted({name(x) for r in rows for x in (r["domain"], r["range"]) if x})
    properties: dict[str, list[str]] = {}
    for r in rows:
        properties.setdefault(name(r["property"]), []).append(f"{name(r['domain'])} -> {name(r['range'])}")
    return "".join(f"class {c}\n" for c in classes) + "".join(f"property {p}: {', '.join(sorted(set(v)))}\n" for p, v in sorted(properties.items()))


def ontology_turtle(constraints: DataFrame, by_domain: DataFrame, one_of: bool = False) -> str:
    """An extension as Turtle: properties with (united) domains and ranges, and a restriction for each domain where a property has several of both."""
    out = ["@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> ."]

    def united(names: list[str]) -> str:
        return f"<{names[0]}>" if len(names) == 1 else f"[ a owl:Class ; owl:unionOf ( {' '.join(f'<{n}>' for n in names)} ) ]"

    scoped = {}
    for r in by_domain.orderBy("property", "domain").collect():
        scoped.setdefault(r["property"], []).append((r["domain"], r["ranges"].split("; ")))
    for r in constraints.orderBy("property").collect():
        level = f'"{r["confidence"]:.4f}"^^xsd:decimal'
        note = f"rdfs:comment [ owl:oneOf ( {level} ) ]" if one_of else f"rdfs:comment {level}"
        out.append(f"<{r['property']}> a owl:ObjectProperty ; rdfs:domain {united(r['domains'])} ; rdfs:range {united(r['ranges'])} ; {note} .")
        if r["scoped"]:
            out += [f"<{d}> rdfs:subClassOf [ a owl:Restriction ; owl:onProperty <{r['property']}> ; owl:allValuesFrom {united(x)} ] ." for d, x in scoped[r["property"]]]
    return "\n".join(out) + "\n"


def mention_html(text: str, segments: list[tuple[int, int, str]], kind: Callable[[str], str] = lambda _: "mention") -> str:
    """A document with marked mentions; segments: start, end, and the ids active there joined by commas."""
    out = []
    for start, end, active in sorted(segments):
        part = html.escape(text[start:end])
        for name in reversed([x for x in active.split(",") if x]):
            part = f'<mark class="{html.escape(kind(name))}" data-id="{html.escape(name)}">{part}</mark>'
        out.append(part)
    return "".join(out)


def mention_pages(docs: DataFrame, segments: DataFrame, key: str, text: str, labels: DataFrame | None = None) -> DataFrame:
    """``key`` and ``html`` of each document: its text with marked mentions. ``segments``: key, start, end, active (ids joined by commas); ``labels``: key, id, label, for the marks' classes."""
    packed = segments.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "active"))).alias("_segments"))
    rows = docs.select(key, F.coalesce(text, F.lit("")).alias("_text")).join(packed, F.col(key) == F.col("_k"), "left").drop("_k")
    if labels is not None:
        named = labels.groupBy(F.col(key).alias("_k")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("id").cast("string"), css_name(F.col("label")))))).alias("_labels"))
        rows = rows.join(named, F.col(key) == F.col("_k"), "left").drop("_k")
    else:
        rows = rows.withColumn("_labels", F.lit(None).cast("map<string,string>"))

    @F.pandas_udf("string")
    def page(texts: pd.Series, parts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for text, part, kind in zip(texts, parts, kinds):
            names = dict(kind) if kind is not None else {}
            marks = [(x["start"], x["end"], x["active"]) for x in part] if part is not None else [(0, len(text), "")]
            out.append(mention_html(text, marks, lambda i: f"mention {names[i]}" if i in names else "mention"))  # noqa: B023
        return pd.Series(out, dtype=object)

    return rows.select(key, page("_text", "_segments", "_labels").alias("html"))


def manifest(**parts) -> str:
    return json.dumps(parts, ensure_ascii=False, indent=2, sort_keys=True)
