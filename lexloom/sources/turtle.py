"""Turtle and N-Triples: a tokenizer for the subset in use, a reader to a triple table, and writers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_literal
from ..plans.names import RDF, XSD
from ..schema import GRAPH

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
  | <(?P<iri>[^<>"{}|^`\\\s]*)>
  | (?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
  | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<type>\^\^)
  | (?P<bnode>_:[A-Za-z0-9_](?:[\w.-]*[\w-])?)
  | (?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))
  | (?P<name>[A-Za-z_][\w.-]*(?<!\.)?:(?:[\w%-](?:[\w.:%-]*[\w:%-])?)?|:(?:[\w%-](?:[\w.:%-]*[\w:%-])?)?|[A-Za-z]+)
  | (?P<mark>[.;,()\[\]])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not Turtle at {at}: {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[m.lastgroup]


class _Reader:
    """Recursive descent over the tokens of one file; blank nodes get the file's name as a scope."""

    def __init__(self, text: str, scope: str):
        self.tokens, self.scope = [*_tokens(text)], scope
        self.at, self.fresh, self.prefixes, self.base = 0, 0, {}, ""
        self.out: list[tuple] = []

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def see(self, *marks: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in marks and self.tokens[self.at][0] in ("mark", "name", "lang")

    def need(self, mark: str) -> None:
        kind, value = self.next()
        if value != mark:
            raise ValueError(f"{mark!r} expected, {value!r} found")

    def blank(self) -> tuple:
        self.fresh += 1
        return (f"{self.scope}g{self.fresh}", "bnode", None, None)

    def expand(self, name: str) -> str:
        prefix, _, rest = name.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + rest

    def resolve(self, iri: str) -> str:
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri

    def read(self) -> list[tuple]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if value.lower() in ("@prefix", "prefix"):
                self.at += 1
                name = self.next()[1]
                self.prefixes[name.rstrip(":")] = self.resolve(self.next()[1])
                if value[0] == "@":
                    self.need(".")
            elif value.lower() in ("@base", "base"):
                self.at += 1
                self.base = self.next()[1]
                if value[0] == "@":
                    self.need(".")
            else:
                bare = self.see("[")
                subject = self.term()
                if not (bare and self.see(".")):
                    self.pairs(subject)
                self.need(".")
        return self.out

    def pairs(self, subject: tuple) -> None:
        while True:
            while self.see(";"):
                self.at += 1
            if self.see(".", "]") or self.at >= len(self.tokens):
                return
            predicate = RDF + "type" if self.see("a") and self.next() else self.term()[0]
            while True:
                self.emit(subject, predicate, self.term())
                if not self.see(","):
                    break
                self.at += 1
            if not self.see(";"):
                return

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.append((s[0], s[1], p, *o))

    def term(self) -> tuple:
        kind, value = self.next()
        if kind == "iri":
            return (self.resolve(_unescape(value)), "iri", None, None)
        if kind == "bnode":
            return (f"{self.scope}{value[2:]}", "bnode", None, None)
        if kind in ("text", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                return (text, "literal", None, self.next()[1][1:])
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "type":
                self.at += 1
                return (text, "literal", self.term()[0], None)
            return (text, "literal", None, None)
        if kind == "number":
            return (value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if kind == "name":
            if value in ("true", "false"):
                return (value, "literal", XSD + "boolean", None)
            return (self.expand(value), "iri", None, None)
        if value == "[":
            node = self.blank()
            self.pairs(node)
            self.need("]")
            return node
        if value == "(":
            items = []
            while not self.see(")"):
                items.append(self.term())
            self.at += 1
            cells = [self.blank() for _ in items]
            for i, (cell, item) in enumerate(zip(cells, items)):
                self.emit(cell, RDF + "first", item)
                self.emit(cell, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else (RDF + "nil", "iri", None, None))
            return cells[0] if cells else (RDF + "nil", "iri", None, None)
        raise ValueError(f"a term expected, {value!r} found")


def parse_turtle(text: str, scope: str = "") -> list[tuple]:
    """Triples (s, s_kind, p, o, o_kind, o_datatype, o_lang) of a Turtle or N-Triples text."""
    return _Reader(text.lstrip("﻿"), scope).read()


def read_turtle(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The union of the files' graphs. A file is parsed in one task, files in parallel; prefixes and blank nodes are a file's own."""
    files = spark.read.text(paths, wholetext=True).select(F.substring(F.md5(F.input_file_name()), 1, 8).alias("scope"), "value")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for scope, text in zip(part["scope"], part["value"]):
                yield pd.DataFrame(parse_turtle(text, f"b{scope}"), columns=GRAPH.fieldNames(), dtype=object)

    return files.mapInPandas(run, GRAPH).distinct()


def read_ntriples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Line by line, without Python: for graphs of any size."""
    line = F.trim("value")
    term = r'(?:<([^>]*)>|_:(\S+))'
    pattern = rf'^{term}\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.$'
    g = lambda i: F.regexp_extract(line, pattern, i)
    text = g(6)
    # a backslash first becomes a mark that no text has, so that its successors aren't read again
    for code, plain in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    rows = spark.read.text(paths).where(line.rlike(pattern))
    return rows.select(
        F.when(g(1) != "", g(1)).otherwise(g(2)).alias("s"), F.when(g(1) != "", "iri").otherwise("bnode").alias("s_kind"), g(3).alias("p"),
        F.when(g(4) != "", g(4)).when(g(5) != "", g(5)).otherwise(text).alias("o"), F.when(g(4) != "", "iri").when(g(5) != "", "bnode").otherwise("literal").alias("o_kind"),
        F.nullif(g(7), F.lit("")).alias("o_datatype"), F.nullif(g(8), F.lit("")).alias("o_lang"),
    ).distinct()


def ntriples(graph: DataFrame) -> DataFrame:
    """One column ``value``, a line for each triple."""
    node = lambda c, kind: F.when(kind == "bnode", F.concat(F.lit("_:"), c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), tail)).otherwise(node(F.col("o"), F.col("o_kind")))
    return graph.select(F.concat(node(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


def turtle(graph: DataFrame) -> DataFrame:
    """One column ``value``, a block for each subject, its triples in order. Names are written in full, so blocks need no header."""
    lines = ntriples(graph).select(F.regexp_extract("value", r"^(\S+) ", 1).alias("s"), F.regexp_extract("value", r"(?s)^\S+ (.*) \.$", 1).alias("po"))
    return lines.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("po")), " ;\n    ").alias("po")).select(F.concat("s", F.lit(" "), "po", F.lit(" .")).alias("value"))


def jsonld(graph: DataFrame) -> DataFrame:
    """One column ``value``: an expanded JSON-LD object for each subject, a line each."""
    node = lambda c, kind: F.when(kind == "bnode", F.concat(F.lit("_:"), c)).otherwise(c)
    literal = F.to_json(F.struct(F.col("o").alias("@value"), F.col("o_datatype").alias("@type"), F.col("o_lang").alias("@language")))  # nulls are left out
    value = F.when(F.col("o_kind") == "literal", literal).otherwise(F.to_json(F.struct(node(F.col("o"), F.col("o_kind")).alias("@id"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    by_property = graph.groupBy(node(F.col("s"), F.col("s_kind")).alias("s"), "p").agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("v"))
    part = F.concat(quoted(F.col("p")), F.lit(":["), "v", F.lit("]"))
    parts = by_property.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(part)), ",").alias("v"))
    return parts.select(F.concat(F.lit('{"@id":'), quoted(F.col("s")), F.lit(","), "v", F.lit("}")).alias("value"))


def rdf_xml(graph: DataFrame) -> DataFrame:
    """One column ``value``: an RDF/XML document in each partition that has rows, an element for each subject."""

    def escaped(c):
        for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(code))
        return c

    space, name = F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w.-]*)$", 1), F.regexp_extract("p", r"^(.*?)([A-Za-z_][\w.-]*)$", 2)
    start = F.concat(F.lit("<x:"), name, F.lit(' xmlns:x="'), escaped(space), F.lit('"'))
    about = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit(' rdf:datatype="'), escaped(F.col("o_datatype")), F.lit('"'))).otherwise("")
    literal = F.concat(start, about, F.lit(">"), escaped(F.col("o")), F.lit("</x:"), name, F.lit(">"))
    link = F.concat(start, F.when(F.col("o_kind") == "bnode", F.lit(' rdf:nodeID="')).otherwise(F.lit(' rdf:resource="')), escaped(F.col("o")), F.lit('"/>'))
    element = F.when(F.col("o_kind") == "literal", literal).otherwise(link)
    grouped = graph.groupBy("s", "s_kind").agg(F.array_join(F.sort_array(F.collect_list(element)), "").alias("e"))
    key = F.when(F.col("s_kind") == "bnode", F.lit("rdf:nodeID")).otherwise(F.lit("rdf:about"))
    rows = grouped.select(F.concat(F.lit("<rdf:Description "), key, F.lit('="'), escaped(F.col("s")), F.lit('">'), "e", F.lit("</rdf:Description>")).alias("value"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><rdf:RDF xmlns:rdf="{RDF}">'

    def wrap(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for part in parts:
            if len(part) and not begun:
                begun = True
                yield pd.DataFrame({"value": [head]})
            yield part
        if begun:
            yield pd.DataFrame({"value": ["</rdf:RDF>"]})

    return rows.mapInPandas(wrap, "value string")


def write_graph(graph: DataFrame, path: str, form: str = "nt", mode: str = "errorifexists") -> None:
    """``nt``, ``turtle``, ``json-ld`` (an object a line) or ``xml`` (a document a file), in as many files as the graph has partitions; ``append`` adds a layer to a graph."""
    {"nt": ntriples, "turtle": turtle, "json-ld": jsonld, "xml": rdf_xml}[form](graph).write.mode(mode).text(path)
