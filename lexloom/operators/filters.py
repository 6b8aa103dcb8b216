"""Filters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reshape import class_hints

# fixed values: texts of the boilerplate filter
HEADERS = ("arrête:", "arrêtent:")
PUBLISHED = r"(?iusdU)\barrêté\b.*?\b(?:publié|publication)\s+au\s+Journal officiel de la République française\b"
IN_FORCE = r"(?iudU)présent arrêté (entr.+)? en vigueur le\s+(\d{1,2}(?:er)?\s+\w+\s+\d{4})"
SHORT = 60


def by_topic(c: Column, wanted: str | list[str] | None) -> Column:
    """None and ``all`` keep everything, a list its members, a text what it matches as a regex in any case."""
    if wanted is None or wanted == "all":
        return F.lit(True)
    return c.isin(list(wanted)) if isinstance(wanted, (list, tuple)) else F.coalesce(c.rlike(f"(?i){wanted}"), F.lit(False))


def is_error(columns: list[str], valid: str | None = None) -> Column:
    """Whether a cell starts with ``ERROR:``, or the validity flag isn't true."""
    flags = [F.startswith(F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit("ERROR:")) for c in columns]
    if valid:
        flags.append(F.lower(F.trim(F.coalesce(F.col(valid).cast("string"), F.lit("")))) != "true")
    return reduce(or_, flags)


def split_errors(df: DataFrame, columns: list[str], valid: str | None = None) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("_bad", is_error(columns, valid))
    return marked.where("NOT _bad").drop("_bad"), marked.where("_bad").drop("_bad")


def tail_mismatch(relation: Column, tail_type: Column, classes: list[str]) -> Column:
    """Whether the relation's name holds class names, and none of them is the tail's type."""
    hints = class_hints(relation, classes)
    return (F.size(hints) > 0) & ~F.exists(hints, lambda c: F.lower(c) == F.lower(F.coalesce(tail_type, F.lit(""))))


def boilerplate(c: Column) -> Column:
    """Whether a text is a bare header, or says where a decree is published, or (in under SHORT characters) when it enters into force. Null isn't."""
    text = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(text.isin(*HEADERS) | c.rlike(PUBLISHED) | (c.rlike(IN_FORCE) & (F.length(c) < SHORT)), F.lit(False))


def has_content(c: Column, placeholder: str | None = None) -> Column:
    out = c.isNotNull() & (F.trim(c) != "")
    return out & ~F.contains(c, F.lit(placeholder)) if placeholder else out


def confident(c: Column, least: float) -> Column:
    return F.coalesce(c.try_cast("double") > least, F.lit(False))


def supported(df: DataFrame, predicate: str, support: str, least: int, least_predicate: int) -> DataFrame:
    """Signatures with enough support, of predicates with enough in all."""
    total = F.sum(support).over(Window.partitionBy(predicate))
    return df.withColumn("predicate_support_count", total).where((F.col(support) >= least) & (F.col("predicate_support_count") >= least_predicate))


def subject_hits(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(0)))


def search(columns: list[str], needle: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))


def clusterable(label: Column, kind: Column, excluded: tuple[str, ...] = ("Reference",)) -> Column:
    """Labels without digits, of a type that isn't excluded."""
    return (F.trim(label) != "") & ~label.rlike(r"\d") & kind.isNotNull() & ~kind.isin(*excluded)


def one_by_key(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """The union, the first row of each key, where tables come in order and rows by ``order``."""
    union = reduce(DataFrame.unionByName, (t.withColumn("_t", F.lit(i)) for i, t in enumerate(tables)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_t", order))
    return union.withColumn("_n", nth).where("_n = 1").drop("_n", "_t")
