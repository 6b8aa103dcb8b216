"""Counts and tables for analysis and viewing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import search


def counters(triples: DataFrame, extra: list[str]) -> DataFrame:
    """Entity rows of both roles: ``entity``, ``class``, ``as_subject``, ``as_object``, ``predicate``."""
    row = lambda r, o: F.struct(F.col(r).alias("entity"), F.col(f"{r}_type").alias("class"), F.lit(1 - o).alias("as_subject"), F.lit(o).alias("as_object"), F.col("relation").alias("predicate"))
    return triples.select(*extra, F.explode(F.array(row("head", 0), row("tail", 1))).alias("e")).select(*extra, "e.*")


def entities_by_article(triples: DataFrame) -> DataFrame:
    """Counts by role, the sorted predicates, and ``predicate:n`` for each (article, entity)."""
    keys = ["article", "entity", "class"]
    per = counters(triples, ["article"]).groupBy(*keys, "predicate").agg(F.sum("as_subject").alias("s"), F.sum("as_object").alias("o"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.sum("s").alias("subject_count"), F.sum("o").alias("object_count"), F.sum("n").alias("total_count"),
        F.array_join(F.sort_array(F.collect_set("predicate")), "; ").alias("predicates"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "predicate", "n"))), "; ").alias("predicate_counts"),
    )


def entities_by_class(triples: DataFrame) -> DataFrame:
    per = counters(triples, ["article"]).groupBy("class", "entity").agg(
        F.sum("as_subject").alias("subject_count"), F.sum("as_object").alias("object_count"), F.count(F.lit(1)).alias("total_count"), F.count_distinct("article").alias("articles")
    )
    return per.orderBy("class", F.desc("total_count"), "entity")


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column).limit(n)


def first_values(c: str, n: int, joint: str = "; ") -> Column:
    return F.array_join(F.slice(F.sort_array(F.collect_set(c)), 1, n), joint)


def dashboard(triples: DataFrame, key: str, values: list[str], n: int = 8, needle: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows and the first sorted distinct values of some columns for each key, of the rows that contain ``needle``."""
    rows = triples.where(search(columns or values, needle)) if needle else triples
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(first_values(v, n).alias(v) for v in values))


def edges(triples: DataFrame, n: int = 35) -> DataFrame:
    """The first edges in order, for a drawing."""
    return triples.select("head", "relation", "tail", "article").orderBy("article", "head", "relation", "tail").limit(n)


def dot_text(rows: list) -> str:
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "digraph {\n" + "".join(f"  {quote(r[0])} -> {quote(r[2])} [label={quote(r[1])}];\n" for r in rows) + "}\n"


def token_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of columns as numbers; what isn't one counts 0."""
    number = lambda c: F.col(c).try_cast("double")
    return df.agg(*(F.coalesce(F.sum(F.when(~F.isnan(number(c)), number(c)).otherwise(0.0)), F.lit(0.0)).cast("long").alias(c) for c in columns))


def focused(subjects: DataFrame, statements: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Articles whose subject matches, a row for each such subject, and the statements of those articles, each once."""
    hits = F.size(F.regexp_extract_all("subject", F.lit(f"(?i){pattern}"), F.lit(0)))
    found = subjects.withColumn("hits", hits).where("hits > 0")
    return found, statements.join(found.select("article").distinct(), "article", "left_semi")


def first_label(nodes: DataFrame, node: str, graph: DataFrame, predicates: list[str], name: str = "label") -> DataFrame:
    """Adds the label of each node by the first predicate of the list that it has (of several values the least), else null."""
    rank = F.coalesce(*(F.when(F.col("p") == p, F.lit(i)) for i, p in enumerate(predicates)))
    best = graph.where(F.col("p").isin(predicates)).groupBy(F.col("s").alias("_s")).agg(F.min(F.struct(rank.alias("_r"), F.col("o").alias("_o")))["_o"].alias(name))
    return nodes.join(best, F.col(node) == F.col("_s"), "left").drop("_s")


def by_title(df: DataFrame, title: str, *ties: str) -> DataFrame:
    """Sorted by title, case aside."""
    return df.orderBy(F.lower(title), *ties)


def in_request_order(results: DataFrame, index: str = "index") -> DataFrame:
    """Results that came in any order, by the number of their request."""
    return results.orderBy(F.col(index).try_cast("long").asc_nulls_last(), index)
