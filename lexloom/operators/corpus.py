"""Corpus preparation: duplicates, patterns of variation and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import maybe_broadcast


def _varies(c: str) -> Column:
    """Whether a group has several values; null is one of them."""
    return (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) > 1


def variation(df: DataFrame, content: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """For each content that occurs more than once: its rows and its pattern, the sorted names of the columns that vary."""
    columns = sorted(c for c in df.columns if c != content and c not in skip)
    grouped = df.groupBy(content).agg(F.count(F.lit(1)).alias("rows"), *(_varies(c).alias(c) for c in columns)).where("rows > 1")
    pattern = F.concat_ws(" | ", *(F.when(F.col(c), F.lit(c)) for c in columns))
    return grouped.select(content, "rows", F.when(pattern == "", "NO_VARIATION").otherwise(pattern).alias("pattern"))


def variation_patterns(df: DataFrame, content: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Groups, rows and share of groups (percent, 2 decimals) of each pattern."""
    found = variation(df, content, skip).groupBy("pattern").agg(F.count(F.lit(1)).alias("group_count"), F.sum("rows").alias("total_rows"))
    share = F.round(F.col("group_count") * 100.0 / F.sum("group_count").over(Window.partitionBy(F.lit(0))), 2)
    return found.withColumn("percentage", share).orderBy(F.desc("group_count"), "pattern")


def contents_of_pattern(df: DataFrame, content: str, pattern: str, skip: tuple[str, ...] = ()) -> DataFrame:
    return variation(df, content, skip).where(F.col("pattern") == pattern).select(content, "rows").orderBy(F.desc("rows"), content)


def inspect(df: DataFrame, content: str) -> DataFrame:
    """Distinct values of every column (null counts) for each repeated content."""
    columns = [c for c in df.columns if c != content]
    counts = ((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias(f"n_{c}") for c in columns)
    return df.groupBy(content).agg(F.count(F.lit(1)).alias("rows"), *counts).where("rows > 1")


def first_of_pattern(df: DataFrame, content: str, pattern: str, n: int, order: str, skip: tuple[str, ...] = ()) -> DataFrame:
    top = contents_of_pattern(df, content, pattern, skip).limit(n).select(F.col(content).alias("_c"))
    return df.join(maybe_broadcast(top), F.col(content) == F.col("_c"), "left_semi").orderBy(content, order)


def drop_if_only_varies(df: DataFrame, content: str, column: str, order: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row, the first in ``order``, of groups in which nothing but ``column`` varies; other rows stay."""
    marked = df.join(variation(df, content, (*skip, order)).select(F.col(content).alias("_c"), "pattern"), F.col(content) == F.col("_c"), "left")
    nth = F.row_number().over(Window.partitionBy(content, "pattern").orderBy(order))
    hit = F.coalesce(F.col("pattern") == column, F.lit(False))
    return marked.withColumn("_n", nth).where(~hit | (F.col("_n") == 1)).drop("_c", "_n", "pattern")


def join_values(df: DataFrame, content: str, column: str, order: str, skip: tuple[str, ...] = (), joint: str = "; ") -> DataFrame:
    """One row, with all values of ``column`` in order, of groups in which it alone varies, and one of groups in which nothing does."""
    marks = variation(df, content, (*skip, order)).where(F.col("pattern").isin(column, "NO_VARIATION"))
    values = df.groupBy(content).agg(F.array_join(F.sort_array(F.collect_set(column)), joint).alias("_v"))
    marks = marks.join(values, content).select(F.col(content).alias("_c"), "_v")
    marked = df.join(marks, F.col(content) == F.col("_c"), "left")
    nth = F.row_number().over(Window.partitionBy(content).orderBy(order))
    return marked.withColumn("_n", nth).where("_c IS NULL OR _n = 1").withColumn(column, F.coalesce("_v", column)).drop("_c", "_n", "_v")


def drop_repeated(df: DataFrame, content: str) -> DataFrame:
    """Only rows whose content occurs once."""
    once = df.groupBy(content).count().where("count = 1").select(F.col(content).alias("_c"))
    return df.join(once, F.col(content).eqNullSafe(F.col("_c")), "left_semi")


def stratified_sample(df: DataFrame, groups: list[str], ratio: float, key: str, seed: int = 42) -> DataFrame:
    """min(n, max(1, ceil(n * ratio))) rows of each group of n: those whose keys have the least hashes."""
    sizes = df.groupBy(*groups).count().select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.greatest(F.lit(1), F.ceil(F.round(F.col("count") * ratio, 9))).alias("_k"))
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return df.join(sizes, on).withColumn("_n", nth).where("_n <= _k").drop("_n", "_k", *(f"_g_{g}" for g in groups))


def corpus_counts(df: DataFrame, unique: list[str], sums: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_distinct(c).alias(f"unique_{c}") for c in unique), *(F.sum(c).alias(f"sum_{c}") for c in sums))


def token_counts(df: DataFrame, column: str, joint: str = ",") -> DataFrame:
    words = df.select(F.explode(F.split(column, joint)).alias("w")).select(F.trim("w").alias("token")).where("token != ''")
    return words.groupBy("token").count().orderBy(F.desc("count"), "token")


def keyword_sample(df: DataFrame, text: str, lift: str, keywords: str, key: str, n: int = 50) -> DataFrame:
    """The best texts by (has the lifting pattern, distinct keywords, keyword hits)."""
    hits = F.transform(F.regexp_extract_all(F.lower(text), F.lit(keywords), F.lit(0)), lambda w: w)
    scored = df.withColumns({"lift": F.lower(text).rlike(lift).cast("int"), "distinct_keywords": F.size(F.array_distinct(hits)), "hits": F.size(hits)}).where("hits > 0")
    return scored.orderBy(F.desc("lift"), F.desc("distinct_keywords"), F.desc("hits"), key).limit(n)


def demo_rows(df: DataFrame, topic: str, text: str, topics: tuple[str, ...], general: str, special: str) -> DataFrame:
    """Rows whose topic has one of ``topics`` and whose text matches both patterns, in any case; ``hits``: matches of the special one."""
    named = F.exists(F.array(*map(F.lit, topics)), lambda t: F.contains(F.lower(F.col(topic)), t))
    hits = F.regexp_count(text, F.lit(f"(?iu){special}"))
    return df.where(named & F.col(text).rlike(f"(?iu){general}")).withColumn("hits", hits).where("hits > 0")
