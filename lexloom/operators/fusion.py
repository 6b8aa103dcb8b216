"""Fusion of equivalent labels: exact folding, leader clustering by cosine, canonical choice and the report."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_latin, local_name
from .filters import clusterable
from .joins import apply_map, maybe_broadcast


def preference(count: Column, label: Column, *before: Column) -> Column:
    """What a canonical label has most of: ``before``, then count, length, and the label itself."""
    return F.struct(*before, count, F.length(label).alias("_length"), label)


def frequencies(triples: DataFrame) -> DataFrame:
    """How often each label is head or tail."""
    both = triples.select(F.explode(F.array("head", "tail")).alias("label")).where("label IS NOT NULL")
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def relation_frequencies(triples: DataFrame) -> DataFrame:
    return triples.groupBy("head_type", "tail_type", "relation").agg(F.count(F.lit(1)).alias("count"))


def exact_merge(labels: DataFrame, group: list[str], label: str = "label", count: str = "count", folded: Column | None = None) -> DataFrame:
    """``labels`` with the ``canonical`` of all labels of a group that fold alike, and how many variants it has; empty folds stand alone."""
    key = fold_latin(F.col(label)) if folded is None else folded
    keyed = labels.withColumn("_key", F.when(key == "", F.concat(F.lit("\0"), F.col(label))).otherwise(key))
    best = keyed.groupBy(*group, "_key").agg(
        F.max_by(label, preference(F.col(count), F.col(label))).alias("canonical"), F.count(F.lit(1)).alias("variants"), F.sum(count).alias("canonical_count")
    )
    return keyed.join(best, [*group, "_key"]).drop("_key")


def lead(vectors: np.ndarray, theta: float, block: int = 2048) -> np.ndarray:
    """The leader of each row, in their order: a row without one leads, and takes all later rows without one whose cosine with it is at least theta.

    Float32, as similarities are compared with theta in that precision. Rows meet the leaders so far in blocks of matrix products.
    """
    x = np.asarray(vectors, np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    leader = np.full(len(x), -1, np.int64)
    leaders: list[int] = []
    for a in range(0, len(x), block):
        rows = x[a : a + block]
        for k in range(0, len(leaders), block):  # earlier leaders first, as they came first
            some = np.array(leaders[k : k + block])
            hit = rows @ x[some].T >= theta
            free = (leader[a : a + block] < 0) & hit.any(axis=1)
            leader[a : a + block][free] = some[hit.argmax(axis=1)[free]]
        near = rows @ rows.T >= theta
        for i in range(len(rows)):
            if leader[a + i] < 0:
                leader[a + i] = a + i
                leaders.append(a + i)
                later = np.flatnonzero(near[i, i + 1 :]) + i + 1
                later = later[leader[a + later] < 0]
                leader[a + later] = a + i
    return leader


def leader_clusters(labels: DataFrame, group: str, order: str, label: str, vector: str, theta: float) -> DataFrame:
    """``group``, ``label``, ``leader`` for each label; clusters are made in each group by ``order``, which the result depends on.

    A group is sequential by nature, so it is one task's: groups are types or signatures, whose distinct labels are few next to the triples.
    """
    schema = labels.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order, label], kind="stable").reset_index(drop=True)
        at = lead(np.stack(rows[vector].to_numpy()), theta) if len(rows) > 1 else np.zeros(1, np.int64)
        return pd.DataFrame({group: rows[group], label: rows[label], "leader": rows[label].to_numpy()[at]})

    kinds = [(c, schema[c].dataType.simpleString()) for c in (group, label)]
    out = ", ".join(f"`{c}` {t}" for c, t in [*kinds, ("leader", kinds[1][1])])
    return labels.select(group, order, label, vector).groupBy(group).applyInPandas(run, out)


def canonical_of_clusters(clusters: DataFrame, counts: DataFrame, group: str, label: str = "label", rank: Column | None = None) -> DataFrame:
    """The canonical label of each cluster by ``preference``; ``rank`` puts some before others."""
    rows = clusters.join(counts, [group, label], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    first = [] if rank is None else [rank.alias("_rank")]
    best = rows.groupBy(group, "leader").agg(F.max_by(label, preference(F.col("count"), F.col(label), *first)).alias("canonical"), F.count(F.lit(1)).alias("cluster_size"), F.sum("count").alias("canonical_count"))
    return rows.join(best, [group, "leader"])


def ontology_rank(df: DataFrame, signatures: DataFrame, properties: DataFrame, head_type: str, label: str, tail_type: str) -> DataFrame:
    """``rank``: 2 if the signature is allowed, 1 if the property is known, else 0; all by local names."""
    name = lambda c: local_name(F.col(c))
    s = signatures.select(F.col("domain").alias("_d"), F.col("property").alias("_p"), F.col("range").alias("_r")).distinct()
    p = properties.select(F.col("property").alias("_q")).distinct()
    out = df.join(maybe_broadcast(s), (name(head_type) == F.col("_d")) & (name(label) == F.col("_p")) & (name(tail_type) == F.col("_r")), "left").join(maybe_broadcast(p), name(label) == F.col("_q"), "left")
    return out.withColumn("rank", F.when(F.col("_d").isNotNull(), 2).when(F.col("_q").isNotNull(), 1).otherwise(0)).drop("_d", "_p", "_r", "_q")


def entity_labels(triples: DataFrame, excluded: tuple[str, ...] = ("Reference",)) -> DataFrame:
    """Distinct labels of each type, heads and tails, that may be clustered, with counts over all types."""
    both = triples.select(F.explode(F.array(F.struct(F.col("head").alias("label"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("label"), F.col("tail_type").alias("type")))).alias("e")).select("e.*")
    return both.where(clusterable(F.col("label"), F.col("type"), excluded)).distinct().join(frequencies(triples), "label")


def merge_entities(triples: DataFrame, vectors: DataFrame, theta: float, excluded: tuple[str, ...] = ("Reference",)) -> tuple[DataFrame, DataFrame]:
    """Triples with canonical heads and tails, and the map (type, label, canonical).

    ``vectors``: label, vector, for the exact step's canonicals. Within each type: labels that fold alike, then clusters of those by
    cosine in the order of labels, their counts summed. A label of two types takes the map of the type that sorts last.
    """
    final = _entity_map(entity_labels(triples, excluded), vectors, theta)
    return _renamed(triples, final, ["head", "tail"]), final


def _entity_map(labels: DataFrame, vectors: DataFrame, theta: float) -> DataFrame:
    """``type``, ``label``, ``canonical`` of labels (type, label, count): those that fold alike, then clusters of their canonicals."""
    exact = exact_merge(labels, ["type"])
    canon = exact.groupBy("type", F.col("canonical").alias("label")).agg(F.sum("count").alias("count"))
    with_vectors = canon.join(vectors, "label").withColumn("_order", F.col("label"))
    clusters = leader_clusters(with_vectors, "type", "_order", "label", "vector", theta)
    best = canonical_of_clusters(clusters, canon, "type")
    step = best.select("type", F.col("label").alias("canonical"), F.col("canonical").alias("final"))
    return exact.select("type", "label", "canonical").join(step, ["type", "canonical"], "left").select("type", "label", F.coalesce("final", "canonical").alias("canonical"))


def _renamed(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Labels of ``columns`` as their canonicals; one of two types takes that of the type that sorts last."""
    by_label = mapping.groupBy("label").agg(F.max_by("canonical", "type").alias("canonical"))
    for c in columns:
        rows = apply_map(rows, by_label.withColumnRenamed("label", c), [c], c, "canonical")
    return rows


def side_labels(rows: DataFrame, column: str, type_column: str, excluded: tuple[str, ...] = ("Reference",)) -> DataFrame:
    """Distinct labels of one column by type that may be clustered, with counts over all types."""
    own = rows.select(F.col(column).alias("label"), F.col(type_column).alias("type")).where("label IS NOT NULL")
    return own.where(clusterable(F.col("label"), F.col("type"), excluded)).distinct().join(own.groupBy("label").agg(F.count(F.lit(1)).alias("count")), "label")


def merge_one_side(rows: DataFrame, vectors: DataFrame, theta: float, column: str = "head", type_column: str = "head_type", excluded: tuple[str, ...] = ("Reference",)) -> tuple[DataFrame, DataFrame]:
    """Like ``merge_entities`` for one column by its type: rows with canonical labels, and the map (type, label, canonical)."""
    final = _entity_map(side_labels(rows, column, type_column, excluded), vectors, theta)
    return _renamed(rows, final, [column]), final


def merge_column(rows: DataFrame, vectors: DataFrame, theta: float, column: str, order: str, group: str = "all") -> tuple[DataFrame, DataFrame]:
    """A column's labels without any grouping or folding: clusters of all of them in order of first appearance, and the map (group, label, canonical).

    Clustering is sequential, so the distinct labels are one task's, as a column of relations allows.
    """
    own = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_first")).withColumn("group", F.lit(group))
    clusters = leader_clusters(own.join(vectors, "label"), "group", "_first", "label", "vector", theta)
    mapping = canonical_of_clusters(clusters, own.select("group", "label", "count"), "group").select("group", "label", "canonical")
    return apply_map(rows, mapping.select(F.col("label").alias(column), "canonical"), [column], column, "canonical"), mapping


def merge_relations(triples: DataFrame, vectors: DataFrame, theta: float, order: str = "row_id", signatures: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Triples with canonical relations, and the map, within each (head_type, tail_type) in the order of first appearance."""
    typed = triples.where("head_type IS NOT NULL AND tail_type IS NOT NULL AND relation IS NOT NULL")
    group = F.concat_ws("|||", "head_type", "tail_type")
    labels = typed.groupBy("head_type", "tail_type", "relation").agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_first")).withColumn("group", group)
    clusters = leader_clusters(labels.withColumnRenamed("relation", "label").join(vectors, "label"), "group", "_first", "label", "vector", theta)
    counts = labels.select("group", F.col("relation").alias("label"), "count", "head_type", "tail_type")
    rank = None
    if signatures is not None:
        counts = ontology_rank(counts, signatures, signatures.select("property"), "head_type", "label", "tail_type")
        rank = F.col("rank")
    best = canonical_of_clusters(clusters, counts, "group", rank=rank)
    mapping = best.select("head_type", "tail_type", F.col("label").alias("relation"), "canonical")
    return apply_map(triples, mapping, ["head_type", "tail_type", "relation"], "relation", "canonical"), mapping


def cluster_report(members: DataFrame, kind: str, group: str) -> DataFrame:
    """A row for each variant: members have ``group``, ``canonical``, ``label``, ``count``."""
    cluster = Window.partitionBy(group, "canonical")
    ordered = F.reverse(F.sort_array(F.collect_list(F.struct("count", F.length("label").alias("l"), "label")).over(cluster)))
    out = members.select(
        F.lit(kind).alias("cluster_kind"), F.col(group).alias("group"), F.col("canonical").alias("canonical_label"), F.col("label").alias("variant_label"), F.col("count").alias("variant_count"),
        F.sum("count").over(cluster).alias("canonical_count"), F.count(F.lit(1)).over(cluster).alias("cluster_size"), (F.col("label") == F.col("canonical")).alias("is_canonical"),
        F.to_json(F.transform(ordered, lambda x: x["label"])).alias("variants_in_cluster"),
    )
    return out.orderBy("cluster_kind", "group", "canonical_label", F.desc("variant_count"), "variant_label")


def mapping_json(report: DataFrame) -> DataFrame:
    """The report as one JSON object a cluster."""
    item = F.struct(F.col("variant_count").alias("count"), F.col("variant_label").alias("label"))
    packed = report.groupBy("cluster_kind", "group", "canonical_label").agg(F.max("cluster_size").alias("cluster_size"), F.reverse(F.sort_array(F.collect_list(item))).alias("variants"))
    return packed.select("cluster_kind", "group", "canonical_label", F.to_json(F.struct("canonical_label", "cluster_size", "variants")).alias("json"))


def preferred_labels(occurrences: DataFrame, iri: str, label: str) -> DataFrame:
    """For each IRI the label that is most frequent, not just capitalised as at a sentence's start, longest and last in order."""
    text = F.col(label)
    initial = (F.length(text) > 1) & (F.substring(text, 1, 1) != F.lower(F.substring(text, 1, 1))) & (F.substring(text, 2, 1 << 30) == F.lower(F.substring(text, 2, 1 << 30)))
    counted = occurrences.groupBy(iri, label).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(iri).agg(F.max_by(label, F.struct("_n", (~initial).alias("_plain"), F.length(text).alias("_length"), text)).alias("pref_label"))


def number_mentions(mentions: DataFrame, doc: str, order: str, keys: list[str]) -> DataFrame:
    """Distinct mentions of each document, numbered M1, M2, … by first appearance."""
    firsts = mentions.groupBy(doc, *keys).agg(F.min(order).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(doc).orderBy("_first", *keys))
    return firsts.select(doc, *keys, F.concat(F.lit("M"), nth.cast("string")).alias("mention_id"))


def distinct_objects(df: DataFrame, group: list[str], payload: str, order: str) -> DataFrame:
    """JSON objects without repeats (key order aside), the first of each in order."""
    # a VARIANT sorts its keys
    canonical = F.coalesce(F.to_json(F.try_parse_json(payload)), F.col(payload))
    return df.withColumn("_c", canonical).groupBy(*group, "_c").agg(F.min_by(payload, order).alias(payload), F.min(order).alias(order)).drop("_c")


def embed(labels: DataFrame, label: str, provider, batch: int = 128, known: DataFrame | None = None, service: str = "", model: str = "") -> DataFrame:
    """Distinct labels with ``vector`` from ``provider(list of texts)``, called with at most ``batch`` texts at a time.

    ``known`` (service, model, text, vector): vectors that are at hand, of which those of ``service`` and ``model`` are taken instead of asking again.
    """
    if known is not None:
        own = known.where((F.col("service") == service) & (F.col("model") == model)).groupBy(F.col("text").alias(label)).agg(F.first("vector").cast("array<float>").alias("vector"))
        wanted = labels.select(label).distinct()
        return wanted.join(own, label).unionByName(embed(wanted.join(own, label, "left_anti"), label, provider, batch))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                texts = part[label].iloc[a : a + batch].tolist()
                yield pd.DataFrame({label: texts, "vector": [list(map(float, v)) for v in provider(texts)]})

    return labels.select(label).distinct().mapInPandas(run, f"`{label}` string, vector array<float>")


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """An offline stand-in for an embedding service: counts of hashed character trigrams."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * size
        padded = f"  {text.lower()} "
        for i in range(len(padded) - 2):
            v[zlib.crc32(padded[i : i + 3].encode()) % size] += 1.0
        out.append(v)
    return out
