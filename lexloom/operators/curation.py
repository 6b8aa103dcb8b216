"""Curation of extracted statements and of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, iri_part, local_name, squeeze, swap_class_name
from .joins import maybe_broadcast
from .reshape import class_hints

VERIFIED, REJECTED = "verified", "not_verified"


def checked_annotations(df: DataFrame, column: str) -> DataFrame:
    """Fails if an annotation isn't 1, 0 or -1."""
    value = F.col(column).try_cast("int")
    return df.withColumn(column, F.when(value.isin(1, 0, -1), value).otherwise(F.raise_error(F.concat(F.lit("not an annotation: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int")))


def curated_predicate(predicate: Column, range_: Column, classes: list[str], iri: Column | None = None, local: Column | None = None, namespace: str = "") -> Column:
    """An explicit IRI, else an explicit local name, else the predicate with its longest class name as the range's (kept plural), else with that added."""
    name, target = local_name(predicate), local_name(range_)
    hints = class_hints(name, sorted(classes, key=lambda c: (-len(c), c)))
    swapped = F.when(F.size(hints) > 0, swap_class_name(name, F.get(hints, 0), target)).otherwise(name)
    derived = F.when(swapped == name, F.concat(name, target)).otherwise(swapped)
    none = F.lit(None).cast("string")
    chosen = F.nullif(first_filled(iri if iri is not None else none), F.lit(""))
    named = F.nullif(first_filled(local if local is not None else none), F.lit(""))
    return F.coalesce(chosen, F.concat(F.lit(namespace), F.coalesce(named, derived)))


def _status() -> Column:
    return F.when(F.col("annotation") >= 0, VERIFIED).otherwise(REJECTED)


def in_order(annotations: DataFrame) -> DataFrame:
    """Annotations (not too many for one task) with ``place``: of a statement's, the one of least place is the first in order, which ``curate`` takes."""
    return annotations.withColumn("place", F.row_number().over(Window.orderBy("domain", "range", "annotation")))


def placed_status(places: DataFrame, annotations: DataFrame) -> DataFrame:
    """``status`` of statements that are told by the ``place`` of their annotation alone, as ``curate`` has it."""
    return places.join(F.broadcast(annotations.select("place", _status().alias("status"))), "place").select("status")


def curate(statements: DataFrame, types: DataFrame, annotations: DataFrame) -> DataFrame:
    """Status, effective predicate and flags of the statements (stmt, s, p, o) whose signature was annotated.

    ``annotations``: predicate, domain, range, annotation (1, 0, -1), curated. A statement of several types takes the first
    annotated signature in order. 1: verified as it is; 0: verified with the curated predicate; -1: rejected.
    """
    pairs = statements.join(types.select(F.col("node").alias("_s"), F.col("cls").alias("domain")), F.col("s") == F.col("_s")).join(types.select(F.col("node").alias("_o"), F.col("cls").alias("range")), F.col("o") == F.col("_o"))
    return curate_pairs(pairs, annotations)


def curate_pairs(pairs: DataFrame, annotations: DataFrame) -> DataFrame:
    """``curate`` for statements with their types: stmt, p, domain, range, a row for each pair of types."""
    small = annotations.select(F.col("predicate").alias("_p"), F.col("domain").alias("_d"), F.col("range").alias("_r"), "annotation", "curated")
    hit = pairs.join(maybe_broadcast(small), (F.col("p") == F.col("_p")) & (F.col("domain") == F.col("_d")) & (F.col("range") == F.col("_r")))
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy("stmt").orderBy("domain", "range", "annotation"))).where("_n = 1")
    return first.select(
        "stmt", "domain", "range", F.col("p").alias("predicate"), "annotation", _status().alias("status"),
        F.when(F.col("annotation") == 0, F.col("curated")).otherwise(F.col("p")).alias("effective_predicate"),
        F.when(F.col("annotation") == 0, "replacement").when(F.col("annotation") == 1, "none").otherwise("exclusion").alias("action"),
        (F.col("annotation") >= 0).alias("in_final_ontology"),
    )


def entity_classes(entities: DataFrame, types: DataFrame, classes: list[str], namespaces: list[str], core: str) -> DataFrame:
    """``entity``, ``cls``: the known classes that an entity is typed with, in the core namespace; without any, the one that its IRI's path names, if that is known.

    ``entities``: entity; ``types``: node, cls. Types count if their local name is a known class and they are in one of ``namespaces``.
    """
    name = local_name(F.col("cls"))
    ours = F.exists(F.array(*map(F.lit, namespaces)), lambda n: F.startswith(F.col("cls"), n)) & name.isin(classes)
    typed = types.where(ours).select(F.col("node").alias("entity"), F.concat(F.lit(core), name).alias("cls")).distinct().join(entities.select("entity").distinct(), "entity", "left_semi")
    path = F.lower(F.replace(F.regexp_extract("entity", "/entity/([^/]+)/", 1), F.lit("-"), F.lit("")))
    among = F.array(*map(F.lit, classes))
    found = F.get(F.filter(among, lambda c: F.lower(c) == path), 0)
    rest = entities.select("entity").distinct().join(typed.select("entity").distinct(), "entity", "left_anti").select("entity", F.concat(F.lit(core), found).alias("cls")).where("cls IS NOT NULL")
    return typed.unionByName(rest)


def curation_triples(curated: DataFrame, base: str) -> DataFrame:
    """The layer that is added to a graph: ``s``, ``p``, ``o`` for each decision."""
    node = F.concat(F.lit(f"{base}/curation/"), F.md5("stmt"))
    make = lambda p, o: F.struct(node.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    parts = F.array(make("target", F.col("stmt")), make("status", F.col("status")), make("effectivePredicate", F.col("effective_predicate")), make("action", F.col("action")), make("inFinalOntology", F.col("in_final_ontology")))
    return curated.select(F.explode(parts).alias("t")).select("t.*")


def document_decisions(corpus: DataFrame, selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Documents of the corpus that are selected (validated), or only candidates (not selected), with their evidence.

    All have ``title``; candidates ``evidence`` too. Titles are compared without regard to white space and case.
    """
    key = lambda df: df.withColumn("_k", F.lower(squeeze(F.col("title"))))
    chosen = key(selected).select("_k").distinct()
    evidence = key(candidates).groupBy("_k").agg(F.sort_array(F.collect_list("evidence")).alias("evidence"))
    titles = key(corpus).groupBy("_k").agg(F.min("title").alias("title"))
    status = chosen.withColumn("status", F.lit("validated")).unionByName(evidence.select("_k").join(chosen, "_k", "left_anti").withColumn("status", F.lit("not_selected")))
    return titles.join(status, "_k").join(evidence, "_k", "left").select("title", "status", F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"), F.array_join("evidence", "; ").alias("evidence")).orderBy(F.lower("title"))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("count"))


# fixed values: what the two statuses of documents are called and mean
VALIDATED = ("Validated for maintenance", "The legal document has been reviewed and validated as relevant to the maintenance corpus.")
NOT_SELECTED = ("Not selected for maintenance", "The document was considered as a candidate and excluded after the relevant arrêté for the maintenance corpus had been selected.")
VALIDATED_ENDING = "ValidatedForMaintenance"


def curation_rows(decisions: DataFrame, allowed: DataFrame, base: str, activity: dict[str, str]) -> DataFrame:
    """The rows of the curation source, one for each decision (id, target, status) on an allowed document; those without a target or a status are left out.

    ``allowed``: document (IRI). ``activity``: the columns that all rows share (activity_uri, activity_label, activity_comment, started_at, ended_at, source_uri, source_title, dataset_uri, motivation_uri).
    """
    good = F.col("status").endswith(VALIDATED_ENDING)
    known = decisions.where((first_filled(F.col("target")) != "") & (first_filled(F.col("status")) != "")).join(allowed.select(F.col("document").alias("target")).distinct(), "target", "left_semi")
    return known.select(
        F.concat(F.lit(f"{base}/curation/"), iri_part(first_filled(F.col("id")))).alias("decision_uri"), F.col("target").alias("target_uri"), F.concat(F.lit(f"{base}/"), F.regexp_replace("status", "^inst:", "")).alias("status_uri"),
        *(F.when(good, a).otherwise(b).alias(n) for n, a, b in zip(("status_label", "status_definition"), VALIDATED, NOT_SELECTED)), *(F.lit(v).alias(k) for k, v in sorted(activity.items())),
    )
