"""Conformance of triples to an ontology's signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import local_name
from ..functions.values import ratio
from .joins import maybe_broadcast
from .reshape import class_hints

NONE, UNKNOWN, FORBIDDEN, UNTYPED = "none", "component_not_in_ontology", "domain_range_signature_not_allowed", "resource_type_missing_in_kg"


def normalise(df: DataFrame, column: str, terms: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``column`` as an IRI if its local name stands for exactly one term; ``terms``: iri."""
    one = terms.select("iri").distinct().groupBy(local_name(F.col("iri")).alias("_name")).agg(F.collect_set("iri").alias("_iris")).where("size(_iris) = 1")
    out = df.join(maybe_broadcast(one), F.col(column) == F.col("_name"), "left")
    return out.withColumn(column, F.coalesce(F.col("_iris")[0], F.col(column))).drop("_name", "_iris")


def check_triples(triples: DataFrame, signatures: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Adds, by local names, the existence of head type, relation and tail type (and ``error_label`` of those that lack), whether the signature is allowed, ``full_match``, ``local_match``,
    ``match`` and ``reason``.

    ``signatures``: domain, property, range. Full IRIs or local names may match. ``terms`` (iri): names that stand for just one of them are taken for it first.
    """
    if terms is not None:
        for c in ("head_type", "relation", "tail_type"):
            triples = normalise(triples, c, terms)
    name = lambda c: local_name(F.coalesce(F.col(c), F.lit("")))
    full = signatures.select("domain", "property", "range").distinct()
    local = full.select(*(local_name(F.col(c)).alias(f"_{c}") for c in full.columns)).distinct()
    classes = maybe_broadcast(local.select(F.col("_domain").alias("_c")).union(local.select("_range")).where("_c IS NOT NULL").distinct())
    properties = maybe_broadcast(local.select(F.col("_property").alias("_p")).distinct())
    out = triples.withColumns({"_h": name("head_type"), "_r": name("relation"), "_t": name("tail_type")})
    for flag, key, table, column in (("head_type_exists", "_h", classes, "_c"), ("relation_exists", "_r", properties, "_p"), ("tail_type_exists", "_t", classes, "_c")):
        own = table.select(F.col(column).alias(f"_{flag}"))
        out = out.join(own, F.col(key) == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNotNull()).drop(f"_{flag}")
    pairs = maybe_broadcast(local.withColumn("_hit", F.lit(True)))
    out = out.join(pairs, (F.col("_h") == F.col("_domain")) & (F.col("_r") == F.col("_property")) & (F.col("_t") == F.col("_range")), "left").drop("_domain", "_property", "_range")
    whole = maybe_broadcast(full.select(F.col("domain").alias("_a"), F.col("property").alias("_b"), F.col("range").alias("_d"), F.lit(True).alias("_full")))
    out = out.join(whole, (F.col("head_type") == F.col("_a")) & (F.col("relation") == F.col("_b")) & (F.col("tail_type") == F.col("_d")), "left").drop("_a", "_b", "_d")
    out = out.withColumns({"full_match": F.coalesce("_full", F.lit(False)), "local_match": F.coalesce("_hit", F.lit(False)), "error_label": error_label(F.col("head_type_exists"), F.col("relation_exists"), F.col("tail_type_exists"))})
    match = F.col("full_match") | F.col("local_match")
    known = F.col("head_type_exists") & F.col("relation_exists") & F.col("tail_type_exists")
    return out.withColumn("match", match).withColumn("reason", F.when(F.col("match"), NONE).when(~known, UNKNOWN).otherwise(FORBIDDEN)).drop("_h", "_r", "_t", "_hit", "_full")


def error_label(head: Column, relation: Column, tail: Column) -> Column:
    """Which parts of a triple the ontology lacks, joined; ``none`` if it has all."""
    parts = F.concat_ws("|", *(F.when(~c, name) for c, name in ((head, "head_class_not_in_ontology"), (relation, "relation_not_in_ontology"), (tail, "tail_class_not_in_ontology"))))
    return F.when(parts == "", NONE).otherwise(parts)


def _yes(c: Column, weight: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(c, F.lit(1) if weight is None else weight)), F.lit(0)).cast("long")


def _tallies(weight: Column | None = None) -> dict[str, Column]:
    """What all metrics are made of: triples, those that conform or are forbidden, and those without each part in the ontology."""
    count = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0)).cast("long")
    lacks = {k: _yes(~F.col(f"{c}_exists"), weight) for k, c in (("no_head", "head_type"), ("no_relation", "relation"), ("no_tail", "tail_type"))}
    return {"n": count, "good": _yes(F.col("match"), weight), "forbidden": _yes(F.col("reason") == FORBIDDEN, weight), **lacks}


def _metrics(plain: dict[str, str], ratios: dict[str, tuple[str, str]]) -> list[Column]:
    """Metrics as SQL over the tallies, then safe ratios of two such."""
    return [*(F.expr(v).alias(k) for k, v in plain.items()), *(ratio(F.expr(a), F.expr(b)).alias(k) for k, (a, b) in ratios.items())]


# fixed values: names of the metrics of an article, and which tallies they are
_CLASSES_KNOWN = "2 * n - no_head - no_tail"
ROW_COUNTS = {
    "nb_triplets": "n", "nb_valid_triples_shacl": "good", "nb_invalid_triples_shacl_violations": "n - good", "nb_head_class_not_in_ontology": "no_head", "nb_class_mentions": "2 * n",
    "nb_class_mentions_defined_in_ontology": _CLASSES_KNOWN, "nb_relation_not_in_ontology": "no_relation", "nb_object_property_mentions": "n", "nb_object_property_mentions_defined_in_ontology": "n - no_relation",
    "nb_tail_class_not_in_ontology": "no_tail", "nb_domain_range_signature_not_allowed": "forbidden", "nb_relation_type_mentions": "n", "nb_relation_type_mentions_defined_in_ontology": "good",
}
ROW_RATIOS = {
    "invalid_triples_shacl_violation_ratio": ("n - good", "n"), "class_mentions_defined_in_ontology_ratio": (_CLASSES_KNOWN, "2 * n"), "relation_not_in_ontology_ratio": ("no_relation", "n"),
    "object_property_mentions_defined_in_ontology_ratio": ("n - no_relation", "n"), "domain_range_signature_not_allowed_ratio": ("forbidden", "n"), "relation_type_mentions_defined_in_ontology_ratio": ("good", "n"),
}
CELL_NAMES = {
    "syntax_valid": "legal_triplets_json_syntax_valid", "json_valid": "legal_triplets_json_valid", "error": "legal_triplets_json_error", "parseable": "legal_triplets_parseable", "parser": "legal_triplets_parser",
}


def by_article(checked: DataFrame, key: str, cells: DataFrame | None = None) -> DataFrame:
    """The metrics of each article. ``cells`` (``key`` and the fields of ``parse_cell``; a row for each article) adds how its cell parses, and articles without any triple."""
    rows = checked.groupBy(key).agg(*(c.alias(k) for k, c in _tallies().items()))
    own = []
    if cells is not None:
        tallies = [c for c in rows.columns if c != key]
        rows = cells.join(rows.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in tallies})
        own = [F.col(k).alias(v) for k, v in CELL_NAMES.items()]
    return rows.select(key, *own, *_metrics(ROW_COUNTS, ROW_RATIOS))


def _mentions(prefix: str, known: str, total: str) -> tuple[dict, dict]:
    return (
        {f"{prefix}_total_mentions": total, f"{prefix}_mentions_defined_in_ontology": known, f"{prefix}_mentions_not_in_ontology": f"{total} - ({known})"},
        {f"{prefix}_mentions_defined_in_ontology_ratio": (known, total)},
    )


def _unique(prefix: str, what: str) -> tuple[dict, dict]:
    return (
        {f"{prefix}_unique_extracted": f"{what}_all", f"{prefix}_unique_defined_in_ontology": f"{what}_known", f"{prefix}_unique_not_in_ontology": f"{what}_unknown"},
        {f"{prefix}_unique_defined_in_ontology_ratio": (f"{what}_known", f"{what}_all")},
    )


# fixed values: names of the metrics over all articles, and which tallies they are
_CELL_COUNTS = {
    "nb_rows": "cells", "nb_rows_legal_triplets_json_syntax_valid": "syntax", "nb_rows_legal_triplets_json_valid": "json", "nb_rows_legal_triplets_json_invalid": "cells - json",
    "nb_rows_legal_triplets_parseable": "parseable", "nb_rows_legal_triplets_unparseable": "cells - parseable", "json_total_rows": "cells", "json_valid_rows": "json", "json_invalid_rows": "cells - json",
    "json_strict_syntax_valid_rows": "syntax", "json_parseable_rows": "parseable", "nb_rows_empty_triplets": "cells - filled", "sum_total_input_tokens": "tokens_in", "sum_total_output_tokens": "tokens_out",
}
_CELL_RATIOS = {
    "json_validity_legal_triplets_ratio": ("json", "cells"), "json_syntax_validity_legal_triplets_ratio": ("syntax", "cells"), "parseable_legal_triplets_ratio": ("parseable", "cells"),
    "json_valid_ratio": ("json", "cells"), "json_strict_syntax_valid_ratio": ("syntax", "cells"), "json_parseable_ratio": ("parseable", "cells"),
}
_ALL_COUNTS = {
    "nb_total_triplets": "n", "nb_valid_triples_shacl": "good", "nb_invalid_triples_shacl_violations": "n - good", "nb_triples_head_class_not_in_ontology": "no_head", "nb_triples_relation_not_in_ontology": "no_relation",
    "nb_triples_tail_class_not_in_ontology": "no_tail", "nb_total_class_mentions": "2 * n", "nb_class_mentions_defined_in_ontology": _CLASSES_KNOWN, "nb_class_mentions_not_in_ontology": "no_head + no_tail",
    "nb_unique_extracted_classes": "class_all", "nb_unique_extracted_classes_defined_in_ontology": "class_known", "nb_unique_extracted_classes_not_in_ontology": "class_unknown",
    "nb_triples_domain_range_signature_not_allowed": "forbidden", "nb_ontology_signatures": "o_signatures", "nb_ontology_classes": "o_classes", "nb_ontology_relations": "o_relations",
    "unique_extracted_classes_not_in_ontology": "class_names", "object_property_unique_not_in_ontology_values": "relation_names",
}
_ALL_RATIOS = {
    "invalid_triples_shacl_violation_ratio": ("n - good", "n"), "shacl_conformance_ratio": ("good", "n"), "relation_not_in_ontology_ratio": ("no_relation", "n"), "domain_range_signature_not_allowed_ratio": ("forbidden", "n"),
    "class_mentions_defined_in_ontology_ratio": (_CLASSES_KNOWN, "2 * n"), "unique_extracted_classes_defined_in_ontology_ratio": ("class_known", "class_all"),
}
_FAMILIES = [
    _mentions("classes", _CLASSES_KNOWN, "2 * n"), _unique("classes", "class"), _mentions("object_property", "n - no_relation", "n"), _unique("object_property", "relation"),
    _mentions("relation_type", "good", "n"), _unique("relation_type", "type"),
]


def overall(checked: DataFrame, signatures: DataFrame, cells: DataFrame | None = None, key: str = "article", tokens: tuple[str, str] | None = None) -> DataFrame:
    """All metrics over the articles, in one row. ``cells`` as for ``by_article``, with the columns ``tokens`` of used tokens; without it the metrics of cells are left out.

    Triples are first counted by types and outcome, so that everything unique is told from a table of the types that occur.
    """
    local = [local_name(F.coalesce(F.col(c), F.lit(""))) for c in ("head_type", "relation", "tail_type")]
    flags = ["head_type_exists", "relation_exists", "tail_type_exists", "match", "reason"]
    # the same exchange gives the kinds of triples and the articles that have any
    once = checked.groupBy(F.col(key).alias("k"), *(c.alias(k) for c, k in zip(local, "hrt")), *flags).agg(F.count(F.lit(1)).alias("w"))
    kinds = once.groupBy("h", "r", "t", *flags).agg(F.sum("w").alias("w"))
    sides = F.explode(F.array(*(F.struct(F.col(k).alias("name"), F.col(f"{c}_exists").alias("exists")) for k, c in (("h", "head_type"), ("t", "tail_type")))))
    known = lambda name, exists: [F.count_distinct(F.when(exists, name)), F.count_distinct(F.when(~exists & (name != ""), name)), F.array_join(F.sort_array(F.collect_set(F.when(~exists & (name != ""), name))), "|")]
    filled = lambda name: F.count_distinct(F.when(name != "", name))
    named = lambda what, name, exists: [filled(name).alias(f"{what}_all"), *(c.alias(f"{what}_{k}") for c, k in zip(known(name, exists), ("known", "unknown", "names")))]
    classes = kinds.select(sides.alias("c")).select("c.*").distinct().agg(*named("class", F.col("name"), F.col("exists")))
    relations = kinds.select("r", "relation_exists").distinct().agg(*named("relation", F.col("r"), F.col("relation_exists")))
    types = kinds.groupBy("h", "r", "t").agg(F.max("match").alias("good"), F.min("match").alias("all_good"))
    types = types.agg(F.count(F.lit(1)).alias("type_all"), _yes(F.col("good")).alias("type_known"), _yes(~F.col("all_good")).alias("type_unknown"))
    found = [kinds.agg(*(c.alias(k) for k, c in _tallies(F.col("w")).items())), classes, relations, types]
    own = signatures.select(*(local_name(F.col(c)).alias(c) for c in ("domain", "property", "range")))
    declared = own.select(F.col("domain").alias("c")).union(own.select("range")).agg(F.count_distinct("c").alias("o_classes"))
    found += [declared, own.agg(F.count_distinct("domain", "property", "range").alias("o_signatures"), F.count_distinct("property").alias("o_relations"))]
    counts, ratios = dict(_ALL_COUNTS), dict(_ALL_RATIOS)
    for more, shares in _FAMILIES:
        counts |= more
        ratios |= shares
    if cells is not None:
        number = lambda c: F.coalesce(F.sum(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0))), F.lit(0.0)).cast("long") if c else F.lit(0).cast("long")
        spent = [number(c).alias(k) for c, k in zip(tokens or (None, None), ("tokens_in", "tokens_out"))]
        found.append(cells.agg(F.count(F.lit(1)).alias("cells"), *(_yes(F.col(c)).alias(k) for c, k in (("syntax_valid", "syntax"), ("json_valid", "json"), ("parseable", "parseable"))), *spent))
        found.append(once.agg(F.count_distinct("k").alias("filled")))
        counts |= _CELL_COUNTS
        ratios |= _CELL_RATIOS
    return _one_row(found).select(*_metrics(counts, ratios))


def _one_row(tables: list[DataFrame]) -> DataFrame:
    """The columns of tables of one row each in one row."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return union.agg(*(F.max(c).alias(c) for c in union.columns))


def _known_types(types: DataFrame, signatures: DataFrame) -> DataFrame:
    declared = signatures.select(F.col("domain").alias("c")).union(signatures.select("range")).where("c IS NOT NULL").distinct()
    return types.join(maybe_broadcast(declared), F.col("cls") == F.col("c"), "left_semi")


def check_graph(assertions: DataFrame, types: DataFrame, signatures: DataFrame, namespaces: list[str]) -> DataFrame:
    """Conformance of a graph's assertions (stmt, s, p, o), whose resources may have several types (node, cls).

    Of the pairs of types the first allowed one in order counts, full IRIs before local names. A predicate that the
    ontology lacks is a candidate if it is of a known namespace and both ends are typed; other such assertions are left out.
    """
    known = _known_types(types, signatures)
    of = lambda side: known.groupBy(F.col("node").alias(f"{side}_node")).agg(F.sort_array(F.collect_set("cls")).alias(f"{side}_types"))
    rows = assertions.join(of("s"), F.col("s") == F.col("s_node"), "left").join(of("o"), F.col("o") == F.col("o_node"), "left").drop("s_node", "o_node")
    return judge(rows, signatures, namespaces).where(F.col("known") | F.col("candidate"))


def judge(rows: DataFrame, signatures: DataFrame, namespaces: list[str]) -> DataFrame:
    """Adds ``known``, ``signature``, ``candidate`` and ``reason`` to assertions with ``p``, ``s_types`` and ``o_types`` (of the ontology, null without any).

    Each row is judged by the signatures of its predicate's local name, so that no pair of types becomes a row.
    """
    properties = signatures.select(F.col("property").alias("_p")).distinct()
    rows = rows.join(maybe_broadcast(properties), F.col("p") == F.col("_p"), "left").withColumn("known", F.col("_p").isNotNull()).drop("_p")
    # signatures by their property's local name, with the full ones beside: a full match goes before a local one
    near = signatures.groupBy(local_name(F.col("property")).alias("_name")).agg(F.collect_set(F.struct(local_name(F.col("domain")).alias("d"), local_name(F.col("range")).alias("r"), "domain", "property", "range")).alias("_near"))
    out = rows.join(maybe_broadcast(near), local_name(F.col("p")) == F.col("_name"), "left").drop("_name")
    rank = lambda x, h, t: F.when((x["domain"] == h) & (x["property"] == F.col("p")) & (x["range"] == t), 0).otherwise(1).alias("rank")
    of_pair = lambda h, t: F.transform(F.filter("_near", lambda x: (x["d"] == local_name(h)) & (x["r"] == local_name(t))), lambda x: F.struct(h.alias("h"), t.alias("t"), rank(x, h, t)))
    hits = F.flatten(F.transform("s_types", lambda h: F.flatten(F.transform("o_types", lambda t: of_pair(h, t)))))
    out = out.withColumn("signature", F.array_min(hits)).drop("_near")
    typed = F.col("s_types").isNotNull() & F.col("o_types").isNotNull()
    ours = F.exists(F.array(*map(F.lit, namespaces)), lambda n: F.startswith(F.col("p"), n))
    out = out.withColumn("candidate", ~F.col("known") & ours & typed)
    reason = F.when(~F.col("known"), "predicate_not_in_ontology").when(F.col("signature").isNotNull(), NONE).when(~typed, UNTYPED).otherwise(FORBIDDEN)
    return out.withColumn("reason", reason)


# fixed values: names of the metrics of a graph, and which tallies they are
GRAPH_COUNTS = {
    "nb_kg_relation_assertions_scanned": "scanned", "nb_kg_relation_assertions": "n", "nb_valid_kg_relation_assertions_shacl": "good", "nb_invalid_kg_relation_assertions_shacl": "n - good",
    "nb_kg_relation_assertions_subject_type_missing": "no_subject", "nb_kg_relation_assertions_object_type_missing": "no_object", "nb_kg_relation_assertions_domain_range_signature_not_allowed": "forbidden",
    "nb_kg_relation_assertions_predicate_not_in_ontology": "strange", "nb_kg_candidate_relation_assertions": "n + strange", "nb_invalid_kg_candidate_relation_assertions": "n - good + strange", "nb_kg_typed_resources": "typed",
}
GRAPH_RATIOS = {
    "invalid_kg_relation_assertions_shacl_ratio": ("n - good", "n"), "kg_shacl_conformance_ratio": ("good", "n"), "predicate_not_in_ontology_ratio_over_known_relation_assertions": ("strange", "n"),
    "invalid_kg_candidate_relation_assertions_ratio": ("n - good + strange", "n + strange"), "kg_candidate_relation_conformance_ratio": ("good", "n + strange"),
}


def graph_metrics(checked: DataFrame, scanned: DataFrame | None = None, types: DataFrame | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """The metrics of a checked graph, in one row. ``scanned``: the assertions that were looked at, if more than are in ``checked``; ``types`` and ``signatures`` as for ``check_graph``
    give the number of resources that the ontology types."""
    known = F.col("known")
    count = F.count(F.lit(1))
    found = [checked.agg(
        _yes(known).alias("n"), _yes(known & (F.col("reason") == NONE)).alias("good"), _yes(known & F.col("s_types").isNull()).alias("no_subject"), _yes(known & F.col("o_types").isNull()).alias("no_object"),
        _yes(F.col("reason") == FORBIDDEN).alias("forbidden"), _yes(~known).alias("strange"), *([] if scanned is not None else [count.alias("scanned")]),
    )]
    if scanned is not None:
        found.append(scanned.agg(count.alias("scanned")))
    found.append(_known_types(types, signatures).agg(F.count_distinct("node").alias("typed")) if types is not None else checked.sparkSession.range(1).select(F.lit(None).cast("long").alias("typed")))
    return _one_row(found).select(*_metrics(GRAPH_COUNTS, GRAPH_RATIOS))


def judged_metrics(judged: DataFrame) -> DataFrame:
    """The metrics of a graph, in one row, in one pass over all its judged assertions with ``s_id`` and ``o_id``: the ids of their ends, which are all its resources."""
    none = lambda c: F.lit(None).cast(judged.schema[c].dataType)
    outcome = F.struct((F.col("known") | F.col("candidate")).alias("kept"), "known", "reason", F.col("s_types").isNull().alias("no_s"), F.col("o_types").isNull().alias("no_o"))
    bare = F.lit(None).cast("struct<kept:boolean,known:boolean,reason:string,no_s:boolean,no_o:boolean>")
    row = lambda x, node: F.struct(x.alias("x"), node.alias("node"))
    parts = F.array(row(outcome, none("s_id")), *(F.when(F.col(f"{side}_types").isNotNull(), row(bare, F.col(f"{side}_id"))) for side in "so"))
    once = judged.select(F.explode(parts).alias("c")).where("c IS NOT NULL").select("c.x", "c.node").groupBy("x", "node").agg(F.count(F.lit(1)).alias("w"))
    kept, known, w = F.col("x.kept"), F.col("x.kept") & F.col("x.known"), F.col("w")
    found = once.agg(
        _yes(F.col("x").isNotNull(), w).alias("scanned"), _yes(known, w).alias("n"), _yes(known & (F.col("x.reason") == NONE), w).alias("good"), _yes(known & F.col("x.no_s"), w).alias("no_subject"),
        _yes(known & F.col("x.no_o"), w).alias("no_object"), _yes(kept & (F.col("x.reason") == FORBIDDEN), w).alias("forbidden"), _yes(kept & ~F.col("x.known"), w).alias("strange"), _yes(F.col("node").isNotNull()).alias("typed"),
    )
    return found.select(*_metrics(GRAPH_COUNTS, GRAPH_RATIOS))


def signature_support(triples: DataFrame) -> DataFrame:
    """Support of each signature, and of its predicate (distinct statements, so several types don't count twice)."""
    rows = triples.groupBy(F.col("relation").alias("predicate"), F.col("head_type").alias("domain"), F.col("tail_type").alias("range")).agg(F.count_distinct("stmt").alias("signature_support_count"))
    totals = triples.groupBy(F.col("relation").alias("predicate")).agg(F.count_distinct("stmt").alias("predicate_support_count"))
    return rows.join(totals, "predicate")


NO_HINT, KEPT, EXCLUDED = "no_tail_class_hint", "kept_tail_class_match", "excluded_tail_class_mismatch"


def tail_hints(signatures: DataFrame, classes: list[str]) -> DataFrame:
    """``expected``, and the status of each signature by the class names in its predicate's."""
    hints = class_hints(local_name(F.col("predicate")), classes)
    status = F.when(F.size(hints) == 0, NO_HINT).when(F.array_contains(hints, local_name(F.col("range"))), KEPT).otherwise(EXCLUDED)
    return signatures.withColumn("expected", F.array_join(hints, "; ")).withColumn("evaluation_status", status)


def predicate_review(hinted: DataFrame) -> DataFrame:
    """Ranges by status and kept and excluded support of each predicate; those to review come first, then full matches."""
    of = lambda s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("evaluation_status") == s, F.col("range")))), "; ")
    support = F.coalesce("signature_support_count", F.lit(1))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("evaluation_status") == s, support)), F.lit(0)).cast("long")
    out = hinted.groupBy("predicate").agg(
        of(KEPT).alias("matching"), of(EXCLUDED).alias("mismatching"), of(NO_HINT).alias("without_hint"), total(KEPT).alias("kept_support"), total(EXCLUDED).alias("excluded_support"),
        F.max(F.col("evaluation_status") == EXCLUDED).alias("_bad"), F.max(F.col("evaluation_status") == NO_HINT).alias("_none"),
    )
    status = F.when(F.col("_none"), NO_HINT).when(F.col("_bad"), "review_has_mismatching_tail_class").otherwise("all_tail_classes_match")
    rank = F.when(F.col("status").startswith("review"), 0).when(F.col("status").startswith("all"), 1).otherwise(2)
    return out.withColumn("status", status).drop("_bad", "_none").orderBy(rank, local_name(F.col("predicate")))


def long_counts(hinted: DataFrame) -> DataFrame:
    """``metric``, ``value``: signatures and support by status, and in all."""
    support = F.coalesce("signature_support_count", F.lit(1))
    rows = hinted.groupBy("evaluation_status").agg(F.count(F.lit(1)).alias("n"), F.sum(support).alias("s"))
    by_status = rows.select(F.explode(F.array(F.struct(F.concat(F.lit("signatures_"), "evaluation_status").alias("metric"), F.col("n").alias("value")), F.struct(F.concat(F.lit("support_"), "evaluation_status").alias("metric"), F.col("s").alias("value")))).alias("m")).select("m.*")
    total = hinted.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("predicate").alias("p")).select(F.explode(F.array(F.struct(F.lit("signatures").alias("metric"), F.col("n").alias("value")), F.struct(F.lit("predicates").alias("metric"), F.col("p").alias("value")))).alias("m")).select("m.*")
    return by_status.unionByName(total)


def ranked(signatures: DataFrame) -> DataFrame:
    return signatures.withColumn("place", F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("signature_support_count"), "domain", "range")))


def shapes(signatures: DataFrame) -> DataFrame:
    """The sorted ranges of each (domain, property)."""
    return signatures.where("domain IS NOT NULL AND range IS NOT NULL").groupBy("domain", "property").agg(F.array_join(F.sort_array(F.collect_set("range")), "; ").alias("ranges"))
