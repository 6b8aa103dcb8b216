"""Schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SPANS = T.ArrayType(SPAN)

#: One extracted triple; keys that a record lacks are null.
TRIPLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("head", "head_type", "relation", "tail", "tail_type", "topic")]
    + [T.StructField("triplet_index", T.IntegerType())]
    + [T.StructField(n, T.IntegerType()) for n in ("head_start", "head_end", "tail_start", "tail_end")]
    + [T.StructField("head_spans", SPANS), T.StructField("tail_spans", SPANS)]
    + [T.StructField("head_span_mode", T.StringType()), T.StructField("tail_span_mode", T.StringType())]
)
TRIPLES = T.ArrayType(TRIPLE)

#: A graph: a set of triples of terms; kinds are iri, bnode and literal.
GRAPH = T.StructType([T.StructField(n, T.StringType()) for n in ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")])
GRAPH_COLUMNS = GRAPH.fieldNames()

CANDIDATE = T.StructType(
    [
        T.StructField("object_prop_candidate", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("range", T.StringType()),
        T.StructField("textual_evidence", T.ArrayType(T.StringType())), T.StructField("definition", T.StringType()),
        T.StructField("aligned_CQ", T.StringType()), T.StructField("confidence", T.StringType()),
    ]
)
