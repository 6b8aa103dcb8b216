"""Dates, numbers, spans and semi-structured cells as column expressions."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SPANS, TRIPLES
from .text import BLANKS

#: Epoch values above this are milliseconds.
MILLISECONDS_FROM = 10_000_000_000


def iso_date(c: Column) -> Column:
    """A date as ``yyyy-MM-dd``: ISO dates, ISO times, ``dd.MM.yyyy`` with ``.``, ``/`` or ``-`` (not checked against the calendar), and epoch
    seconds or milliseconds in UTC. Anything else is empty."""
    c = F.trim(c.cast("string"))
    number = c.try_cast("double")
    millis = F.when(number > MILLISECONDS_FROM, number).otherwise(number * 1000)
    day = F.regexp_extract(c, r"^(\d{2})[./-](\d{2})[./-](\d{4})$", 1)
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.substring(c, 1, 10))
        .when(day != "", F.concat_ws("-", F.regexp_extract(c, r"(\d{4})$", 1), F.regexp_extract(c, r"^\d{2}[./-](\d{2})", 1), day))
        .when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e17), F.date_format(F.timestamp_millis(millis.cast("long")), "yyyy-MM-dd"))
        .otherwise("")
    )


def french_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis.try_cast("double").cast("long")), "dd.MM.yyyy")


def as_int(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 2**31), F.floor(F.abs(number)).cast("int") * F.signum(number).cast("int"))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def confidence(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; a zero vector has norm 1."""
    size = lambda v: F.sqrt(dot(v, v))
    unit = lambda v: F.when(size(v) == 0, 1.0).otherwise(size(v))
    return dot(a, b) / (unit(a) * unit(b))


# --- cells that hold triples -----------------------------------------------------------------------------------

# fixed values: keys under which a payload may hold its triples, in order, and the names of outcomes
PAYLOAD_KEYS = ("legal_triplets", "triples", "triplets")
NO_ERROR, BLANK, NOT_TRIPLES, NOT_JSON = "none", "blank", "json_payload_not_triplets", "json_decode_error:"


def parse_literal(text):
    """JSON, else a Python literal (the bare word nan, in any case, as None); None if it is neither."""
    if not isinstance(text, str):
        return text
    value, error = _decoded(json.loads, text)
    return value if not error else _decoded(ast.literal_eval, re.sub(r"\bnan\b", "None", text, flags=re.I))[0]


def _decoded(decode, text: str) -> tuple[object, str | None]:
    """A decoder's value, and what it says if there is none."""
    try:
        return decode(text), None
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError) as e:
        return None, getattr(e, "msg", None) or type(e).__name__


def _payload(value) -> str | None:
    """The objects of a list, or of the first list under a known key, as JSON."""
    lists = [value, *(value.get(k) for k in PAYLOAD_KEYS)] if isinstance(value, dict) else [value]
    found = next((x for x in lists if isinstance(x, list)), None)
    return None if found is None else json.dumps([x for x in found if isinstance(x, dict)])


def read_cell(text) -> dict:
    """How a cell parses: whether it is JSON, whether it holds triples, what is wrong, whether and by what it can be read, and its triples. Python literals are read as they stand."""
    text = "" if text is None else str(text).strip()
    if text.lower() in BLANKS:
        return _cell(False, None, BLANK, "none")
    value, error = _decoded(json.loads, text)
    triples = _payload(value if error is None else _decoded(ast.literal_eval, text)[0])
    reader = "json" if error is None else "python_literal"
    error = NOT_JSON + error if error else NOT_TRIPLES if triples is None else NO_ERROR
    return _cell(reader == "json", triples, error, "none" if triples is None else reader)


def _cell(syntax_valid: bool, triples: str | None, error: str, parser: str) -> dict:
    held = triples is not None
    return {"syntax_valid": syntax_valid, "json_valid": held, "error": error, "parseable": held, "parser": parser, "triples": triples}


CELL = T.StructType(
    [T.StructField(n, T.BooleanType()) for n in ("syntax_valid", "json_valid")]
    + [T.StructField("error", T.StringType()), T.StructField("parseable", T.BooleanType()), T.StructField("parser", T.StringType()), T.StructField("triples", T.StringType())]
)


@F.pandas_udf(CELL)
def parse_cell(cells: pd.Series) -> pd.DataFrame:
    """``read_cell`` in Arrow batches; ``triples`` is a JSON array."""
    return pd.DataFrame([read_cell(x) for x in cells], columns=CELL.fieldNames())


def json_triples(c: Column) -> Column:
    """The triples of a JSON cell, a list or an object with a known key; without Python. Null if it holds none."""
    array = F.from_json(c, TRIPLES)
    keyed = [F.from_json(F.get_json_object(c, f"$.{k}"), TRIPLES) for k in PAYLOAD_KEYS]
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), array).otherwise(F.coalesce(*keyed))


@F.pandas_udf(T.StringType())
def _literal_triples(cells: pd.Series) -> pd.Series:
    return cells.map(lambda x: _payload(parse_literal(x)), na_action="ignore")


def any_triples(c: Column) -> Column:
    """The triples of a JSON or Python-literal cell, nan read as None."""
    return F.from_json(_literal_triples(c), TRIPLES)


def json_in_text(c: Column) -> Column:
    """The JSON of a model's answer: the first fenced block, else the text itself, else what stands from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    good = lambda x: F.when(F.try_parse_json(F.when(F.trim(x) != "", x)).isNotNull(), x)
    return F.coalesce(good(fenced), good(F.trim(c)), good(braced))


def spans_of(spans: Column, start: Column, end: Column) -> Column:
    """The valid spans of a list, else the one of a start and an end; an empty array if there is none."""
    valid = F.filter(F.coalesce(spans, F.array().cast(SPANS)), lambda s: s["end"] > s["start"])
    single = F.when(end > start, F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))).otherwise(F.array().cast(SPANS))
    return F.when(F.size(valid) > 0, valid).otherwise(single)


def clip_spans(spans: Column, length: Column) -> Column:
    inside = F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), F.least(s["start"], length)).cast("int").alias("start"), F.greatest(F.lit(0), F.least(s["end"], length)).cast("int").alias("end")))
    return F.filter(inside, lambda s: s["end"] > s["start"])


def span_bounds(spans: Column) -> tuple[Column, Column]:
    return F.when(F.size(spans) > 0, spans[0]["start"]), F.when(F.size(spans) > 0, F.element_at(spans, -1)["end"])


def span_text(spans: Column, joint: str = ";") -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), joint)


def ordered_unique(c: Column) -> Column:
    """An array without repeats, in order of first appearance."""
    return F.array_distinct(c)


def comparable(c: Column) -> Column:
    """A nested value as a text that is equal for equal values."""
    return F.to_json(F.struct(c.alias("v")))


def context_window(model: Column) -> Column:
    """A model's context in tokens by the size its name gives (``…-32k``), else 128,000."""
    size = F.regexp_extract(F.lower(model), r"(\d+)k\b", 1)
    return F.when(size != "", size.cast("int") * 1000).otherwise(F.lit(128_000))
