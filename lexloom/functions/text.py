"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: cells that count as blank, in lower case
BLANKS = ("", "nan", "none", "null", "na")


def blank(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("")).isin(*BLANKS)


def first_filled(*columns: Column, default: str = "") -> Column:
    """The first that isn't blank, untrimmed; else ``default``."""
    return F.coalesce(*(F.when(~blank(c), c.cast("string")) for c in columns), F.lit(default))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_text(text: str | None) -> str | None:
    """Apostrophes to spaces, compatibility decomposition, ASCII only, lower case, other characters to single spaces."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKD", re.sub("['’ʼ`´]", " ", text))
    return " ".join(re.sub(r"[^0-9a-z]+", " ", text.encode("ascii", "ignore").decode().lower()).split())


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    """``fold_text`` for any script, in Arrow batches."""
    return texts.map(fold_text, na_action="ignore")


@lru_cache(maxsize=1)
def _latin_table() -> tuple[str, str, dict[str, str]]:
    """For the Latin blocks, from the decomposition rule: letters with one ASCII letter, and those with several; others vanish."""
    one, gone, several = {}, [], {}
    for code in (*range(0x80, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07)):
        c = chr(code)
        if c in "’ʼ´":
            continue
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[c] = plain
        elif plain:
            several[c] = plain
        else:
            gone.append(c)
    return "".join(one) + "".join(gone), "".join(one.values()), several


def fold_latin(c: Column) -> Column:
    """``fold_text`` without Python, for texts in Latin letters and general punctuation; other characters vanish likewise."""
    source, target, several = _latin_table()
    words = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^0-9a-z]+", " "))
    plain_text = F.octet_length(c) == F.length(c)  # ASCII alone needs no table
    given, c = c, F.translate(c, "'’ʼ`´", "     ")
    for letter, plain in several.items():
        if "ﬀ" <= letter <= "ﬆ" or letter in "Ĳĳ½¼¾…":
            c = F.replace(c, F.lit(letter), F.lit(plain))
    c = F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")
    return F.when(plain_text, words(given)).otherwise(words(c))


def slug(c: Column, longest: int | None = None, default: str = "unnamed", folded: bool = False) -> Column:
    """Hyphenated folded text, cut to ``longest`` without a trailing hyphen; ``default`` if nothing is left."""
    c = F.replace(c if folded else fold_latin(c), F.lit(" "), F.lit("-"))
    if longest:
        c = F.regexp_replace(F.substring(c, 1, longest), "-+$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(c)


def topic_slug(c: Column) -> Column:
    return F.replace(fold_latin(c), F.lit(" "), F.lit("-"))


def local_name(c: Column) -> Column:
    """What follows the last ``#``, else the last ``/``, else the last ``:``."""
    c = F.regexp_replace(F.trim(c), "/+$", "")
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).when(c.contains("/"), F.substring_index(c, "/", -1)).otherwise(F.substring_index(c, ":", -1))


def last_part(c: Column) -> Column:
    """The last part between ``/`` and ``#``."""
    return F.regexp_extract(c, "([^/#]+)/*$", 1)


def namespace_cut(c: Column) -> Column:
    """The saved queries' cut, which keeps ``area#name`` of a namespace that ends in ``area#``."""
    return F.regexp_replace(c, "^.*/|^.*#", "")


def iri_part(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``._-~``."""
    c = F.url_encode(c)
    return F.replace(F.replace(F.replace(c, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def short_hash(*columns: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", *columns)), 1, length)


def clean_markup(c: Column) -> Column:
    """Without tags; runs of two or more white spaces as one space; without runs of pairs of dots."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    c = F.regexp_replace(c, r"\s{2,}", " ")
    return F.trim(F.regexp_replace(c, r"(?:\.\.)+", ""))


# fixed value: what opens an article, in any case, with its number
ARTICLE_NUMBER = r"^\s*(?:Art\.|Article)\s+(.{1,32}?)(?:\s*\.\s*-|\s*[.):-]|\s*$)"


def article_number(c: Column) -> Column:
    """The number that opens an article: 1 to 32 characters of a line after ``Art.`` or ``Article``; empty if there is none."""
    return F.trim(F.regexp_extract(c, "(?iudU)" + ARTICLE_NUMBER, 1))


# fixed values: types whose labels may stand for the act itself, and what such a label folds to
CURRENT_ACT_TYPES = ("artifact", "source")
CURRENT_ACT = r"^(?:(?:l|le|la|les|du|de|des|au|aux|a|ce|cet|cette)\s+)*present(?:e|s|es)?\s+(?:arrete|arret|decret|loi|decision|ordonnance|reglement|acte|texte)$"


def is_current_act(label: Column, kind: Column) -> Column:
    """Whether a label stands for the act that it is in (``le présent arrêté``)."""
    return F.coalesce(fold_latin(kind).isin(*CURRENT_ACT_TYPES) & fold_latin(label).rlike(CURRENT_ACT), F.lit(False))


def resolution(label: Column, kind: Column, document_key: Column) -> tuple[Column, Column]:
    """How a label is resolved and, for the act itself, to which document; everything else is an entity of the whole graph."""
    own = is_current_act(label, kind)
    return F.when(own, "current_legal_act").otherwise("global_entity"), F.when(own, document_key).otherwise("")


def entity_class(iri: Column) -> Column:
    """The class that an entity's IRI names (``…/entity/{class}/…``), as a title; Unknown if it has none, null for null."""
    part = F.regexp_extract(iri, "/entity/([^/]+)/", 1)
    return F.when(iri.isNull(), None).when(part == "", "Unknown").otherwise(F.replace(F.initcap(F.replace(part, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("")))


def group_part(c: Column) -> Column:
    """Runs of characters other than letters and digits as ``_``; Unknown if null or nothing is left."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(c)


def group_id(*columns: Column) -> Column:
    return F.concat_ws(" | ", *map(group_part, columns))


def alternative_label(own: Column, preferred: Column) -> Column:
    """``own`` if it differs from ``preferred`` in more than case and isn't a continuation of it; else empty. Without a preferred label, all are its continuation."""
    return F.when(F.coalesce(own, F.lit("")) == "", "").when(F.startswith(F.lower(own), F.lower(F.coalesce(preferred, F.lit("")))), "").otherwise(own)


def expand_template(template: str, columns: list[str]) -> Column:
    """``{name}`` replaced by that column's text; a missing column or null is empty."""
    parts = re.split(r"\{([^{}]+)\}", template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) if p in columns else F.lit("") for i, p in enumerate(parts)))


def bnode_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def css_name(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)


def expand_prefix(c: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:name`` as an IRI, for the prefixes at hand; anything else stays as it is."""
    out = c
    for prefix, base in prefixes.items():
        out = F.when(F.startswith(c, F.lit(f"{prefix}:")), F.concat(F.lit(base), F.substring(c, len(prefix) + 2, 1 << 30))).otherwise(out)
    return out


def shorten_iri(c: Column, prefixes: dict[str, str]) -> Column:
    """The IRI with its longest known namespace as a prefix, else as it is."""
    out = c
    for prefix, base in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(c, F.lit(base)), F.concat(F.lit(f"{prefix}:"), F.substring(c, len(base) + 1, 1 << 30))).otherwise(out)
    return out


def escape_literal(c: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def at_spans(text: Column, spans: Column, joint: str = " [...] ") -> Column:
    """The text at the spans (code points, end exclusive), joined."""
    return F.array_join(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), joint)


def token_estimate(c: Column) -> Column:
    """Words and marks; stands in for a model's tokenizer, which callers may inject instead."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0)).cast("long")


def token_budget(c: Column, most: int) -> Column:
    """The longest start of the text with at most ``most`` tokens of ``token_estimate``."""
    return F.when(token_estimate(c) <= most, c).otherwise(F.regexp_extract(c, rf"(?s)^(?:\s*(?:[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}])){{0,{most}}}", 0))


@F.pandas_udf(T.StringType())
def swap_class_name(names: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """The first occurrence of the class name ``old``, in any case, as ``new``; a plural's s stays."""

    def one(name, a, b):
        if name is None or not a or b is None:
            return name
        return re.sub(re.escape(a) + "(s?)", lambda m: b + m[1], name, count=1, flags=re.I)

    return pd.Series([one(*x) for x in zip(names, old, new)], dtype=object)
