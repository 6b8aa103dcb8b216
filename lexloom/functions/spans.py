"""Grounding mentions in text: exact, tolerant, fuzzy and split matches, with offsets in code points."""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SPANS
from .values import clip_spans

#: Least share of a mention in the longest common block; least similarity of two long words, and what counts as long.
FUZZY_SHARE, WORD_RATIO, LONG_WORD = 0.55, 0.88, 5

# fixed values: French determiners that a text may have, those that a mention may open with, and the marks around a mention that don't count
DETERMINERS = ("le", "la", "les", "l'", "un", "une", "des", "du", "de la", "de l'", "de", "au", "aux", "à la", "à l'", "ce", "cet", "cette", "ces")
OPENING = ("le", "la", "les", "l'", "un", "une", "des", "du", "de", "au", "aux", "ce", "cet", "cette", "ces")
OUTER_MARKS = ".,;:!?\"'()[]{}"
ENDING_MARKS = " \t\r\n.,;:!?"


def lowered(c: Column) -> Column:
    """In lower case, of the same length: of all letters only İ would become two. The forms of sigma are one."""
    return F.lower(F.translate(c, "İΣς", "iσσ"))


def exact_span(mention: Column, text: Column, both_lowered: tuple[Column, Column] | None = None) -> Column:
    """The first occurrence as an array of one span, else the first in any case, else an empty array. ``both_lowered``: ``lowered`` of both, if they are at hand."""
    exact, loose = F.position(mention, text), F.position(*(both_lowered or (lowered(mention), lowered(text))))
    found = F.when(exact > 0, exact).otherwise(loose)
    span = F.array(F.struct((found - 1).cast("int").alias("start"), (found - 1 + F.length(mention)).cast("int").alias("end")))
    return F.when((F.length(mention) > 0) & (found > 0), span).otherwise(F.array().cast(SPANS))


@lru_cache(maxsize=4096)
def _plain(c: str) -> str:
    """A character without its marks, in lower case; a space if that isn't letters and digits, nothing for a mark alone."""
    base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
    return base if not base or base.isalnum() else " "


def _folded(text: str) -> tuple[str, list[int]]:
    """Folded characters, and for each the place it comes from; runs of others are one space, and there are none at the ends."""
    out, places = [], []
    for i, c in enumerate(text):
        for x in _plain(c):
            if x != " " or out and out[-1] != " ":
                out.append(x)
                places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


class _Kept:
    """A function's last results by argument, all dropped at ``most``; unlike lru_cache's it can be pickled by value."""

    def __init__(self, function, most: int):
        self.function, self.most, self.results = function, most, {}

    def __getstate__(self):
        return {"function": self.function, "most": self.most, "results": {}}

    def __call__(self, *key):
        if key not in self.results:
            if len(self.results) >= self.most:
                self.results.clear()
            self.results[key] = self.function(*key)
        return self.results[key]


# many mentions are sought in one text, and one mention in many texts; one text at a time is kept, for it can be long
_folded_text, _folded_mention = _Kept(_folded, 1), _Kept(_folded, 1024)
_NEAR_ASCII = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")  # what matches an ASCII letter in any case


def _lowered_of(text: str) -> str:
    return text.translate(_NEAR_ASCII).lower()


_lowered = _Kept(_lowered_of, 1)


def _runs_of(mention: str) -> list[str]:
    """The mention's ASCII letters and digits in runs, longest first: a text has them all, or no pattern of ``tolerant`` matches."""
    return sorted(set(re.findall("[a-z0-9]+", _lowered_of(mention))), key=len, reverse=True)


_runs = _Kept(_runs_of, 1024)


def tolerant(mention: str, text: str) -> list[tuple[int, int]]:
    """Exact, then in any case, then without the mention's outer marks, from the start of a word up to a mark, white space or the end."""
    at = text.find(mention)
    if at >= 0:
        return [(at, at + len(mention))]
    low = _lowered(text)
    if not all(run in low for run in _runs(mention)):
        return []
    m = re.search(re.escape(mention), text, re.I)
    if m:
        return [m.span()]
    core = mention.strip().strip(OUTER_MARKS)
    m = re.search(rf"(?<!\w){re.escape(core)}(?=[\s.,;:!?]|$)", text, re.I) if core else None
    if not m:
        return []
    return [(m.start(), m.start() + len(m[0].rstrip(ENDING_MARKS)))]


def approximate(mention: str, text: str) -> list[tuple[int, int]]:
    """The folded mention in the folded text, else the longest block that both share, if it has FUZZY_SHARE of the mention."""
    (short, _), (long_, places) = _folded_mention(mention), _folded_text(text)
    if not short or not long_:
        return []
    at, size = long_.find(short), len(short)
    if at < 0:
        least = math.ceil(FUZZY_SHARE * size)
        if short[size - least : least] not in long_:  # FUZZY_SHARE is over a half, so each block of that share has the mention's middle
            return []
        block = difflib.SequenceMatcher(None, short, long_, autojunk=False).find_longest_match(0, len(short), 0, len(long_))
        at, size = block.b, block.size
        if size < FUZZY_SHARE * len(short):
            return []
    return [(places[at], places[at + size - 1] + 1)]


def _token(word: str) -> str:
    return "".join(x for c in word for x in unicodedata.normalize("NFKD", c).lower() if x.isalnum())


def _text_words_of(text: str) -> tuple[list[tuple[str, tuple[int, int]]], frozenset[str]]:
    """The folded words with their places, and the set of them; those of which nothing is left don't count."""
    words = [(w, m.span()) for m in re.finditer(r"\w+", text) if (w := _token(m[0]))]
    return words, frozenset(w for w, _ in words)


_text_words = _Kept(_text_words_of, 1)


def _wanted_of(mention: str) -> list[str]:
    return [w for w in map(_token, re.findall(r"\w+", mention)) if w]


_wanted = _Kept(_wanted_of, 1024)


def _ratio_of(word: str, near: str) -> float:
    return difflib.SequenceMatcher(None, word, near, autojunk=False).ratio()


_ratio = _Kept(_ratio_of, 1 << 16)


def _alike(word: str, near: str) -> bool:
    """Equal, or long and of WORD_RATIO; no ratio exceeds what the two lengths allow."""
    if near == word:
        return True
    a, b = len(word), len(near)
    return a >= LONG_WORD and b >= LONG_WORD and 2.0 * min(a, b) / (a + b) >= WORD_RATIO and _ratio(word, near) >= WORD_RATIO


def discontinuous(mention: str, text: str) -> list[tuple[int, int]]:
    """The mention's words in order, each at its next place in the text; neighbouring words are one span."""
    (words, known), wanted = _text_words(text), _wanted(mention)
    if any(len(w) < LONG_WORD and w not in known for w in wanted):
        return []
    hits, at = [], 0
    for word in wanted:
        k = next((k for k in range(at, len(words)) if _alike(word, words[k][0])), None)
        if k is None:
            return []
        hits.append(k)
        at = k + 1
    if not hits:
        return []
    spans: list[list[int]] = []
    for k, last in zip(hits, [None, *hits[:-1]]):
        a, b = words[k][1]
        if last is not None and k == last + 1:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [tuple(s) for s in spans]


def ground_text(mention: str | None, text: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The mode (exact, approx, discontinuous or none) and the spans."""
    if not mention or not text:
        return "none", []
    for mode, find in (("exact", tolerant), ("approx", approximate), ("discontinuous", discontinuous)):
        if spans := find(mention, text):
            return mode, spans
    return "none", []


def ground_with_determiners(mention: str | None, text: str | None) -> list[tuple[int, int]]:
    """Exact, then in any case, then with any French determiner in place of the one that the mention opens with, and an optional plural s on each word."""
    if not mention or not text:
        return []
    at = text.find(mention)
    if at >= 0:
        return [(at, at + len(mention))]
    if m := re.search(re.escape(mention), text, re.I):
        return [m.span()]
    opening = re.match(rf"(?:{'|'.join(map(re.escape, OPENING))})\s+", mention, re.I)
    rest = mention[opening.end() :].split() if opening else []
    if not opening:
        return []
    words = r"\s+".join(re.escape(w) + ("" if w.endswith("s") else "s?") for w in rest)
    m = re.search(rf"\b(?:{'|'.join(map(re.escape, DETERMINERS))})\s+{words}", text, re.I)
    return [m.span()] if m else []


def _rows(found) -> list[dict]:
    return [{"start": a, "end": b} for a, b in found]


GROUNDED = T.StructType([T.StructField("mode", T.StringType()), T.StructField("spans", SPANS)])


@F.pandas_udf(GROUNDED)
def ground(mentions: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """``ground_text`` in Arrow batches."""
    found = [ground_text(m, t) for m, t in zip(mentions, texts)]
    return pd.DataFrame({"mode": [m for m, _ in found], "spans": [_rows(s) for _, s in found]})


@F.pandas_udf(T.ArrayType(GROUNDED))
def ground_all(mentions: pd.Series, texts: pd.Series) -> pd.Series:
    """``ground_text`` of each of several mentions in a text, in their order."""
    found = lambda ms, t: [{"mode": m, "spans": _rows(s)} for m, s in (ground_text(x, t) for x in ms)]
    return pd.Series([found(ms, t) for ms, t in zip(mentions, texts)])


@F.pandas_udf(SPANS)
def ground_loose(mentions: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([_rows(ground_with_determiners(m, t)) for m, t in zip(mentions, texts)])


def choose_spans(embedded: Column, inferred: Column, text: Column) -> Column:
    """Embedded spans, clipped to the text, else the inferred ones; with the mode that says which."""
    own = clip_spans(embedded, F.length(text))
    none = F.array().cast(SPANS)
    return (
        F.when(F.size(own) > 0, F.struct(F.lit("embedded").alias("mode"), own.alias("spans")))
        .when(F.size(inferred) > 0, F.struct(F.lit("inferred").alias("mode"), inferred.alias("spans")))
        .otherwise(F.struct(F.lit("missing").alias("mode"), none.alias("spans")))
    )
