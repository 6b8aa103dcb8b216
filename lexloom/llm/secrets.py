"""Secret scans: Boolean trigram queries over an inverted index pick the texts in which each rule's regex is run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import utf8_column

try:  # Python 3.11 and later
    from re import _constants as sre, _parser as sre_parse
except ImportError:
    import sre_constants as sre
    import sre_parse

Query = tuple  # ("all",), ("tri", bytes), ("and", q...) or ("or", q...)
ALL: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    """Finds ``pattern``, leftmost and without overlap; a match counts if group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")
#: The base kinds, in the order that breaks ties.
BASE = (
    Rule("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds whose formats are public.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def _join(kind: str, parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and (not parts or ALL in parts):
        return ALL
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _words(items, most: int = 64) -> list[set[str] | None]:
    """Strings of lower-case characters that each run of ``items`` can spell; None where a run breaks."""
    runs: list[set[str] | None] = [{""}]
    for op, arg in items:
        here: set[str] | None = None
        if op is sre.LITERAL:
            here = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            here = {chr(a).lower() for _, a in arg}
        if here is None or any(len(c.encode()) != len(c) for c in here) or len(runs[-1] or ()) * len(here) > most:
            runs += [None, {""}]
        if here is not None and all(len(c.encode()) == len(c) for c in here):
            runs[-1] = {a + b for a in runs[-1] for b in here}
    return runs


def _query(items) -> Query:
    parts: list[Query] = []
    for run in _words(items):
        if run and all(len(w) >= 3 for w in run):
            parts.append(_join("or", (_join("and", (("tri", w[i : i + 3].encode()) for i in range(len(w) - 2))) for w in sorted(run))))
    for op, arg in items:
        if op is sre.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is sre.BRANCH:
            parts.append(_join("or", (_query(x) for x in arg[1])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _join("and", parts)


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-case trigrams that every text matching ``pattern`` meets; ("all",) if none is mandatory."""
    return _query(list(sre_parse.parse(pattern)))


def trigrams(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1:])) if query[0] in ("and", "or") else set()


class Postings:
    """An inverted index of one segment (a batch of texts) over the trigrams that the rules ask for."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: Iterable[bytes], block: int = 1 << 22):
        self.n = len(starts)
        wanted = sorted(wanted)
        codes = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in wanted], np.uint32)
        first = np.zeros(256, bool)
        first[[t[0] for t in wanted]] = True
        second = np.zeros(256, bool)
        second[[t[1] for t in wanted]] = True
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        found: dict[bytes, list[np.ndarray]] = {t: [] for t in wanted}
        lo, hi = (int(starts[0]), int(ends.max())) if self.n else (0, 0)
        for a in range(lo, hi, block):
            low = fold[raw[a : min(a + block + 2, hi)]]
            if len(low) < 3 or not wanted:
                continue
            at = np.flatnonzero(first[low[:-2]] & second[low[1:-1]])
            code = low[at].astype(np.uint32) << 16 | low[at + 1].astype(np.uint32) << 8 | low[at + 2]
            slot = np.searchsorted(codes, code)
            slot[slot == len(codes)] = 0
            hit = codes[slot] == code
            at, slot = at[hit] + a, slot[hit]
            row = np.searchsorted(ends, at, side="right")
            inside = row < self.n
            row, at, slot = row[inside], at[inside], slot[inside]
            inside = (at >= starts[row]) & (at + 3 <= ends[row])
            row, slot = row[inside], slot[inside]
            for k in np.unique(slot):
                found[wanted[k]].append(np.unique(row[slot == k]))
        self.lists = {t: np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for t, x in found.items()}

    def find(self, query: Query) -> np.ndarray:
        """Sorted rows that meet the query."""
        if query[0] == "all":
            return np.arange(self.n)
        if query[0] == "tri":
            return self.lists[query[1]]
        parts = sorted(map(self.find, query[1:]), key=len)
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def _verifier(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    pattern, group, least = rule.pattern, rule.group, rule.least
    if group == 0 and re.fullmatch(r"\[[^\]]+\]\+", pattern):
        # maximal runs of one class: those that are too short need not be found first
        find = re.compile(f"{pattern[:-1]}{{{max(1, least)},}}").finditer
        return lambda text: [m.span() for m in find(text)]
    find = re.compile(pattern).finditer
    return lambda text: [m.span() for m in find(text) if m.end(group) - m.start(group) >= least]


def scan(batch_text: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text the matches (start, rule's place, end), in order."""
    raw, starts, ends = utf8_column(batch_text)
    queries = [trigram_query(r.pattern) for r in rules]
    index = Postings(raw, starts, ends, set().union(*map(trigrams, queries)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts))]
    wanted: dict[int, list[int]] = {}
    for k, q in enumerate(queries):
        for row in index.find(q).tolist():
            wanted.setdefault(row, []).append(k)
    check = [_verifier(r) for r in rules]
    view = memoryview(raw)
    for row, ks in wanted.items():
        if ends[row] > starts[row]:
            text = str(view[starts[row] : ends[row]], "utf-8", "replace")
            for k in ks:
                out[row] += [(a, k, b) for a, b in check[k](text)]
    for x in out:
        x.sort()
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "spans") -> DataFrame:
    """One row per text with ``spans`` (or the name ``out``): an array of (kind, start, end) in code points, end exclusive, by start, then the rules' order.

    Each Arrow batch is a segment of the index: its postings for the trigrams of the rules' queries are intersected, and the
    regex itself decides on the candidates, over the whole text. A rule without a mandatory trigram scans every text.
    The index takes in every trigram a rule can ask for, so no match is lost.

    Null and empty texts have no spans; repeated rows are each scanned; an empty table gives an empty result. Only ``id_col``,
    ``text_col`` and ``keep`` are read, so other columns can't clash.
    """
    kinds = [r.kind for r in rules]
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    fields = [f for f in taken.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", spans array<struct<kind:string,start:int,end:int>>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = scan(part.column("_text"), rules)
                spans = pa.array([[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in found], span_type)
                rest = [f.name for f in fields]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [spans], names=rest + ["spans"])

    found = taken.mapInArrow(run, schema)
    return found.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{c}").alias(c) for c in keep), F.col("spans").alias(out))


def digest_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base kinds and the joined spans of ``find_secrets``."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col, *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``find_secrets`` reports replaced by ``mark``; overlapping spans get one mark. Other texts, and all other columns, stay as they are.

    A text is scanned and written anew in one pass over its spans, so the time grows with its length, however many secrets it has.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                column = part.column(place)
                found = scan(column, rules)
                if any(found):
                    texts = [_without(t, spans, mark) if spans else t for t, spans in zip(column.to_pylist(), found)]
                    part = part.set_column(place, part.schema.field(place), pa.array(texts, column.type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def _without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans (start, kind, end; by start) as one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
