"""Joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, squeeze

#: A lookup table of at most so many rows and bytes is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: A lookup of keys by bits of at most so many bytes is broadcast.
BIT_BYTES = 32 << 20


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the table's rows and bytes, which are checked, allow it; beyond that the join is left to adaptive execution."""
    rows, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= most_bytes else df


_AT, _BIT = "shiftright(CAST(`{0}` AS BIGINT), 6)", "CAST(`{0}` & 63 AS INT)"


def _bits(codes: DataFrame, n: int) -> DataFrame | None:
    """A row of ``n`` masks for each 64 keys that lie side by side (``key``, ``code``: from 0, below ``n``); None if there are too many such rows to broadcast, as they are few only where keys lie close."""
    mask = F.expr(f"shiftleft(1L, {_BIT.format('key')})")
    made = codes.where("key IS NOT NULL").groupBy(F.expr(_AT.format("key")).alias("_at")).agg(*(F.coalesce(F.bit_or(F.when(F.col("code") == i, mask)), F.lit(0)).cast("long").alias(f"_m{i}") for i in range(n)))
    most = BIT_BYTES // (8 * (n + 3))
    return made if made.limit(most + 1).count() <= most else None


def _looked_up(rows: DataFrame, key: str, bits: DataFrame, n: int, name: str) -> DataFrame:
    own = F.array(*(F.when(F.expr(f"getbit(_m{i}, {_BIT.format(key)})") == 1, F.lit(i).cast("byte")) for i in range(n)))
    found = rows.join(F.broadcast(bits), F.expr(_AT.format(key)) == F.col("_at"))
    return found.select(*rows.columns, F.explode(own).alias(name)).where(F.col(name).isNotNull())


def with_codes(rows: DataFrame, key: str, codes: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` with ``name``, once for each different code of their ``key`` (an integer), without those that have none. ``codes``: key, code (from 0, below ``n``).

    Codes are looked up by bits, so that ``rows`` stay where they are; where the bits are too many, it is a join.
    """
    bits = _bits(codes, n)
    if bits is None:
        return rows.join(codes.select(F.col("key").alias("_key"), F.col("code").cast("byte").alias(name)).distinct(), F.col(key) == F.col("_key")).drop("_key")
    return _looked_up(rows, key, bits, n, name)


def without_strangers(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` before a join with ``keys`` (key): without those that it would drop, if that is told by bits without moving rows; else as they are."""
    bits = _bits(keys.select("key", F.lit(0).alias("code")), 1)
    return rows if bits is None else _looked_up(rows, key, bits, 1, "_own").drop("_own")


def shares_keys(rows: DataFrame, key: str) -> bool:
    """Whether different rows have the same ``key`` (an integer). Where there are as many bits as rows in each 64 keys, none do; other rows are compared."""
    rows = rows.where(F.col(key).isNotNull()).withColumn("_at", F.expr(_AT.format(key)))
    crowded = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"), F.bit_or(F.expr(f"shiftleft(1L, {_BIT.format(key)})")).alias("_b")).where(F.col("_n") > F.bit_count("_b")).select("_at")
    return not crowded.isEmpty() and not rows.join(crowded, "_at", "left_semi").distinct().groupBy(key).count().where("count > 1").isEmpty()


def apply_map(df: DataFrame, mapping: DataFrame, keys: list[str], value: str, canonical: str) -> DataFrame:
    """``value`` as the ``canonical`` of the mapping with equal ``keys``; unchanged without one."""
    small = maybe_broadcast(mapping.select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col(canonical).alias("_canonical")))
    on = [F.col(k) == F.col(f"_m_{k}") for k in keys]
    joined = df.join(small, on, "left")
    return joined.withColumn(value, F.coalesce("_canonical", value)).drop("_canonical", *(f"_m_{k}" for k in keys))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Candidates that two providers share: mean confidence, summed evidence, and the first provider's texts unless blank."""
    joined = a.alias("a").join(b.alias("b"), keys)
    pick = lambda c: F.when(~blank(F.col(f"a.{c}")), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return joined.select(*keys, ((F.col("a.confidence") + F.col("b.confidence")) / 2).alias("confidence"), (F.col("a.evidence") + F.col("b.evidence")).alias("evidence"), *map(pick, texts))


def corpus_row(results: DataFrame, corpus: DataFrame, index: str, position: str, corpus_key: str) -> DataFrame:
    """Corpus columns by a valid index, else by position, else null."""
    key = F.coalesce(F.expr(f"try_cast(`{index}` as bigint)"), F.col(position).cast("bigint"))
    return results.withColumn("_k", key).join(corpus, F.col("_k") == F.col(corpus_key), "left").drop("_k")


def fill_metadata(df: DataFrame, lookup: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Fills blanks only, with each key's first lookup row in ``order``; ``conflicts`` counts its distinct later values."""
    first = Window.partitionBy(key).orderBy(order)
    best = lookup.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    clash = lookup.groupBy(F.col(key).alias("_q")).agg((F.count_distinct(F.struct(*columns)) - 1).alias("conflicts"))
    out = df.join(best, F.col(key) == F.col("_k"), "left").join(clash, F.col(key) == F.col("_q"), "left")
    for c in columns:
        out = out.withColumn(c, F.when(blank(F.col(c)), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.withColumn("conflicts", F.coalesce("conflicts", F.lit(0)).cast("long")).drop("_k", "_q", *(f"_{c}" for c in columns))


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")


def not_done(df: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    return df.join(checkpoint.select(key).distinct(), key, "left_anti")


def with_triples(corpus: DataFrame, triples: DataFrame, key: str) -> DataFrame:
    return corpus.join(triples.select(key).distinct(), key, "left_semi")


def validated_only(df: DataFrame, validated: DataFrame, key: str, applies: Column) -> DataFrame:
    """The restriction to validated keys, on those rows it applies to."""
    flags = validated.select(F.col(key).alias("_v")).distinct()
    return df.join(flags, F.col(key) == F.col("_v"), "left").where(~applies | F.col("_v").isNotNull()).drop("_v")


def segments(spans: DataFrame, lengths: DataFrame, doc: str) -> DataFrame:
    """The elementary intervals of each document with the mentions that cover them, in the order of label and id.

    ``spans``: doc, id, label, start, end; ``lengths``: doc, length. Boundaries are 0, the length and all ends of spans.
    """
    ends = spans.select(doc, F.explode(F.array("start", "end")).alias("point")).unionByName(lengths.select(doc, F.explode(F.array(F.lit(0), "length")).alias("point"))).distinct()
    pairs = ends.withColumn("to", F.lead("point").over(Window.partitionBy(doc).orderBy("point"))).where("to IS NOT NULL")
    s = spans.select(F.col(doc).alias("_d"), "id", "label", "start", "end")
    hit = pairs.join(s, (F.col(doc) == F.col("_d")) & (F.col("start") <= F.col("point")) & (F.col("end") >= F.col("to")), "left")
    active = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("label", F.col("id").cast("string").alias("id")))))
    return hit.groupBy(doc, "point", "to").agg(active.alias("_a")).select(doc, F.col("point").alias("start"), F.col("to").alias("end"), F.array_join("_a.id", ",").alias("active"))


def batch_outputs(requests: DataFrame, outputs: DataFrame, errors: DataFrame, key: str, default: str = "ERROR: no output") -> DataFrame:
    out = requests.join(outputs.select(key, F.col("output").alias("_o")), key, "left").join(errors.select(key, F.col("error").alias("_e")), key, "left")
    return out.withColumn("output", F.coalesce("_o", F.concat(F.lit("ERROR: "), F.col("_e")), F.lit(default))).drop("_o", "_e")


def by_title(a: DataFrame, b: DataFrame, a_title: str, b_title: str, evidence: Column) -> DataFrame:
    """Rows of ``a`` whose title is in ``b``, white space and case aside, with the evidence of all of them."""
    key = lambda c: F.lower(squeeze(F.col(c)))
    grouped = b.groupBy(key(b_title).alias("_t")).agg(F.sort_array(F.collect_list(evidence)).alias("evidence"))
    return a.join(grouped, key(a_title) == F.col("_t")).drop("_t")


def interleave(tables: list[DataFrame], order: list[str], key: str) -> DataFrame:
    """Row k of each table in turn, within each key; a longer table goes on alone. ``place`` is a row's place within its key."""
    parts = [t.withColumns({"_k": F.row_number().over(Window.partitionBy(key).orderBy(*order)), "_t": F.lit(i)}) for i, t in enumerate(tables)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return union.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_k", "_t"))).drop("_k", "_t")


def resolve_iri(df: DataFrame, value: str, terms: DataFrame, namespace: str) -> DataFrame:
    """``iri``: the value if absolute, else the term of that name, else the first in any case, else one made in ``namespace``. ``terms``: name, iri."""
    exact = maybe_broadcast(terms.groupBy(F.col("name").alias("_x")).agg(F.min("iri").alias("_xi")))
    loose = maybe_broadcast(terms.groupBy(F.lower("name").alias("_l")).agg(F.min_by("iri", "name").alias("_li")))
    made = F.concat(F.lit(namespace), F.regexp_replace(value, "[^A-Za-z0-9_]", ""))
    out = df.join(exact, F.col(value) == F.col("_x"), "left").join(loose, F.lower(value) == F.col("_l"), "left")
    return out.withColumn("iri", F.when(F.col(value).rlike("^https?://"), F.col(value)).otherwise(F.coalesce("_xi", "_li", made))).drop("_x", "_xi", "_l", "_li")


#: The most vectors of a block of a group, of which two at a time are compared, and numbers in it (but 16 vectors at least).
TILE, TILE_NUMBERS = 1024, 1 << 20


def similar_pairs(df: DataFrame, group: str, key: str, vector: str, least: float) -> DataFrame:
    """Pairs of a group with cosine of at least ``least``: the exact join. Each group is cut into blocks, and each pair of blocks is one product of matrices; what may reach
    ``least`` is then summed component by component in double precision. Null vectors and those with null components pair with nothing, and a zero vector's norm counts as 1."""
    usable = df.select(group, key, F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    usable = usable.withColumn("d", F.size("v"))
    counts = usable.groupBy(F.col(group).alias("_g"), F.col("d").alias("_d")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_n", F.ceil(F.col("_rows") / F.greatest(F.lit(16), F.least(F.lit(TILE), F.floor(F.lit(TILE_NUMBERS) / F.greatest("_d", F.lit(1)))))))
    placed = usable.join(maybe_broadcast(counts), (F.col(group) == F.col("_g")) & (F.col("d") == F.col("_d"))).withColumn("at", F.pmod(F.xxhash64(key), F.col("_n")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("o")
    tiles = placed.select(group, key, "v", "d", "at", other).select(group, key, "v", "d", "at", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        at, keys = table.column("at").to_numpy(), table.column(key).combine_chunks()
        d = table.column("d")[0].as_py()
        x = pc.list_flatten(table.column("v").combine_chunks()).to_numpy(zero_copy_only=False).reshape(len(at), d)

        def dots(a, b):
            total = np.zeros(len(a))
            for k in range(d):
                total += x[a, k] * x[b, k]
            return total

        with np.errstate(all="ignore"):
            norm = np.sqrt(dots(np.arange(len(at)), np.arange(len(at))))
            norm = np.where(norm == 0, 1.0, norm)
            odd = ~np.isfinite(norm) | (norm < 1e-100)  # what rounding could tell otherwise is always summed
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
            near = ~((x[left] @ x[right].T) / np.outer(norm[left], norm[right]) < least - 1e-6) | odd[left][:, None] | odd[right][None, :]
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            cos = dots(a, b) / (norm[a] * norm[b])
        hit = ~(cos < least)
        a, b, cos = a[hit], b[hit], cos[hit]
        first, second = keys.take(pa.array(a)), keys.take(pa.array(b))
        less = pc.less(first, second)
        more = pc.less(second, first) if i != j else pa.array(np.zeros(len(a), bool))  # within a block each pair comes in both orders
        label = table.column(group).combine_chunks().slice(0, 1)
        parts = [pa.table({"left_id": p.filter(m), "right_id": q.filter(m), "similarity": pa.array(cos).filter(m)}) for p, q, m in ((first, second, less), (second, first, more))]
        out = pa.concat_tables(parts)
        return out.add_column(0, group, label.take(pa.array(np.zeros(len(out), np.int64))))

    of = lambda c: df.schema[c].dataType.simpleString()
    return tiles.groupBy(group, "d", "i", "j").applyInArrow(compare, f"`{group}` {of(group)}, left_id {of(key)}, right_id {of(key)}, similarity double")
