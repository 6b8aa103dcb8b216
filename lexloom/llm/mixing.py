"""Mixing sources to target weights: hash-random order, distributed prefix sums and exact cuts; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_rows, settle

#: A table of at most so many sources is broadcast.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Adds ``target`` to ``totals`` (``source``, ``source_size``; a row for each source).

    Sources in order of code points, null last, weigh ``weights`` in turn, and share the sum of all sizes. A target stops at
    ``cap`` times the source's size; the excess is shared again by weight. The level L at which sum(min(cap * size, weight * L))
    meets the total is found in one pass over the sources by rising cap * size / weight: L is where the first k of them stop.
    Ranks and sums over the sources are made by ranges, so a table of millions of sources is no single task's.
    """
    table = F.array(*map(F.lit, weights))
    ranked = _running(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weighed = ranked.withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).drop("rank")
    rising = _running(weighed, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], {"k": F.lit(1), "before": F.col("source_size"), "lighter": F.col("weight")})
    total, heaviest = rising.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - F.lit(cap) * F.col("before")) / (F.lit(heaviest) - F.col("lighter"))
    fits = rising.withColumn("level", level).where(F.col("source_size") * F.lit(cap) >= F.col("weight") * F.col("level"))
    found = fits.agg(F.min(F.struct("k", "level"))["level"]).first()[0]
    return rising.select(*totals.columns, F.least((F.col("source_size") * F.lit(cap)).cast("double"), F.col("weight") * F.lit(0.0 if found is None else found)).alias("target"))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all rows before, in ``order``: sorted within ranges, plus the sums of the ranges before. The last window runs over the ranges alone."""
    ranged = settle(rows.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id()} | {f"_{k}": v.cast("long") for k, v in sums.items()}))
    whole = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(F.col("_range").alias("_r")).agg(*(F.sum(f"_{k}").alias(k) for k in sums))
    starts = ranges.select("_r", *(F.coalesce(F.sum(k).over(whole), F.lit(0)).alias(f"_start_{k}") for k in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(starts, F.col("_range") == F.col("_r"))
    return placed.select(*rows.columns, *((F.col(f"_start_{k}") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0))).alias(k) for k in sums))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Says how many words of each row a mix takes in which each source gets its target.

    A row's key is the MD5 of ``seed`` and its id: hash-random, and the same on a rerun. Within a source rows stand in the
    order of their keys, cut by ranges of the key into buckets of about equal size; running sums within buckets, plus the
    sums of the buckets before, place every row. A source with target t and size S is taken floor(t / S) times in whole, and
    of one more pass the first words up to floor(t) in all, so the row at the cut gives only a part.

    Returns ``id_col``, ``source_col``, ``text_key`` (xxhash64 of the text), ``size``, ``source_size``, ``target``, ``taken``,
    one row for each row of ``docs``. Null texts have size 0; a null source is a source of its own; rows of one id are
    ordered by text; equal rows are interchangeable. An empty table gives an empty result. Other columns are not read.
    """
    slim = settle(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("text_key"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        )
    )
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = settle(source_targets(totals, weights, cap).withColumn("n_buckets", F.ceil(F.col("n") / bucket_rows(F.col("n")))))
    small = sources.count() <= BROADCAST_SOURCES
    narrow = sources.select(F.col("source").alias("s"), "source_size", "target", "n_buckets")
    unit = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    placed = slim.join(F.broadcast(narrow) if small else narrow, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.floor(unit * F.col("n_buckets")))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        placed.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("sum"))
        .select("s", "b", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("bucket_start"))
    )
    running = Window.partitionBy("source", "bucket").orderBy("key", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.col("row_start")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor("target") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return (
        placed.withColumn("row_start", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole copy, then one with the words that are left over, if there are any.

    Rows with equal id, source and text are interchangeable. What ``mix_sources`` takes of them is summed, and dealt to them in turn, by whole texts as
    far as it goes, so the words of a source add up to its budget exactly. The row at a source's cut has its first words, joined by single spaces; all
    others have their texts unchanged.
    """
    keys = ["_mix_id", "_mix_source", "_mix_key"]
    mixed = (
        mix_sources(docs, weights, cap, seed, id_col, text_col, source_col)
        .select(F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), F.col("text_key").alias("_mix_key"), "size", "taken")
        .groupBy(*keys).agg(F.first("size").alias("_mix_size"), F.sum("taken").alias("_mix_sum"), F.count(F.lit(1)).alias("_mix_rows")).where("_mix_sum > 0")
    )
    mixed = settle(mixed)
    names = [F.col(c) for c in docs.columns]
    rows = docs.withColumns({"_mix_row_key": F.xxhash64(text_col), "_mix_task": F.spark_partition_id()}).join(
        mixed, F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_row_key") == F.col("_mix_key"))
    )
    one = rows.where("_mix_rows = 1").withColumn("_mix_nth", F.lit(0).cast("long"))
    if not mixed.where("_mix_rows > 1").isEmpty():
        # numbers among equal rows: within each task's share of them, plus the shares before; kept, so that both counts see the same shares
        equal = settle(rows.where("_mix_rows > 1"))
        share = Window.partitionBy(*keys, "_mix_task").orderBy(F.lit(0))
        earlier = Window.partitionBy(*keys).orderBy("_mix_task").rowsBetween(Window.unboundedPreceding, -1)
        starts = equal.groupBy(*keys, "_mix_task").count().withColumn("_mix_start", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        starts = starts.select(*(F.col(c).alias(f"{c}_s") for c in (*keys, "_mix_task")), "_mix_start")
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_s")) for c in (*keys, "_mix_task")))
        several = equal.withColumn("_mix_at", F.row_number().over(share) - 1).join(starts, same).withColumn("_mix_nth", F.col("_mix_start") + F.col("_mix_at"))
        one = one.unionByName(several.select(*one.columns))
    size, total, n = F.col("_mix_size"), F.col("_mix_sum"), F.col("_mix_rows")
    each = F.floor(total / (n * size)) * size
    over = total - each * n - F.col("_mix_nth") * size
    taken = one.withColumn("_mix_taken", each + F.greatest(F.lit(0), F.least(size, over))).where("_mix_taken > 0")
    times = F.sequence(F.lit(0), (F.ceil(F.col("_mix_taken") / F.col("_mix_size")) - 1).cast("int"))
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_mix_left").cast("int"))
    return (
        taken.withColumn("_mix_copy", F.explode(times)).withColumn("_mix_left", F.col("_mix_taken") - F.col("_mix_copy") * F.col("_mix_size"))
        .withColumn(text_col, F.when(F.col("_mix_left") >= F.col("_mix_size"), F.col(text_col)).otherwise(F.array_join(words, " ")))
        .select(*names)
    )
