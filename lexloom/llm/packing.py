"""Best-fit packing: documents as token sequences, put into as few bins as bin completion finds."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_rows, settle

Pattern = tuple[tuple[int, int], ...]  # ((size, times), ...), largest size first
Plan = list[tuple[Pattern, int]]  # patterns and how many bins have each


# --- bin completion over a histogram of sizes ---------------------------------------------------------------------


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: Martello and Toth's bound, the greatest over thresholds k of big items, plus what can't lie beside them."""
    best = -(-sum(s * n for s, n in sizes.items()) // capacity)
    order = sorted(sizes)
    for k in [0, *(s for s in order if s <= capacity // 2)]:
        above = sum(n for s, n in sizes.items() if s > capacity - k)
        upper = [(s, n) for s, n in sizes.items() if capacity // 2 < s <= capacity - k]
        middle = sum(s * n for s, n in sizes.items() if k <= s <= capacity // 2)
        count = sum(n for _, n in upper)
        room = count * capacity - sum(s * n for s, n in upper)
        best = max(best, above + count + max(0, -(-(middle - room) // capacity)))
    return best


def best_fit(sizes: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing, for all items of a size at once: the fullest bins that have room take as many as they hold."""
    room: dict[int, list[tuple[Pattern, int]]] = {}
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        for r in sorted(x for x in room if x >= size):
            if not left:
                break
            groups, kept = room.pop(r), []
            for pattern, bins in groups:
                each = r // size
                full = min(bins, left // each)
                left -= full * each
                rest = bins - full
                if full:
                    room.setdefault(r - each * size, []).append(((*pattern, (size, each)), full))
                if rest and 0 < left < each:
                    room.setdefault(r - left * size, []).append(((*pattern, (size, left)), 1))
                    left, rest = 0, rest - 1
                if rest:
                    kept.append((pattern, rest))
            if kept:
                room.setdefault(r, []).extend(kept)
        each = capacity // size
        if left >= each:
            room.setdefault(capacity - each * size, []).append((((size, each),), left // each))
        if left % each:
            room.setdefault(capacity - left % each * size, []).append((((size, left % each),), 1))
    return [g for groups in room.values() for g in groups]


def _dominated(chosen: list[int], skipped: list[int], spare: int) -> bool:
    """Whether an item that was left out fits in place of chosen ones that are no larger in sum: the filling with it is at least as good."""
    sums = {0}
    for x in chosen:
        sums |= {s + x for s in sums}
    ordered = sorted(sums)
    for item in skipped:
        at = bisect_right(ordered, item)
        if at > 1 and item - ordered[at - 1] <= spare:
            return True
    return False


def completions(sizes: dict[int, int], order: list[int], largest: int, capacity: int, slack: int, most: int = 64, steps: int = 400) -> list[Pattern]:
    """Undominated fillings around one item of size ``largest`` that waste at most ``slack``, least waste first.

    ``order``: the sizes at hand, ascending. A size's number of items is chosen in one step, the greatest first, so a filling takes as
    many steps as it has sizes. A single item that fills the room exactly dominates every other filling. ``most`` fillings and
    ``steps`` steps are the documented search limits; the first filling found is the greedy one.
    """
    room = capacity - largest
    have = dict(sizes)
    have[largest] -= 1
    below = [0]  # what the sizes before each place hold in all
    for s in order:
        below.append(below[-1] + s * have[s])
    found: dict[Pattern, int] = {}
    # a state: room left, the index below which sizes may be chosen (or, with a number of items to try, that size's), chosen and skipped sizes
    stack: list[tuple[int, int, int | None, Pattern, tuple[int, ...]]] = [(room, bisect_right(order, room), None, (), ())]
    while stack and len(found) < most and steps > 0:
        steps -= 1
        left, at, times, chosen, skipped = stack.pop()
        if times is None:
            at = min(at, bisect_right(order, left)) - 1
            while at >= 0 and not have[order[at]]:
                at -= 1
        if at < 0:
            items = [s for s, k in chosen for _ in range(k)] if sum(k for _, k in chosen) <= 12 else []
            if left <= slack and not (len(items) == sum(k for _, k in chosen) and _dominated(items, [s for s in skipped if s <= room], left)):
                counts = dict(chosen)
                counts[largest] = counts.get(largest, 0) + 1
                found.setdefault(tuple(sorted(counts.items(), reverse=True)), left)
            continue
        size = order[at]
        top = min(have[size], left // size)
        if times is None:
            times = top
        fewer = times - 1 - (times * size == left)  # one item that fills the room left exactly is as good as any others there
        if fewer >= 0 and left - fewer * size - below[at] <= slack:
            stack.append((left, at, fewer, chosen, skipped))
        if size == left and not chosen and times:
            found = {}
            stack.clear()
        stack.append((left - times * size, at, None, (*chosen, (size, times)) if times else chosen, (*skipped, size) if times < top else skipped))
    return sorted(found, key=lambda p: (found[p], [-s for s, _ in p]))


def bin_completion(sizes: dict[int, int], capacity: int, nodes: int = 4000) -> Plan:
    """Packs items given as {size: count}: depth-first branch and bound over fillings of the bin with the largest item left.

    The incumbent is best fit decreasing's packing, and the search ends once the lower bound is met. A branch is cut if its bins plus
    the bound of what is left can't beat the incumbent; the waste that a branch may still afford limits the fillings tried. A
    filling is used for as many bins at once as the counts allow (then for fewer, if that is a handful), so the steps to a
    packing depend on the number of sizes, not of items: each use exhausts a size for that multiplicity, and sizes are at most
    ``capacity``. ``nodes`` bounds the search, not the result: at its end the best packing so far is returned, and every item is in it.
    """
    sizes = {s: n for s, n in sizes.items() if n}
    if not sizes:
        return []
    if min(sizes) < 1 or max(sizes) > capacity:
        raise ValueError("sizes must be from 1 to the capacity")
    best = best_fit(sizes, capacity)
    count = sum(n for _, n in best)
    goal = lower_bound(sizes, capacity)
    left = dict(sizes)
    order = sorted(left)
    total = sum(s * n for s, n in left.items())
    used = 0
    path: list[tuple[Pattern, int]] = []

    def choices() -> list[tuple[Pattern, int]]:
        slack = (count - 1 - used) * capacity - total
        if not order or slack < 0:
            return []
        out = []
        for pattern in completions(left, order, order[-1], capacity, slack):
            top = min(left[s] // k for s, k in pattern)
            # as many bins as the waste allows: each costs capacity - its fill
            waste = capacity - sum(s * k for s, k in pattern)
            top = min(top, slack // waste) if waste else top
            out += [(pattern, n) for n in ([top, *range(top - 1, 0, -1)] if top <= 4 else [top]) if n > 0]
        return out

    def put(pattern: Pattern, n: int, sign: int) -> None:
        nonlocal total, used
        for s, k in pattern:
            before = left.get(s, 0)
            left[s] = before - sign * n * k
            if left[s] == 0:
                order.remove(s)
            elif before == 0:
                order.insert(bisect_right(order, s), s)
        total -= sign * n * sum(s * k for s, k in pattern)
        used += sign * n

    frames = [iter(choices())]
    while frames and count > goal and nodes > 0:
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            if path:
                put(*path.pop(), -1)
            continue
        nodes -= 1
        put(*step, 1)
        path.append(step)
        if not order:
            if used < count:
                best, count = list(path), used
            put(*path.pop(), -1)
        elif used + -(-total // capacity) >= count:
            put(*path.pop(), -1)
        else:
            frames.append(iter(choices()))
    return best


# --- tokens and the distributed assignment ----------------------------------------------------------------------


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks_path: str, special: dict[str, int]):
    """The byte-level BPE of ``byte_bpe_50k.json``: the same vocabulary and ids, read as ranks, which encodes several times faster."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_pieces(docs: DataFrame, capacity: int = 2048, ranks_path: str | None = None, special: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``: each text's ids and a closing 0, in pieces of at most ``capacity``.

    Only longer documents are cut, all pieces but the first of exactly ``capacity``. Null texts count as empty, and have just the 0.
    """
    special = {"<|endoftext|>": 50256} if special is None else special
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = taken.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks_path or default_ranks(), special)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    ids = np.array([*coder.encode(text or "", allowed_special="all"), 0], "<u4")
                    n = len(ids)
                    k = -(-n // capacity)
                    cut = n - (k - 1) * capacity
                    marks = [0, *range(cut, n + 1, capacity)]
                    for j in range(k):
                        rows.append(i)
                        piece.append(j)
                        start.append(marks[j])
                        length.append(marks[j + 1] - marks[j])
                        crc.append(zlib.crc32(ids[marks[j] : marks[j + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["_id", "piece", "start", "length", "ids_crc32"],
                )

    found = taken.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long")
    return found.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32")


def places(plan: Plan, capacity: int) -> tuple[np.ndarray, ...]:
    """For each size and pattern that holds it, in order of size: the key of the first item (its rank within its size, plus
    size * 2**44), the times a bin holds it, the first bin's number, and the offset of the first one in its bin."""
    rows, ranks, first = [], {}, 0
    for pattern, bins in plan:
        offset = 0
        for size, times in pattern:
            rank = ranks.get(size, 0)
            rows.append(((size << 44) + rank, times, first, offset))
            ranks[size] = rank + bins * times
            offset += size * times
        first += bins
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def pack(docs: DataFrame, capacity: int = 2048, ranks_path: str | None = None, special: dict[str, int] | None = None, nodes: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents' pieces into sequences of at most ``capacity`` tokens; adds ``sequence_id`` and ``offset`` to ``token_pieces``.

    Items of a size are alike, so the histogram of lengths (at most ``capacity`` rows, whatever the input) is all that bin
    completion needs; it runs on the driver and gives patterns of bins with counts, whose number the capacity bounds too. An
    item's rank among those of its length then gives its bin and place. Ranks are counted in hash-random buckets of each length, plus
    the sizes of the buckets before, so that a frequent length is spread over many tasks.

    The pieces are kept in the shared folder once made, so a lost executor can't number them anew. Null and empty texts are one token.
    Equal rows are packed one by one; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, capacity, ranks_path, special, id_col, text_col).withColumnRenamed(id_col, "_id"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(bin_completion(histogram, capacity, nodes), capacity)
    # from Arrow: a list would be copied by Python workers of another kind, which stay beside those at work
    counts = pa.table({"l": pa.array(list(histogram), pa.int64()), "n": pa.array(list(histogram.values()), pa.int64())})
    n = spark.createDataFrame(counts).select("l", F.ceil(F.col("n") / bucket_rows(F.col("n"))).alias("n_buckets"))
    salted = pieces.join(F.broadcast(n), F.col("length") == F.col("l")).select(
        *pieces.columns, F.pmod(F.xxhash64("_id", "piece", "start", "ids_crc32"), F.col("n_buckets")).alias("salt")
    )
    before = Window.partitionBy("l").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(F.col("length").alias("l"), F.col("salt").alias("s")).count().select("l", "s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("length", "salt").orderBy("_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
        .select(*pieces.columns, (F.col("bucket_start") + F.col("nth")).alias("rank"))
    )
    names = ranked.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1]) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, first, offset = table
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            key = (size << 44) + rank
            at = np.searchsorted(keys, key, side="right") - 1
            nth = key - keys[at] if len(key) else key
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(first[at] + nth // times[at]), pa.array(offset[at] + nth % times[at] * size)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
