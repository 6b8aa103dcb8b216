"""Suffix-array dedup: bytes covered by long strings that start anywhere else, by merging the Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import utf8_column
from .common import settle, stash, unstash
from .minhash import _powers, mix

#: Bytes of the k-gram at an anchor, bytes read at once, and distinct blocks of a key that are merged in one task; a key with more is made narrower.
GRAM, CHUNK, CROWD = 24, 1 << 20, 4096
PAD = 255
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of v[p : p + w] for each p, in three passes."""
    n = len(v) - w + 1
    padded = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    padded[: len(v)] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Sparse suffixes of the texts: row, anchor, first and last start of its strings (from the text's start), key and block hash.

    Each string of ``least`` bytes belongs to one anchor, the leftmost k-gram of least hash within it. The choice depends on nothing
    but the string, so equal strings belong to anchors of equal keys at equal distance. An anchor's strings start at
    neighbouring places; the bytes they cover are its block. No text is cut: one longer than CHUNK is read in overlapping pieces.
    """
    gram = min(gram, least)
    w = least - gram + 1
    up, down = _powers(CHUNK + least + 1)
    out: list[tuple[np.ndarray, ...]] = []

    def read(lo: int, hi: int, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Bytes lo to hi; string starts of rows[i] from begin[i] to before end[i]."""
        text = raw[lo:hi]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], dtype=np.uint64)])
        g = mix((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
        owner = _sliding_least(g & ~_PLACE | np.arange(len(g), dtype=np.uint64), w) & _PLACE
        marks = np.zeros(len(owner) + 1, np.int32)
        np.add.at(marks, begin - lo, 1)
        np.add.at(marks, end - lo, -1)
        valid = np.cumsum(marks[:-1]) > 0
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | ~valid[:-1]
        new[begin - lo] = True
        first = np.flatnonzero(valid & new)
        last = np.ones(len(owner), bool)
        last[:-1] = new[1:] | ~valid[1:]
        final = np.flatnonzero(valid & last)
        a = owner[first].astype(np.int64)
        row = rows[np.searchsorted(begin - lo, first, side="right") - 1]
        whole = mix((sums[final + least] - sums[first]) * down[first])
        shape = mix((a - first).astype(np.uint64) << np.uint64(32) | (final - first).astype(np.uint64))
        base = lo - starts[row]
        out.append((row, a + base, first + base, final + base, g[a], mix(whole ^ shape)))

    size = ends - starts
    fit = np.flatnonzero(size >= least)
    k = 0
    while k < len(fit):
        r = fit[k]
        if size[r] > CHUNK:
            for at in range(int(starts[r]), int(ends[r]) - least + 1, CHUNK):
                stop = min(at + CHUNK, int(ends[r]) - least + 1)
                read(at, stop + least - 1, np.array([r]), np.array([at]), np.array([stop]))
            k += 1
            continue
        j = k
        while j < len(fit) and ends[fit[j]] - starts[r] <= CHUNK:
            j += 1
        rows = fit[k:j]
        read(int(starts[r]), int(ends[rows[-1]]), rows, starts[rows], ends[rows] - least + 1)
        k = j
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out))


class Transform:
    """The Burrows-Wheeler transform of aligned blocks: for each place, counted from the left of the longest, the rows' symbols in the order of what stands before.

    ``columns[c]`` holds the symbol at place c of every row, the rows in the order of their prefixes read from place c - 1 backwards,
    equal ones as they were given. Dealing a column's rows stably by symbol is the last-to-first step to the next column. PAD, a byte that UTF-8 never
    has, stands beyond a block's ends. ``left``: bytes before the anchor.
    """

    def __init__(self, columns: np.ndarray, left: int):
        self.columns, self.left = columns, left

    @classmethod
    def of(cls, data: list[bytes], before: np.ndarray) -> Transform:
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        left = int(before.max())
        columns = np.full((left + int((sizes - before).max()), len(data)), PAD, np.uint8)
        row = np.repeat(np.arange(len(data)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns[at + np.repeat(left - before, sizes), row] = np.frombuffer(b"".join(data), np.uint8)
        if len(data) > 1:
            order = np.arange(len(data))
            for c in range(len(columns)):
                columns[c] = columns[c][order]
                order = order[np.argsort(columns[c], kind="stable")]
        return cls(columns, left)


def merge_transforms(group: np.ndarray, shards: list[Transform], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of ``least`` bytes occur in two rows of a group at least: the row and the string's place from the anchor (negative: left of it).

    ``group``: that of each shard's transform, ascending; rows count through the shards in turn. The transforms of a group's shards are merged by
    refining their interleave, which says whose row comes next: it starts as one shard after the other, and each pass takes every
    shard's next column, reads the symbols in the order of the interleave, and deals its places stably by symbol. A shard's own rows are never
    sorted again. Beside the interleave goes the place from which each row agrees with the one above it: after a pass that is
    the greatest among the rows between two that stay together. Rows that agree on ``least`` bytes are a repeated interval.
    """
    count = np.array([t.columns.shape[1] for t in shards])
    left = max(t.left for t in shards)
    width = left + max(len(t.columns) - t.left for t in shards)
    n = int(count.sum())
    columns = np.full((width, n), PAD, np.uint8)
    for t, at in zip(shards, np.cumsum(count) - count):
        columns[left - t.left : left - t.left + len(t.columns), at : at + t.columns.shape[1]] = t.columns
    narrow = np.uint16 if len(shards) < 1 << 16 else np.uint32
    rank = np.repeat(np.cumsum(np.diff(group, prepend=group[:1]) != 0), count).astype(narrow)  # a group keeps its places throughout
    whose = np.repeat(np.arange(len(shards)), count).astype(narrow)
    order, since = np.arange(n), np.zeros(n, np.int64)
    symbol = np.empty(n, np.uint8)
    found_row, found_at = [], []
    for c in range(width):
        symbol[np.argsort(whose, kind="stable")] = columns[c]
        deal = np.argsort(symbol, kind="stable")
        deal = deal[np.argsort(rank[deal], kind="stable")]
        whose, order, dealt = whose[deal], order[deal], symbol[deal]
        same = np.zeros(n, bool)
        same[1:] = (rank[1:] == rank[:-1]) & (dealt[1:] == dealt[:-1]) & (dealt[1:] != PAD)
        new_since = np.full(n, c + 1, np.int64)
        pick = np.flatnonzero(same)
        if len(pick):
            lo, hi = deal[pick - 1] + 1, deal[pick] + 1
            near = hi - lo == 1
            new_since[pick[near]] = since[lo[near]]
            if not near.all():
                ends = np.stack([lo[~near], hi[~near]], axis=1).ravel()
                new_since[pick[~near]] = np.maximum.reduceat(np.append(since, 0), ends)[::2]
        since = new_since
        hit = np.flatnonzero(c + 1 - since >= least)
        if len(hit):
            rows = np.unique(np.concatenate([order[hit], order[hit - 1]]))
            found_row.append(rows)
            found_at.append(np.full(len(rows), c + 1 - least - left))
    if not found_row:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_row), np.concatenate(found_at)


def _runs_of(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places of a row as runs: row, first and last place."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)]))
    return row[new], at[new], at[np.append(new[1:], len(row)) - 1]


_SHARD = "key long, n int, left int, roots binary, before binary, columns binary"


def _cells(values: np.ndarray, kind: str) -> list[bytes]:
    return [x.tobytes() for x in values.astype(kind)]


def _packed(roots: np.ndarray, before: np.ndarray, data: list[bytes]) -> tuple:
    """A shard's blocks of one key: their number, the transform, and for each block its root (key, block, place in it) and the bytes before its anchor."""
    t = Transform.of(data, before)
    return len(data), t.left, roots.astype("<i8").tobytes(), before.astype("<i4").tobytes(), t.columns.tobytes()


def _shard_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["key", "n", "left", "roots", "before", "columns"])


def _repeated_runs(shards: DataFrame, least: int) -> DataFrame:
    """Repeated strings of all keys in ``shards``, as runs of places x to y in the root blocks."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, n, left = (table.column(c).to_numpy() for c in ("key", "n", "left"))
        parts = [Transform(np.frombuffer(x, np.uint8).reshape(-1, k), a) for x, k, a in zip(table.column("columns").to_pylist(), n.tolist(), left.tolist())]
        row, at = merge_transforms(key, parts, least)
        if len(row):
            roots = np.frombuffer(b"".join(table.column("roots").to_pylist()), "<i8").reshape(-1, 3)
            before = np.frombuffer(b"".join(table.column("before").to_pylist()), "<i4")
            row, x, y = _runs_of(row, at)
            shift = before[row] + roots[row, 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(roots[row, 0]), pa.array(roots[row, 1]), pa.array((x + shift).astype(np.int32)), pa.array((y + shift).astype(np.int32))], names=["key", "block", "x", "y"]
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                held.append(pa.Table.from_batches([part]))
                count += int(part.column("n").to_numpy().sum())
                if count >= 16_384:
                    table = pa.concat_tables(held)
                    key = table.column("key").to_numpy()
                    edge = int(np.searchsorted(key, key[-1]))
                    if edge:
                        yield from solve(table.slice(0, edge))
                    held, count = [table.slice(edge)], int(table.column("n").to_numpy()[edge:].sum())
        if count:
            yield from solve(pa.concat_tables(held))

    return shards.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "key long, block long, x int, y int")


def _as_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as shards of one block."""
    for batch in batches:
        if batch.num_rows:
            r_key, r_block, shift, before = (batch.column(c).to_numpy() for c in ("r_key", "r_block", "shift", "a_off"))
            roots = np.stack([r_key, r_block, shift], axis=1)
            yield _shard_batch([*zip(batch.column("key").to_pylist(), repeat(1), before.tolist(), _cells(roots, "<i8"), _cells(before, "<i4"), batch.column("data").to_pylist())])


def _narrower(blocks: DataFrame, least: int, level: int, widest: int) -> DataFrame:
    """Blocks of crowded keys, cut by the place of the anchor in a string, and under narrower keys.

    At level l a string's place of the anchor is known up to ``widest`` >> l, and all bytes that the strings of such a part have in common are the key. Which part
    and key a string gets depends on the string alone, so equal strings stay together, and rows of unequal cores are parted. When the place is known
    exactly, the core is the whole string, and equal keys mean equal strings.
    """
    step = max(1, widest >> level)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r_key, r_block, shift, a, data in zip(*(batch.column(c).to_pylist() for c in ("r_key", "r_block", "shift", "a_off", "data"))):
                for part in range((a - len(data) + least) // step, a // step + 1):
                    low, high = part * step, min(part * step + step - 1, least - min(GRAM, least))  # the anchor's places in the strings of this part
                    x, y = max(0, a - high), min(len(data) - least, a - low)
                    core = data[a - low : a - high + least]
                    piece = data[x : y + least]
                    out.append((_hash(core, part), _hash(piece, a - x), r_key, r_block, shift + x, a - x, piece))
            if out:
                kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.binary(),)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["key", "block", "r_key", "r_block", "shift", "a_off", "data"])

    return blocks.mapInArrow(cut, _PIECE)


_PIECE = "key long, block long, r_key long, r_block long, shift int, a_off int, data binary"


def _hash(data: bytes, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little", signed=True)


def _digest(text: bytes, spans: list[tuple[int, int]], least: int) -> tuple[int, int, str]:
    """Removed bytes and runs, and the hash of what stays; spans: first and last starts of repeated strings."""
    removed = runs = 0
    at, kept = 0, hashlib.sha256()
    reach = -1
    for a, b in sorted(spans):
        if a > reach:
            if reach >= 0:
                at = reach
            kept.update(text[at:a])
            runs += 1
            removed += b + least - a
            reach = b + least
        elif b + least > reach:
            removed += b + least - reach
            reach = b + least
    kept.update(text[max(reach, 0) :])
    return removed, runs, kept.hexdigest()


def remove_repeats(docs: DataFrame, least: int = 200, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (array of removed [start, end) in bytes) for each row.

    A byte is removed if a string of ``least`` bytes that covers it also starts anywhere else, in this text or another one; strings
    never cross texts. Whole texts are read, and nothing is sampled.

    1. Every task reads its shard and keeps a sparse order of its suffixes: only those at anchors (``anchors``), by key and block.
    2. Keys that occur once, and they are most, have no repeated string. If all blocks of a key are equal, all their strings are
       repeated. Both are told by counts that are summed before the shuffle.
    3. For a key with different blocks, each shard makes the Burrows-Wheeler transform of its own ones (``Transform``), and the shards' transforms
       are merged by refining their interleave (``merge_transforms``), which gives common prefixes and repeated intervals, as runs.
    4. A key with more than ``crowd`` distinct blocks is first made narrower (``_narrower``): its blocks are cut in two by the anchor's place in
       a string, and more of what those strings have in common becomes the key, until its keys fit a task. Then they are merged like all others.
    5. A text's repeated strings come back to it, and are taken out together.

    Null texts count as empty. Texts shorter than ``least`` bytes are kept whole. Repeated rows are copies of each other, and so lose
    all that is in such strings. Empty tables give empty results; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("name", F.unhex(F.md5("text")))
    id_type = source.schema["id"].dataType.simpleString()
    long_ones = source.where(F.octet_length("text") >= least)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = utf8_column(batch.column("text"))
            step = 2000
            for at in range(0, len(starts), step):
                row, a, lo, hi, key, block = anchors(raw, starts[at : at + step], ends[at : at + step], least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").take(pa.array(row + at)), *(pa.array(x.astype(np.int32)) for x in (a, lo, hi)), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in (key, block))],
                    names=["name", "a", "lo", "hi", "key", "block"],
                )

    marked = long_ones.select("name", "text").mapInArrow(mark, "name binary, a int, lo int, hi int, key long, block long")
    keys = stash(
        marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("x"), F.max("block").alias("y"))
        .where("n > 1").select("key", (F.col("x") != F.col("y")).alias("mixed"))
    )
    some = stash(marked.join(keys, "key").select("name", "a", "lo", "hi", "key", "block", "mixed"))
    mixed = some.where("mixed")
    blocks = stash(mixed.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "a", "lo", "hi")).alias("at")).select("key", "block", "n", "at.*"))
    crowds = stash(blocks.groupBy("key").count().where(F.col("count") > crowd).select("key", F.lit(True).alias("crowded")))

    # the text that gives the bytes of a block is one row's: of those with that text the one whose id has the least hash
    who = F.unhex(F.md5(F.concat(F.hex("name"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    wanted = stash(
        blocks.join(crowds, "key", "left").groupBy("name").agg(F.collect_list(F.struct("key", "block", "a", "lo", "hi", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("parts"))
        .join(long_ones.groupBy("name").agg(F.min(who).alias("who")), "name").select("who", "parts")
    )
    held = long_ones.select(who.alias("who"), "text").join(wanted, "who").dropDuplicates(["who"]).select("text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                texts, parts = batch.column("text").slice(k, 1000), batch.column("parts").slice(k, 1000)
                sizes = parts.value_lengths().to_numpy()
                flat = parts.flatten()
                key, block, a, lo, hi, crowded = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "a", "lo", "hi", "crowded"))
                data: list[bytes] = []
                for text, size in zip(texts.to_pylist(), sizes.tolist()):
                    text, at = text.encode(), len(data)
                    data += [text[x : y + least] for x, y in zip(lo[at : at + size].tolist(), hi[at : at + size].tolist())]
                order = np.lexsort((block, key))
                roots = np.stack([key, block, np.zeros(len(key), np.int64)], axis=1)
                before = a - lo
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | crowded[order][1:]
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(order))
                lone = order[starts[ends - starts == 1]]  # a transform of one block is the block
                several = [order[x:y] for x, y in zip(starts.tolist(), ends.tolist()) if y - x > 1]
                rows = [(int(key[p[0]]), *_packed(roots[p], before[p], [data[i] for i in p])) for p in several]
                rows += zip(key[lone].tolist(), repeat(1), before[lone].tolist(), _cells(roots[lone], "<i8"), _cells(before[lone], "<i4"), [data[i] for i in lone])
                if rows:
                    out = _shard_batch(rows)
                    big = np.append(np.zeros(len(several), bool), crowded[lone])
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(big)], names=[*out.schema.names, "crowded"])

    pieces = stash(held.mapInArrow(cut, _SHARD + ", crowded boolean"))
    found = [blocks.where("n > 1").select("key", "block", F.lit(0).alias("x"), (F.col("hi") - F.col("lo")).alias("y"))]
    found.append(_repeated_runs(pieces.where("NOT crowded").drop("crowded"), least))
    used = [keys, some, blocks, crowds, wanted, pieces]

    if not crowds.isEmpty():
        widest = 1 << max(0, least - min(GRAM, least)).bit_length()

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                roots = np.frombuffer(b"".join(batch.column("roots").to_pylist()), "<i8").reshape(-1, 3)
                before = np.frombuffer(b"".join(batch.column("before").to_pylist()), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), *(pa.array(roots[:, i]) for i in (1, 0, 1)), pa.array(roots[:, 2].astype(np.int32)), pa.array(before), batch.column("columns")],
                    names=["key", "block", "r_key", "r_block", "shift", "a_off", "data"],
                )

        rest = pieces.where("crowded").drop("crowded").mapInArrow(single, _PIECE)
        level = 0
        while True:
            level += 1
            parts = stash(_narrower(rest, least, level, widest))
            each = stash(parts.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r_key", "r_block", "shift", "a_off", "data")).alias("at")).select("key", "block", "n", "at.*"))
            many = stash(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
            copies = each.where("n > 1").select(F.col("key").alias("k"), F.col("block").alias("b"))
            found.append(
                parts.join(copies, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")))
                .select(F.col("r_key").alias("key"), F.col("r_block").alias("block"), F.col("shift").alias("x"), (F.col("shift") + F.octet_length("data") - least).alias("y"))
            )
            used += [parts, each, many]
            last = level >= widest.bit_length()
            near = each.join(many if last else many.where(F.col("m") <= crowd), "key")
            found.append(_repeated_runs(near.mapInArrow(_as_shards, _SHARD), least))
            if last or many.where(F.col("m") > crowd).isEmpty():
                break
            rest = each.join(many.where(F.col("m") > crowd), "key").select("key", "block", "r_key", "r_block", "shift", "a_off", "data")

    every = reduce(DataFrame.unionByName, found)
    spans = stash(every.groupBy("key", "block").agg(F.collect_set(F.struct("x", "y")).alias("parts")))
    back = mixed.select("name", "lo", F.col("key").alias("k"), F.col("block").alias("b")).join(spans, (F.col("k") == F.col("key")) & (F.col("b") == F.col("block")))
    back = back.select("name", "lo", F.explode("parts").alias("p")).select("name", (F.col("lo") + F.col("p.x")).alias("x"), (F.col("lo") + F.col("p.y")).alias("y"))
    each = stash(some.where("NOT mixed").select("name", F.col("lo").alias("x"), F.col("hi").alias("y")).unionByName(back).groupBy("name").agg(F.collect_set(F.struct("x", "y")).alias("parts")))

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = utf8_column(batch.column("text"))
            rows = []
            parts = batch.column("parts")
            for r in range(batch.num_rows):
                text = raw[starts[r] : ends[r]].tobytes()
                found = []
                if parts[r].is_valid:
                    values = parts[r].values
                    found = list(zip(values.field("x").to_pylist(), values.field("y").to_pylist()))
                rows.append((len(text), *_digest(text, found, least), _runs(found, least)))
            a, b, c, e, s = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(e, pa.string()), pa.array(s, pa.list_(pa.list_(pa.int64())))],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    answer = source.join(each.withColumnRenamed("name", "e_name"), F.col("name") == F.col("e_name"), "left").select("id", "text", "parts")
    answer = settle(answer.mapInArrow(take_out, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"))
    unstash(*used, spans, each)
    return answer.withColumnRenamed("id", id_col)


def _runs(spans: list[tuple[int, int]], least: int) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + least)
        else:
            out.append([a, b + least])
    return out
