"""Embedding near-dedup: an epsilon grid order join on the leading principal dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .components import components
from .vectors import by_length, is_usable, kind, scale

#: Leading principal dimensions of the grid, the most vectors and bytes of a block, blocks of an interval, and parts of one in a step of the recursion.
AXES, BLOCK, BLOCK_BYTES, FAN = 8, 1024, 1 << 20, 8
#: Principal axes are taken of so many leading components at most: distances there are never greater than the whole ones.
SPAN = 1024
_POSITION = 12  # bits of a vector's place in its block


def principal_axes(rows: DataFrame, axes: int = AXES, vector_col: str = "vector") -> dict[int, np.ndarray]:
    """For each length the leading eigenvectors of the covariance of all its unit vectors, as columns (zeros beyond their number). Sums are made per task, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                u = scale(x)[:, :SPAN]
                k = u.shape[1]
                total.setdefault(d, np.zeros(k * k + k + 1))
                total[d] += np.concatenate([(u.T @ u).ravel(), u.sum(axis=0), [len(u)]])
        for d, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d)), pa.array(np.arange(len(x))), pa.array(x)], names=["d", "i", "x"])

    def solve(table: pa.Table) -> pa.Table:
        d = table.column("d")[0].as_py()
        k = min(d, SPAN)
        x = np.zeros(k * k + k + 1)
        x[table.column("i").to_numpy()] = table.column("x").to_numpy()
        mean = x[k * k : -1] / x[-1]
        _, vectors = np.linalg.eigh(x[: k * k].reshape(k, k) / x[-1] - np.outer(mean, mean))
        out = np.zeros((k, axes))
        out[:, : min(axes, k)] = vectors[:, ::-1][:, : min(axes, k)]
        return pa.table({"d": pa.array([d], pa.int64()), "axes": pa.array([out.tobytes()], pa.binary())})

    sums = rows.select(vector_col).mapInArrow(run, "d long, i long, x double").groupBy("d", "i").agg(F.sum("x").alias("x"))
    found = sums.groupBy("d").applyInArrow(solve, "d long, axes binary").collect()  # at most SPAN * axes numbers for each length that occurs
    return {r["d"]: np.frombuffer(r["axes"]).reshape(-1, axes) for r in found}


def _sorted_blocks(rows: DataFrame, base: dict[int, np.ndarray], axes: int, eps: float, dtype: str) -> DataFrame:
    """Blocks of neighbours in the grid order of their group: keys, numbers of copies, packed vectors and the box of their leading coordinates."""
    width = np.dtype(dtype).itemsize

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column("vector")):
                y = scale(x)[:, :SPAN] @ base[d]
                cells = np.floor(y / eps).astype(np.int32)
                packed = [r.tobytes() for r in x.astype(dtype)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in ("grp", "key", "copies")), pa.array(np.full(len(at), d, np.int32)), pa.array(packed, pa.binary()), pa.array(list(y), pa.list_(pa.float64())), *(pa.array(cells[:, k]) for k in range(axes))],
                    names=["grp", "key", "copies", "d", "packed", "y", *(f"c{k}" for k in range(axes))],
                )

    cell_names = [f"c{k}" for k in range(axes)]
    cells = rows.mapInArrow(grid, "grp string, key binary, copies long, d int, packed binary, y array<double>, " + ", ".join(f"{c} int" for c in cell_names))
    # within a cell by the key, a hash: a crowded cell is cut anywhere
    order = ["grp", *cell_names, "key"]
    ranged = cells.repartitionByRange(*order).sortWithinPartitions(*order).select("grp", "key", "copies", "d", "packed", "y")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def emit(block: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            y = np.array(block.column("y").to_pylist())
            seq += 1
            first = lambda c: block.column(c).slice(0, 1).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [first("grp"), pa.array([(part << 28) + seq]), first("d"), pa.array([block.column("key").to_pylist()], pa.list_(pa.binary())), pa.array([block.column("copies").to_pylist()], pa.list_(pa.int64())),
                 pa.array([b"".join(block.column("packed").to_pylist())], pa.binary()), pa.array([y.min(axis=0)], pa.list_(pa.float64())), pa.array([y.max(axis=0)], pa.list_(pa.float64()))],
                names=["grp", "block", "d", "keys", "copies", "packed", "lo", "hi"],
            )

        def full(table: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
            """All blocks of ``table`` that are complete; keeps the rest."""
            held.clear()
            groups = table.column("grp").combine_chunks().dictionary_encode().indices.to_numpy() if table.num_rows else np.empty(0)
            runs = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1), table.num_rows]
            for a, b in zip(runs[:-1], runs[1:]):
                size = max(16, min(BLOCK, BLOCK_BYTES // (width * table.column("d")[int(a)].as_py()))) if b > a else BLOCK
                size = min(size, BLOCK)
                done = end or b < table.num_rows
                for k in range(a, b, size):
                    if not done and b - k < size:
                        held.append(table.slice(k, b - k))
                        return
                    yield emit(table.slice(k, min(size, b - k)))

        for batch in batches:
            yield from full(pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks(), False)
        if held:
            yield from full(pa.concat_tables(held).combine_chunks(), True)

    return ranged.mapInArrow(chunk, "grp string, block long, d int, keys array<binary>, copies array<long>, packed binary, lo array<double>, hi array<double>")


def _apart(p: int, eps: float) -> Column:
    """The least squared distance of two boxes in the leading coordinates; further parts of the distance only add to it."""
    gap = lambda k: F.greatest(F.lit(0.0), F.col("b_lo")[k] - F.col("a_hi")[k], F.col("a_lo")[k] - F.col("b_hi")[k])
    return reduce(lambda x, y: x + y, (gap(k) * gap(k) for k in range(p))) > eps * eps * (1 + 1e-9) + 1e-12


def _intervals(boxes: DataFrame, p: int) -> DataFrame:
    """The boxes of the intervals of FAN boxes."""
    low = [F.min(F.col("lo")[k]) for k in range(p)]
    high = [F.max(F.col("hi")[k]) for k in range(p)]
    return boxes.groupBy("grp", F.floor(F.col("nth") / FAN).alias("nth")).agg(F.array(*low).alias("lo"), F.array(*high).alias("hi"))


def _near_pairs(boxes: DataFrame, p: int, eps: float) -> DataFrame:
    """Pairs a <= b of boxes of a group that may hold linked vectors: intervals of the order are split in parts and joined from the top."""
    levels = [boxes.select("grp", "nth", "lo", "hi")]
    top = boxes.agg(F.max("nth")).first()[0]
    while top:
        top //= FAN
        levels.append(_intervals(levels[-1], p))
    pairs = levels[-1].select("grp", F.col("nth").alias("a"), F.col("nth").alias("b"))
    for level in reversed(levels[:-1]):
        child = lambda side: level.select(
            F.col("grp").alias("g"), F.floor(F.col("nth") / FAN).alias(side), F.col("nth").alias(f"{side}_nth"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi")
        )
        a, b = child("a"), child("b")
        pairs = (
            pairs.join(a, (pairs["grp"] == a["g"]) & (pairs["a"] == a["a"])).select("grp", pairs["b"], "a_nth", "a_lo", "a_hi")
            .join(b, (F.col("grp") == b["g"]) & (pairs["b"] == b["b"]))
            .where((F.col("a_nth") <= F.col("b_nth")) & ~_apart(p, eps))
            .select("grp", F.col("a_nth").alias("a"), F.col("b_nth").alias("b"))
        )
    return pairs


class _Tile:
    """Two intervals of blocks, or one with itself: links are counted for each vector, and joined to the least vector reached."""

    def __init__(self, least: float, eps: float):
        self.least, self.eps = least, eps
        self.held: list[tuple] = []  # blocks of the first interval
        self.uids, self.counts, self.size = [], [], 0
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, block: int, x: np.ndarray, copies: np.ndarray, lo: np.ndarray, hi: np.ndarray, second: bool, alone: bool) -> None:
        own = (self.size, scale(x), copies, lo, hi)
        self.uids.append((block << _POSITION) + np.arange(len(x)))
        self.counts.append(np.zeros(len(x), np.int64))
        self.size += len(x)
        if not second:
            self.held.append(own)
        if second or alone:
            for k, other in enumerate(self.held):
                self._compare(k, other, len(self.counts) - 1, own)

    def _compare(self, k: int, a: tuple, n: int, b: tuple) -> None:
        gap = np.maximum(0, np.maximum(b[3] - a[4], a[3] - b[4]))
        if gap @ gap > self.eps**2 * (1 + 1e-9) + 1e-12:
            return
        hit = a[1] @ b[1].T >= self.least
        same = a[0] == b[0]
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.counts[k] += hit @ b[2]
        if not same:
            self.counts[n] += a[2] @ hit
        i, j = np.nonzero(hit)
        root = _roots(i, j + (0 if same else len(a[1])), len(a[1]) + (0 if same else len(b[1])))
        at = np.flatnonzero(root != np.arange(len(root)))
        place = lambda r: np.where(r < len(a[1]), r + a[0], r - len(a[1]) + b[0])
        self.edges.append((place(at), place(root[at])))

    def result(self) -> pa.RecordBatch | None:
        if not self.edges:
            return None
        uid, count = np.concatenate(self.uids), np.concatenate(self.counts)
        root = _roots(*(np.concatenate(x) for x in zip(*self.edges)), self.size)
        some = count > 0
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(count[some]), pa.array(uid[root[some]])], names=["uid", "links", "root"])


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of n nodes that each reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def join_similar(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", axes: int = AXES) -> DataFrame:
    """Links vectors of equal labels and lengths with cosine >= ``least``; ``id_col``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Equal vectors of a label are one vector with a number of copies, so that a crowd of copies costs no more than one row. Unit
    vectors with that cosine are at most eps = sqrt(2 - 2 * least) apart. Vectors are sorted by label, length and the cells, eps wide, of their
    leading principal coordinates, and cut into blocks; intervals of blocks are joined recursively, and those whose boxes are
    more than eps apart are skipped. The last pairs of intervals are tiles: a task holds one interval's blocks and runs the other's past
    them, each pair of blocks being skipped if it is far apart, or else compared in double precision on the original
    components. What leaves a tile is a count and the least linked vector for each vector, never a row for each pair.

    The cosine of vectors of different lengths isn't defined, so they don't link; no length is left out. Rows with a null label, or a vector that
    is null, empty, zero or with null or non-finite components, link with nothing. Rows of one id are vectors of their own; ``component_id`` is the
    least id in the component, and all rows of that id are ``kept``. Empty tables give empty results; other columns are not read.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    usable = F.col("label").isNotNull() & is_usable(F.col("vector"))
    group = F.concat(F.size("vector"), F.lit(":"), F.col("label").cast("string"))
    rows = source.where(usable).withColumn("grp", group).withColumn("key", F.unhex(F.md5(F.concat(F.to_json(F.transform("vector", lambda x: x + F.lit(0.0).cast(source.schema["vector"].dataType.elementType))), F.col("grp")))))
    unlike = settle(rows.groupBy("key").agg(F.first("grp").alias("grp"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id")))
    eps = float(np.sqrt(max(0.0, 2 - 2 * least)))
    base = principal_axes(unlike, axes)
    dtype = kind(source.schema["vector"].dataType)
    blocks = settle(_sorted_blocks(unlike, base, axes, max(eps, 1e-9), dtype))
    # a block's number within its group, from the number of the group's blocks in the range partitions before
    task = F.shiftright("block", 28)
    runs = blocks.groupBy("grp", task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("first"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(F.col("grp").alias("g"), F.col("task").alias("t"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    boxes = blocks.join(starts, (F.col("grp") == F.col("g")) & (task == F.col("t"))).select("grp", "block", "lo", "hi", (F.col("start") + F.col("block")).alias("nth"))
    boxes = settle(boxes)
    tiles = settle(_near_pairs(_intervals(boxes, axes), axes, eps))
    part = boxes.select("block", F.floor(F.col("nth") / FAN).alias("part"))
    whole = part.join(blocks.drop("keys"), "block").withColumnRenamed("grp", "g")
    side = lambda pairs, c, second: pairs.join(whole, (F.col("grp") == F.col("g")) & (F.col(c) == F.col("part"))).select("grp", "a", "b", F.lit(second).alias("second"), "block", "d", "copies", "packed", "lo", "hi")
    work = side(tiles, "a", False).unionByName(side(tiles.where("a != b"), "b", True))
    spread = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles.count() // 4)
    dealt = work.repartition(spread, "grp", "a", "b").sortWithinPartitions("grp", "a", "b", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, name = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                if (now := (get("grp"), get("a"), get("b"))) != name:
                    if tile and (out := tile.result()):
                        yield out
                    tile, name = _Tile(least, eps), now
                x = np.frombuffer(get("packed"), dtype).astype(np.float64).reshape(-1, get("d"))
                tile.add(get("block"), x, np.array(get("copies")), np.array(get("lo")), np.array(get("hi")), get("second"), now[1] == now[2])
        if tile and (out := tile.result()):
            yield out

    found = settle(dealt.mapInArrow(compare, "uid long, links long, root long"))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    members = blocks.select("block", F.posexplode("keys").alias("pos", "key")).select("key", (F.shiftleft("block", _POSITION) + F.col("pos")).alias("uid"))
    linked = members.join(counts, "uid").join(comp, F.col("uid") == F.col("node")).join(unlike.select("key", "least_id"), "key").select("key", "links", "component", "least_id")
    least_ids = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(least_ids, "component").select(F.col("key").alias("k"), "links", "component_id")
    known = settle(unlike.select("key", "copies", "least_id").join(named, F.col("key") == F.col("k"), "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("k").isNotNull(), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")
    ))
    joined = rows.select("id", "key").join(known, "key").select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    single = source.where(~usable).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return joined.unionByName(single)
