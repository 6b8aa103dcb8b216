"""Approximate nearest neighbours: randomly rotated one-bit codes, whose error bounds choose the vectors to rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import settle
from .vectors import by_length, is_usable, kind, scale

#: Most vectors and bytes of a block of the index, queries estimated at once, and bits of a query's components.
BLOCK, BLOCK_BYTES, QUERIES, QUERY_BITS = 4096, 1 << 22, 256, 4
#: The cells of a length are fitted on about SAMPLE rows, chosen by hash (FEW if it has but one cell); there is one for each BLOCK rows, up to CELLS. RINGS: parts of the half circle by which a cell is cut.
SAMPLE, FEW, CELLS, RINGS = 20_000, 256, 1024, 16


def rotate(x: np.ndarray, seed: int = 17) -> np.ndarray:
    """Rows turned at random in the least power of two of dimensions, 64 at least, that holds them: three rounds of random signs and a Hadamard transform."""
    size = max(64, 1 << (x.shape[1] - 1).bit_length())
    signs = np.random.default_rng(seed).integers(0, 2, (3, size)) * 2.0 - 1
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for s in signs:
        out *= s
        step = 1
        while step < size:
            pairs = out.reshape(len(x), -1, 2, step)
            low, high = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
            pairs[:, :, 0], pairs[:, :, 1] = low, high
            step *= 2
        out /= np.sqrt(size)
    return out


def encode(unit: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-bit codes (64-bit words) of the directions from the centre, and the correction scalars: the distance from the
    centre, the code's inner product with the direction, and the vector's inner product with the centre."""
    rest = unit - centre
    norm = np.sqrt((rest * rest).sum(axis=1))
    turned = rotate(rest / np.maximum(norm, 1e-30)[:, None])
    bits = turned >= 0
    words = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    align = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return words, np.stack([norm, align, unit @ centre], axis=1)


def estimate(query: np.ndarray, centre: np.ndarray, words: np.ndarray, scalars: np.ndarray, surety: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of the queries with the coded vectors, and how far the truth may be off.

    A query's turned direction is cut to QUERY_BITS bits a component, so that its product with a code is a sum of counted bits.
    """
    d = words.shape[1] * 64
    rest = query - centre
    norm = np.sqrt((rest * rest).sum(axis=1))
    turned = rotate(rest / np.maximum(norm, 1e-30)[:, None])
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-30)
    cut = np.rint((turned - low) / step).astype(np.uint8)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    counted = np.zeros((len(query), len(words)))
    for j in range(QUERY_BITS):
        plane = np.packbits((cut >> j) & 1, axis=1, bitorder="little").view("<u8")
        for w in range(words.shape[1]):
            counted += np.bitwise_count(plane[:, w, None] & words[None, :, w]) * float(1 << j)
    # the code's components are +-1 / sqrt(d)
    product = (2 * (step * counted + low * ones) - (step * cut.sum(axis=1, keepdims=True, dtype=np.int64) + low * d)) / np.sqrt(d)
    size, align, along = scalars.T
    align = np.maximum(align, 1e-12)
    reach = norm[:, None] * size[None, :]
    wide = surety * np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(max(1, d - 1)) + step * np.sqrt(d) / 2 / align / np.sqrt(d)
    return reach * product / align + along[None, :] + (query @ centre)[:, None] - centre @ centre, reach * wide


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of so many cells of unit vectors, by spherical k-means from evenly spaced rows; a cell that loses all its rows keeps its centre."""
    at = np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(np.int64)
    centres = sample[at].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        some = size > 1e-9
        centres[some] = sums[some] / size[some, None]
    return centres


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def search(vectors: DataFrame, is_query, k: int = 5, surety: float = 3.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows by cosine found for each row that meets ``is_query``.

    Every usable row is indexed. Vectors of a length are dealt to cells by their nearest centre (``fit_cells``, on a sample of about SAMPLE rows of a length),
    and within a cell to rings of the angle to the centre; a ring's rows are cut into blocks of one-bit codes of what is left after the centre,
    with their correction scalars and the original vectors. A query first meets its own block, whose k-th best cosine is a floor for
    all that follows. It then goes to each ring that may hold anything as near, which by the angles to the centre is certain for no other; every
    block of the index gets the queries that it is asked by, and is sent once. Of a block only those vectors are reranked whose upper bound is
    not below the floor and the k-th greatest lower bound; ``surety`` widens the bounds (3: a bound fails about once in a thousand). Scores are exact cosines in
    double precision of the original vectors; ties go to the smaller id. At most k rows of each block and query leave a task.

    A row is never its own neighbour, but other rows of its id are. The cosine is only defined for vectors of one length, so candidates are those of
    the query's length; all lengths are searched. Vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or as
    candidates. Empty tables give empty results; other columns are not read.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    id_type, id_arrow = source.schema["id"].dataType.simpleString(), to_arrow_type(source.schema["id"].dataType)
    dtype = kind(source.schema["vector"].dataType)
    item = np.dtype(dtype).itemsize
    rows = source.where(is_usable(F.col("vector")))
    counts = {r[0]: r[1] for r in rows.groupBy(F.size("vector")).count().collect()}  # one row for each length
    wanted = {d: min(1.0, (SAMPLE if n >= 2 * BLOCK else FEW) / n) for d, n in counts.items()}
    share = F.coalesce(*(F.when(F.size("vector") == d, F.lit(x)) for d, x in wanted.items() if x < 1), F.lit(1.0))
    unit_hash = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    gathered: dict[int, list] = {}
    for (vector,) in rows.where(unit_hash < share).select("vector").toLocalIterator() if counts else ():
        gathered.setdefault(len(vector), []).append(vector)
    centres = {d: fit_cells(scale(np.array(gathered[d], np.float64)), max(1, min(CELLS, n // BLOCK))) if d in gathered else np.eye(1, d) for d, n in counts.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column("vector")):
                angle = _angles(scale(x), centres[d])
                cell = np.argmin(angle, axis=1)
                ring = np.minimum(RINGS - 1, np.floor(angle[np.arange(len(x)), cell] / np.pi * RINGS)).astype(np.int32)
                packed = pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), batch.column("asks").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(ring), packed],
                    names=["id", "asks", "d", "cell", "ring", "packed"],
                )

    order = ["d", "cell", "ring", F.xxhash64("id"), "id"]
    placed = rows.mapInArrow(place, f"id {id_type}, asks boolean, d int, cell int, ring int, packed binary").repartitionByRange(*order).sortWithinPartitions(*order)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            d, cell, ring = (table.column(c)[0].as_py() for c in ("d", "cell", "ring"))
            packed = b"".join(table.column("packed").to_pylist())
            words, scalars = encode(scale(np.frombuffer(packed, dtype).astype(np.float64).reshape(-1, d)), centres[d][cell])
            seq += 1
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int32()) for x in (d, cell, ring)), pa.array([(part << 28) + seq]), pa.array([table.column("id").to_pylist()], pa.list_(id_arrow)), pa.array([table.column("asks").to_pylist()], pa.list_(pa.bool_())),
                 *(pa.array([z], pa.binary()) for z in (packed, words.tobytes(), scalars.tobytes()))], names=["d", "cell", "ring", "block", "ids", "asks", "packed", "words", "scalars"])

        def full(table: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
            held.clear()
            names = [table.column(c).to_numpy() for c in ("d", "cell", "ring")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            runs = [0, *cuts.tolist(), table.num_rows]
            for a, b in zip(runs[:-1], runs[1:]):
                size = min(BLOCK, max(16, BLOCK_BYTES // (item * int(names[0][a]))))
                for at in range(a, b, size):
                    if b == table.num_rows and b - at < size and not end:
                        held.append(table.slice(at, b - at))
                        return
                    yield emit(table.slice(at, min(size, b - at)))

        for batch in batches:
            if batch.num_rows:
                yield from full(pa.concat_tables([*held, pa.Table.from_batches([batch])]), False)
        if held:
            yield from full(pa.concat_tables(held), True)

    blocks = settle(placed.mapInArrow(index, f"d int, cell int, ring int, block long, ids array<{id_type}>, asks array<boolean>, packed binary, words binary, scalars binary"))
    # a block's number in its ring, from the number of the ring's blocks in the range partitions before
    ring = ["d", "cell", "ring"]
    task = F.shiftright("block", 28)
    runs = settle(blocks.groupBy(*ring, task.alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("first")))
    before = F.sum("n").over(Window.partitionBy(*ring).orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*ring, "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    numbered = blocks.withColumn("task", task).join(starts, [*ring, "task"]).withColumn("number", F.col("start") + F.col("block"))
    rings: dict[int, list] = {}
    for r in runs.groupBy(*ring).agg(F.sum("n")).collect():  # CELLS * RINGS rows at most for each length
        rings.setdefault(r[0], []).append(r[1:])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chosen = np.flatnonzero(np.array(batch.column("asks")[r].as_py(), bool))
                d, block, ids = (batch.column(c)[r].as_py() for c in ("d", "block", "ids"))
                raw = np.frombuffer(batch.column("packed")[r].as_py(), dtype).reshape(-1, d)
                x = scale(raw.astype(np.float64))
                cells, ring_, number = (np.array(c) for c in zip(*rings[d]))
                for a in range(0, len(chosen), QUERIES):
                    at = chosen[a : a + QUERIES]
                    score = x[at] @ x.T
                    score[np.arange(len(at)), at] = -np.inf
                    floor = np.partition(score, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(at), -np.inf)
                    angle = _angles(x[at], centres[d])[:, cells]
                    low, high = ring_ / RINGS * np.pi, (ring_ + 1) / RINGS * np.pi
                    nearest = np.maximum(0, np.maximum(low - angle, angle - high))  # the least angle to anything in the ring
                    visit = np.cos(nearest) >= floor[:, None] - 1e-9
                    targets = [[{"cell": c, "ring": g, "blocks": m} for c, g, m in zip(cells[v].tolist(), ring_[v].tolist(), number[v].tolist())] for v in visit]
                    kinds = pa.list_(pa.struct([("cell", pa.int32()), ("ring", pa.int32()), ("blocks", pa.int64())]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array([ids[i] for i in at], id_arrow), pa.array(floor), pa.array([z.tobytes() for z in raw[at]], pa.binary()), pa.array(targets, kinds)],
                        names=["d", "q_block", "q_row", "query_id", "floor", "packed", "targets"],
                    )

    asked = blocks.where(F.exists("asks", lambda x: x)).select("d", "block", "ids", "asks", "packed").mapInArrow(ask, f"d int, q_block long, q_row int, query_id {id_type}, floor double, packed binary, targets array<struct<cell int, ring int, blocks long>>")
    asked = asked.withColumn("target", F.explode("targets")).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("target.blocks") - 1)))
    none = lambda t: F.lit(None).cast(t)
    queries = asked.select("d", F.col("target.cell").alias("cell"), F.col("target.ring").alias("ring"), "number", F.lit(1).alias("side"), F.col("q_block").alias("block"), "q_row", "query_id", "floor", "packed", none(f"array<{id_type}>").alias("ids"), none("binary").alias("words"), none("binary").alias("scalars"))
    index_side = numbered.select("d", "cell", "ring", "number", F.lit(0).alias("side"), "block", none("int").alias("q_row"), none(id_type).alias("query_id"), none("double").alias("floor"), "packed", "ids", "words", "scalars")
    spread = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(x[2] for v in rings.values() for x in v) // 16)
    target = ["d", "cell", "ring", "number"]
    dealt = index_side.unionByName(queries).repartition(spread, *target).sortWithinPartitions(*target, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for batch in batches:
            side = batch.column("side").to_numpy()
            at = 0
            while at < len(side):
                if side[at] == 0:
                    get = lambda c: batch.column(c)[at].as_py()  # noqa: B023, E731
                    d, ids = get("d"), get("ids")
                    now = {"d": d, "block": get("block"), "ids": ids, "centre": centres[d][get("cell")], "x": scale(np.frombuffer(get("packed"), dtype).astype(np.float64).reshape(-1, d))}
                    now |= {"words": np.frombuffer(get("words"), "<u8").reshape(len(ids), -1), "scalars": np.frombuffer(get("scalars")).reshape(len(ids), 3)}
                    place = np.empty(len(ids), np.int64)  # in the order of ids, null last
                    place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))  # noqa: B023
                    now["place"] = place
                    at += 1
                    continue
                ends = np.flatnonzero(side[at:] == 0)
                stop = min(at + (int(ends[0]) if len(ends) else len(side) - at), at + QUERIES)
                yield from meet(now, batch.slice(at, stop - at))
                at = stop

    def meet(now: dict, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, ids, d = now["x"], now["ids"], now["d"]
        q = scale(np.frombuffer(b"".join(part.column("packed").to_pylist()), dtype).astype(np.float64).reshape(-1, d))
        q_block, q_row, floor = (part.column(c).to_numpy() for c in ("block", "q_row", "floor"))
        guess, wide = estimate(q, now["centre"], now["words"], now["scalars"], surety)
        own = np.flatnonzero(q_block == now["block"])
        guess[own, q_row[own]] = -np.inf
        lower = guess - wide
        top = min(k, len(x))
        least = np.maximum(np.partition(lower, len(x) - top, axis=1)[:, len(x) - top], floor - 1e-12)
        maybe = (guess + wide >= least[:, None]) & (guess > -np.inf)
        which, who, scores = [], [], []
        for i in range(len(q)):
            near = np.flatnonzero(maybe[i])
            score = x[near] @ q[i]
            near, score = near[score >= floor[i] - 1e-12], score[score >= floor[i] - 1e-12]
            best = np.lexsort((now["place"][near], -score))[:k]
            which += [i] * len(best)
            who += [ids[j] for j in near[best]]
            scores += score[best].tolist()
        if which:
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [part.column("query_id").take(take), part.column("block").take(take), part.column("q_row").take(take), pa.array(who, id_arrow), pa.array(scores)],
                names=["query_id", "q_block", "q_row", "vec_id", "score"],
            )

    near = dealt.mapInArrow(compare, f"query_id {id_type}, q_block long, q_row int, vec_id {id_type}, score double")
    best = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
