"""MinHash near-dedup: BagMinHash signatures of word shingles as multisets, banded, and verified by their overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import utf8_column
from .common import settle, stash, unstash
from .components import components

#: Registers of a signature, and registers of a band: two texts of similarity 0.8 miss each other in all bands once in 20 million.
REGISTERS, ROWS = 128, 4
#: Of 128 one-bit registers a pair of similarity s differs in 64 (1 - s). Members that differ from their leader in more are not verified with it at first; they are compared later.
MOST_BITS = 36
#: The most members and features of a block of a family.
BLOCK_ROWS, BLOCK_FEATURES = 256, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        if n:
            p[0] = 1
        out.append(np.multiply.accumulate(p, dtype=np.uint64))
    return out[0], out[1]


def shingles(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts: text, 48-bit hash and count, in order of text and hash.

    Words are runs of bytes other than x20 and x09 to x0D, a shingle is ``width`` words in a row; a text of fewer words has
    one shingle, all its words.
    """
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if not len(starts) or int(ends.max(initial=0)) == 0:
        return none
    lo, hi = int(starts[0]), int(ends.max())
    text = raw[lo:hi]
    word = np.zeros(len(text) + 2, bool)
    word[1:-1] = ~((text == 32) | ((text >= 9) & (text <= 13)))
    edge = np.zeros(len(text) + 1, bool)  # texts follow each other without a gap
    edge[np.clip(starts - lo, 0, len(text))] = True
    begin = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    owner = np.searchsorted(ends - lo, begin, side="right")
    if not len(begin):
        return none
    up, down = _powers(len(text) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    words = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(np.append(first, len(owner)))
    n = np.maximum(1, count - width + 1)
    at = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(at + width, np.repeat(first + count, n))
    key = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < stop
        key = np.where(inside, mix(key * np.uint64(_BASE) + words[np.minimum(at + k, len(words) - 1)]), key)
    rows = np.repeat(owner[first], n)
    out_row, out_key, out_count = [], [], []
    step = 1 << 16
    for a in range(0, int(rows[-1]) + 1, step):  # 16 bits of text and 48 of hash in one word
        x, y = np.searchsorted(rows, [a, a + step])
        packed = np.sort((rows[x:y] - a).astype(np.uint64) << np.uint64(48) | key[x:y] >> np.uint64(16))
        new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.empty(0, np.int64)
        out_count.append(np.diff(np.append(new, len(packed))))
        out_row.append((packed[new] >> np.uint64(48)).astype(np.int64) + a)
        out_key.append(packed[new] & np.uint64((1 << 48) - 1))
    return np.concatenate(out_row), np.concatenate(out_key), np.concatenate(out_count)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures of n weighted sets (element ``key`` of set ``text`` has integer ``weight``); sets without elements get zeros.

    Each element stands for a Poisson process of rate 1 over time and over the weights above 0, that is split in the levels
    (0, 1], (1, 2], (2, 4], (4, 8], ... A point has a register and, within its level, a weight; it belongs to a set if that is within
    the element's weight. A register's value is the identity of its earliest point, so two sets agree in a register with a
    probability of exactly sum(min) / sum(max) of their weights. Points are made in the order of time and only up to the time by
    which a set's registers are likely full; sets with an empty register go on from there, to twice that time.
    """
    time = np.full((n, registers), np.inf)
    mark = np.zeros((n, registers), np.uint64)
    if not len(text):
        return mark
    total = np.bincount(text, weights=weight, minlength=n)
    limit = registers * (np.log(registers) + 2) / np.maximum(total, 1e-300)
    # levels of each element: 0 for (0, 1], j for (2**(j-1), 2**j]
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    at = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    owner, top = text[at], weight[at]
    seed = mix(key[at] ^ mix(level.astype(np.uint64)))
    clock = np.zeros(len(at))
    open_ = np.arange(len(at))
    waiting: list[np.ndarray] = []
    while True:
        while len(open_):
            seed[open_] = s = mix(seed[open_])
            clock[open_] += -np.log(_unit(s)) / width[open_]
            early = clock[open_] <= limit[owner[open_]]
            waiting.append(open_[~early])  # their next point lies beyond the limit
            open_ = open_[early]
            s = mix(s[early] ^ np.uint64(0xD6E8FEB86659FD93))
            inside = low[open_] + _unit(mix(s ^ np.uint64(1))) * width[open_] <= top[open_]
            _keep_first(time, mark, owner[open_[inside]], (s[inside] % np.uint64(registers)).astype(np.int64), clock[open_[inside]], s[inside])
        short = np.isinf(time).any(axis=1) & (total > 0)
        if not short.any():
            return mark
        limit[short] *= 2
        rest = np.concatenate(waiting)
        again = short[owner[rest]]
        waiting, rest = [rest[~again]], rest[again]
        # the points already drawn come first, then each process goes on
        now = clock[rest] <= limit[owner[rest]]
        waiting.append(rest[~now])
        open_ = rest[now]
        s = mix(seed[open_] ^ np.uint64(0xD6E8FEB86659FD93))
        inside = low[open_] + _unit(mix(s ^ np.uint64(1))) * width[open_] <= top[open_]
        _keep_first(time, mark, owner[open_[inside]], (s[inside] % np.uint64(registers)).astype(np.int64), clock[open_[inside]], s[inside])


def _keep_first(time: np.ndarray, mark: np.ndarray, row: np.ndarray, register: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    place = row * time.shape[1] + register
    flat, marks = time.reshape(-1), mark.reshape(-1)
    better = at < flat[place]
    place, at, value = place[better], at[better], value[better]
    np.minimum.at(flat, place, at)
    won = flat[place] == at
    marks[place[won]] = value[won]


def _sketch(column: pa.Array, width: int) -> np.ndarray:
    raw, starts, ends = utf8_column(column)
    text, key, count = shingles(raw, starts, ends, width)
    return bag_minhash(text, key, count.astype(np.float64), len(starts))


def bags(column: pa.Array, width: int = 5) -> pa.Array:
    """The shingles of each text as a set of features, sorted, in six bytes each: a shingle that occurs c times is c features, its first to its c-th copy.

    The sizes of the intersection and the union of two such sets are the sums of the minima and the maxima of the counts.
    """
    raw, starts, ends = utf8_column(column)
    text, key, count = shingles(raw, starts, ends, width)
    row = np.repeat(text, count)
    nth = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    key = np.repeat(key, count)
    again = nth > 0
    key[again] = mix(key[again] ^ mix(nth[again])) >> np.uint64(16)
    for a in range(0, len(starts), 1 << 16):  # 16 bits of text and 48 of feature in one word
        x, y = np.searchsorted(row, [a, a + (1 << 16)])
        key[x:y] = np.sort((row[x:y] - a).astype(np.uint64) << np.uint64(48) | key[x:y]) & np.uint64((1 << 48) - 1)
    packed = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    cuts = np.searchsorted(row, np.arange(len(starts) + 1)) * 6
    return pa.array([packed[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())


def features(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``bags``: the row of each feature, the feature, and the number of features of each row."""
    size = np.fromiter(map(len, column), np.int64, len(column)) // 6
    wide = np.zeros((int(size.sum()), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(column), np.uint8).reshape(-1, 6)
    return np.repeat(np.arange(len(column)), size), wide.view("<u8").ravel(), size


def overlap(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The multiset Jaccard similarity of the shingles of two columns of ``bags``, row by row."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 1 << 16):
        sides = [features(x[lo : lo + (1 << 16)]) for x in (a, b)]
        tagged = [row.astype(np.uint64) << np.uint64(48) | key for row, key, _ in sides]
        both = np.intersect1d(*tagged, assume_unique=True) >> np.uint64(48)
        n = len(sides[0][2])
        common = np.bincount(both.astype(np.int64), minlength=n)
        whole = sides[0][2] + sides[1][2] - common
        out[lo : lo + n] = np.divide(common, whole, out=np.zeros(n), where=whole > 0)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of ``pairs`` (u, v) those whose texts (``texts`` has the bag of each node) have at least that similarity."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("bag").alias(f"{c}_bag"), F.col("size").alias(f"{c}_size"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where(_may_match(F.col("u_size"), F.col("v_size"), least))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ok = overlap(part.column("u_bag").to_pylist(), part.column("v_bag").to_pylist()) >= least - 1e-12
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"]).filter(pa.array(ok))

    return both.select("u", "v", "u_bag", "v_bag").mapInArrow(check, "u long, v long")


def _may_match(a: Column, b: Column, least: float) -> Column:
    """Sets of similarity ``least`` have sizes of at least that ratio."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least - 1e-9)


def overlap_matrix(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The multiset Jaccard similarities of each of ``a`` with each of ``b``, columns of ``bags``."""
    row_a, key_a, size_a = features(a)
    row_b, key_b, size_b = features(b)
    both = np.intersect1d(key_a, key_b)
    common = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(both), 16384):
        some = both[at : at + 16384]
        sides = []
        for row, key, n in ((row_a, key_a, len(a)), (row_b, key_b, len(b))):
            place = np.searchsorted(some, key)
            place[place == len(some)] = 0
            hit = some[place] == key
            m = np.zeros((n, len(some)), np.float32)
            m[row[hit], place[hit]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    whole = size_a[:, None] + size_b[None, :] - common.astype(np.float64)
    return np.divide(common, whole, out=np.zeros(common.shape), where=whole > 0)


def _left_apart(family: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that join all members of a family, of different components, whose texts are similar.

    Members outside the head's component meet all others whose size allows the similarity: members are cut into blocks by the logarithm of their size, in steps of
    ``least``, so only blocks of equal or neighbouring steps meet. All pairs of two blocks are decided exactly, by their features; what leaves
    them is at most a link for each component, as only the components matter. A block has a bounded number of members and features, or is one text.
    """
    split = family.where("own != head").select(F.col("head").alias("h")).distinct()
    family = family.join(split, F.col("head") == F.col("h")).select("head", "node", "own")
    step = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(-np.log(least) + 1e-12))
    sized = stash(family.join(texts.select("node", "size"), "node").select("head", "node", "own", "size", step.alias("step"), (F.col("own") != F.col("head")).alias("away")))
    parts = sized.groupBy("head", "step", "away").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_ROWS), F.sum("size") / F.lit(BLOCK_FEATURES))).alias("parts"))
    parts = stash(parts.select(F.col("head").alias("h"), F.col("step").alias("s"), F.col("away").alias("w"), "parts"))
    cut = sized.join(parts, (F.col("head") == F.col("h")) & (F.col("step") == F.col("s")) & (F.col("away") == F.col("w")))
    cut = cut.select("head", "step", "away", F.pmod(F.xxhash64("node"), F.col("parts")).alias("chunk"), "node", "own").join(texts.select("node", "bag"), "node")
    blocks = stash(cut.groupBy("head", "step", "away", "chunk").agg(F.collect_list("own").alias("own"), F.collect_list("bag").alias("bag")))
    b = blocks.select(F.col("head").alias("b_head"), F.col("step").alias("b_step"), F.col("away").alias("b_away"), F.col("chunk").alias("b_chunk"), F.col("own").alias("b_own"), F.col("bag").alias("b_bag"))
    near = F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1))))
    a = blocks.where("away").select("head", "step", near.alias("other"), "chunk", F.col("own").alias("a_own"), F.col("bag").alias("a_bag"))
    once = ~F.col("b_away") | (F.col("other") > F.col("step")) | (F.col("other") == F.col("step")) & (F.col("b_chunk") >= F.col("chunk"))
    work = a.join(b, (F.col("head") == F.col("b_head")) & (F.col("other") == F.col("b_step")) & once).select("a_own", "a_bag", "b_own", "b_bag")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own_a, own_b = (batch.column(c)[r].values.to_numpy() for c in ("a_own", "b_own"))
                a, b = (batch.column(c)[r].values.to_pylist() for c in ("a_bag", "b_bag"))
                i, j = np.nonzero((overlap_matrix(a, b) >= least - 1e-9) & (own_a[:, None] != own_b[None, :]))
                if len(i):
                    # the least component that each reaches within these blocks
                    uid, back = np.unique(np.concatenate([own_a[i], own_b[j]]), return_inverse=True)
                    u, v = back[: len(i)], back[len(i) :]
                    root = np.arange(len(uid))
                    while True:
                        low = np.minimum(root[u], root[v])
                        new = root.copy()
                        np.minimum.at(new, u, low)
                        np.minimum.at(new, v, low)
                        if (new == root).all():
                            break
                        root = new
                    yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(uid[root])], names=["u", "v"])

    found = settle(work.mapInArrow(decide, "u long, v long").where("u != v").distinct())
    unstash(sized, parts, blocks)
    return found


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """``id_col``, ``class_id`` (the least id of the row's class) and ``kept`` (whether the row's id is that) for every row.

    Two texts are linked if the multisets of their shingles of ``width`` words have a Jaccard similarity of at least ``least``; classes
    are the connected components. Equal texts are one node from the start, so copies cost nothing further.

    Each node has 32 band hashes. Every bucket (nodes with a hash in common) has a leader, the member that has the most company in
    all its buckets, which is the original in a family of edited copies; members are verified against their leaders. Members whose
    component then differs from their leader's are compared with all other members of the buckets that the leader's component
    leads, in blocks, and what leaves a pair of blocks is at most a link for each component. Every comparison is exact, on hashed shingles of 48 bits; short
    signatures only say which members are verified against their leaders first. Thus a link between texts that share a bucket is never lost, and no list of
    a group's pairs is ever made. All that grows with a bucket is summed before the shuffle, cut into blocks, or split by Spark's skewed joins.

    Rows whose text is null or has no word, each are a class of their own. Rows of one id are judged by their own texts. A class whose ids
    are all null has a null id and is kept. An empty table gives an empty result; other columns are not read. ``with_key`` adds
    ``text_key``, the MD5 of the text (null without a word).
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = source.select("id", "text", F.when(worded, F.md5("text")).alias("key"))
    id_type = keyed.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = REGISTERS // ROWS
        salt = mix(np.arange(bands, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                signature = _sketch(part.column("text"), width)
                n = len(signature)
                hashes = np.repeat(salt[None], n, axis=0)
                for k in range(ROWS):
                    hashes = mix(hashes ^ mix(signature[:, k::ROWS] + np.uint64(k)))
                bits = np.packbits((mix(signature) & np.uint64(1)).astype(bool), axis=1).view(">i8").astype(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), flat, *(pa.array(bits[:, i]) for i in range(2))], names=["id", "key", "bands", "b0", "b1"]
                )

    every = settle(keyed.mapInArrow(sketch, f"id {id_type}, key string, bands array<long>, b0 long, b1 long"))
    rows = every.where("key IS NOT NULL")
    # equal texts have equal signatures; once kept in the shared folder, a node's number stays what it is
    nodes = rows.groupBy("key").agg(F.min("id").alias("least_id"), *(F.first(c).alias(c) for c in ("bands", "b0", "b1")))
    nodes = stash(nodes.withColumn("node", F.monotonically_increasing_id()))
    entries = nodes.select("node", "b0", "b1", F.explode("bands").alias("band"))
    crowds = stash(entries.groupBy("band").count().where("count > 1"))
    shared = stash(entries.join(crowds, "band"))
    found = shared.select("node").distinct().join(nodes, "node").select("node", F.col("key").alias("k"), "least_id")
    texts = keyed.join(found, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("least_id"))).select("node", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                bag = bags(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([part.column("node"), pc.divide(pc.binary_length(bag), 6).cast(pa.int64()), bag], names=["node", "size", "bag"])

    texts = stash(texts.dropDuplicates(["node"]).mapInArrow(pack, "node long, size long, bag binary"))

    company = shared.groupBy("node").agg(F.sum("count").alias("company"))
    lead = F.max_by(F.struct(F.col("node").alias("leader"), F.col("b0").alias("l0"), F.col("b1").alias("l1")), F.struct("company", "node"))
    leaders = stash(shared.join(company, "node").groupBy("band").agg(lead.alias("lead")).select("band", "lead.*"))
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("l0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("l1")))
    led = stash(shared.join(leaders, "band").where("node != leader").select("node", "leader", (differ <= MOST_BITS).alias("close")).distinct())
    links = settle(_verified(led.where("close").select(F.col("node").alias("u"), F.col("leader").alias("v")), texts, least))
    first = settle(components(links))

    # what the leaders left apart: a family is all nodes of the buckets that a component's members lead
    name = first.select(F.col("node").alias("n"), "component")
    part = lambda df, c, out: df.join(name, F.col(c) == F.col("n"), "left").withColumn(out, F.coalesce("component", F.col(c))).drop("n", "component")
    family = part(part(led, "node", "own"), "leader", "head").select("head", "node", "own").distinct()
    family = stash(family.unionByName(part(led.select(F.col("leader").alias("node")).distinct(), "node", "own").select(F.col("own").alias("head"), "node", "own")).distinct())
    more = _left_apart(family, texts, least)
    joined = components(links.unionByName(more))

    named = nodes.select(F.col("node").alias("n"), "key", "least_id").join(joined, F.col("n") == F.col("node"), "left").select("key", "least_id", F.coalesce("component", "n").alias("component"))
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("class_id"))
    classes = settle(named.join(least_ids, "component").select("key", "class_id"))
    unstash(crowds, shared, texts, leaders, led, family, nodes)
    extra = [F.col("key").alias("text_key")] if with_key else []
    answer = rows.select("id", "key").join(classes, "key").select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), *extra)
    return answer.unionByName(every.where("key IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(True).alias("kept"), *extra))


def keep_one(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``: that of the least id, and of rows with that id and equal text one."""
    found = near_duplicates(docs, least, width, id_col, text_col, with_key=True)
    kept = settle(found.where("kept").select(F.col(id_col).alias("_dup_id"), F.col("text_key").alias("_dup_key")).distinct())
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn("_dup_row_key", F.when(worded, F.md5(text_col)))
    same = keyed.join(kept, F.col(id_col).eqNullSafe(F.col("_dup_id")) & F.col("_dup_row_key").eqNullSafe(F.col("_dup_key"))).select(*docs.columns, "_dup_row_key")
    wordless = same.where("_dup_row_key IS NULL")
    return same.where("_dup_row_key IS NOT NULL").dropDuplicates([id_col, "_dup_row_key"]).unionByName(wordless).select(*docs.columns)
