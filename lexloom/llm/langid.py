"""Language ID: a byte-level convolutional network, trained in numpy on labelled text and applied to windows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import utf8_column

PAD = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
SPAN = max(WIDTHS)


class ByteConvNet:
    """Embeds bytes, runs filters of several widths over a window, takes each filter's maximum over places, then a softmax."""

    def __init__(self, labels: list[str], length: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.length = labels, length
        self.embed = (rng.standard_normal((257, EMBED)) * 0.5).astype(np.float32)
        self.embed[PAD] = 0
        # one matrix for all widths: a narrow filter has zeros in the places it doesn't see
        self.mask = np.zeros((SPAN * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        n = self.mask.shape[1]
        self.conv = (rng.standard_normal(self.mask.shape) / np.sqrt(SPAN * EMBED)).astype(np.float32) * self.mask
        self.conv_bias = np.zeros(n, np.float32)
        self.dense = (rng.standard_normal((n, len(labels))) / np.sqrt(n)).astype(np.float32)
        self.dense_bias = np.zeros(len(labels), np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed.take(windows.ravel(), axis=0).reshape(len(windows), -1)
        steps = (x.strides[0], EMBED * x.strides[1], x.strides[1])
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (len(windows), self.length - SPAN + 1, SPAN * EMBED), steps))

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches = self._patches(windows)
        return patches, (patches.reshape(-1, SPAN * EMBED) @ self.conv).reshape(len(windows), -1, self.conv.shape[1])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: rows of ``length`` byte values, PAD where a text has ended."""
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for a in range(0, len(windows), 32):
            _, seen = self._pooled(windows[a : a + 32])
            z = np.maximum(seen.max(axis=1) + self.conv_bias, 0) @ self.dense + self.dense_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[a : a + 32] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.004, batch: int = 64, seed: int = 11) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        names = ("embed", "conv", "conv_bias", "dense", "dense_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        share = np.bincount(y, minlength=len(self.labels)).astype(np.float32)
        weight = (len(y) / np.maximum(share, 1) / max(1, (share > 0).sum()))[y]
        weight = np.minimum(weight, 20).astype(np.float32)
        t, places = 0, np.arange(SPAN)
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                w = windows[pick]
                patches, seen = self._pooled(w)
                at = seen.argmax(axis=1)
                z1 = np.take_along_axis(seen, at[:, None], 1)[:, 0] + self.conv_bias
                h = np.maximum(z1, 0)
                z = h @ self.dense + self.dense_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p *= (weight[pick] / len(pick))[:, None]
                g = {"dense": h.T @ p, "dense_bias": p.sum(axis=0)}
                back = (p @ self.dense.T) * (z1 > 0)
                g["conv_bias"] = back.sum(axis=0)
                rows = np.arange(len(pick))[:, None]
                chosen = patches[rows, at]  # (batch, filters, patch): only a filter's best place has a gradient
                g["conv"] = np.einsum("bf,bfk->kf", back, chosen, optimize=True) * self.mask
                into = (back[:, :, None] * self.conv.T[None]).reshape(len(pick), -1, SPAN, EMBED)
                touched = w[rows[:, :, None], at[:, :, None] + places]
                g["embed"] = np.zeros_like(self.embed)
                np.add.at(g["embed"], touched.ravel(), into.reshape(-1, EMBED))
                g["embed"][PAD] = 0
                t += 1
                step = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k in names:
                    first[k] += 0.1 * (g[k] - first[k])
                    second[k] += 0.001 * (g[k] * g[k] - second[k])
                    getattr(self, k)[...] -= (step * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self


def cut_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the windows that cover every byte of every text, and each window's text. Neighbours overlap so that no patch is split."""
    step = length - SPAN + 1
    size = ends - starts
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - length) // step)), 0)
    row = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[row] + nth * step
    return row, begin, np.minimum(begin + length, ends[row])


def read_windows(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    at = begin[:, None] + np.arange(length)
    inside = at < end[:, None]
    return np.where(inside, raw[np.minimum(at, max(0, len(raw) - 1))].astype(np.int16), np.int16(PAD)) if len(raw) else np.full(at.shape, PAD, np.int16)


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_label: int = 800, windows_each: int = 3, length: int = 256, most_labels: int = 256, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> ByteConvNet | None:
    """Fits the network on rows of ``docs`` that aren't held out and have a text and a label; None if there are none.

    The sample is bounded: about ``per_label`` rows of each label, those of the least hashes of their ids, and of each
    ``windows_each`` windows of at most ``length`` bytes at hash-random places. Of more than ``most_labels`` labels the most frequent are learned, of
    equally frequent ones the first. ``per_label``, ``windows_each``, ``length`` and ``most_labels`` are the documented bounds. Predictions later cover whole texts.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(F.col(id_col)))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(label_col).alias("label")).count().orderBy(F.desc("count"), "label").limit(most_labels).collect()}
    if not sizes:
        return None
    labels = sorted(sizes)
    unit = F.pmod(F.xxhash64(F.lit(41), F.col(id_col).cast("string")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    share = F.create_map(*(x for k in labels for x in (F.lit(k), F.lit(per_label / sizes[k]))))
    parts = [
        F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.lit(i), F.col(id_col).cast("string")), F.greatest(F.lit(1), F.length(text_col) - length + 1)) + 1).cast("int"), F.lit(length))
        for i in range(windows_each)
    ]
    sample = (
        known.where(F.coalesce(unit < share[F.col(label_col)], F.lit(False)))
        .select(F.col(label_col).alias("label"), unit.alias("unit"), *(p.alias(f"w{i}") for i, p in enumerate(parts)))
        .orderBy("unit", *(f"w{i}" for i in range(windows_each)), "label").limit(2 * per_label * len(labels)).toArrow()
    )
    place = {k: i for i, k in enumerate(labels)}
    rng, rows, y = np.random.default_rng(5), [], []
    for i in range(windows_each):
        for label, text in zip(sample.column("label").to_pylist(), sample.column(f"w{i}").to_pylist()):
            data = text.encode()[:length]
            if i == windows_each - 1:  # short texts have to be told apart too
                data = data[: int(rng.integers(8, length + 1))]
            rows.append(np.frombuffer(data.ljust(length, b"\0"), np.uint8).astype(np.int16))
            rows[-1][len(data) :] = PAD
            y.append(place[label])
    return ByteConvNet(labels, length).fit(np.array(rows), np.array(y)) if rows else None


def predict(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), unknown: str = "und", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``lang_pred`` and ``score`` (or the names ``out``) (the mean probability over all windows of the whole text) for each row.

    ``unknown`` with score 0 for texts that are null, empty or have no letter, and for all if there was nothing to learn
    from. Repeated rows are each judged; an empty table gives an empty result. Columns outside ``id_col``, ``text_col`` and
    ``keep`` are not read.
    """
    alias = {c: "_text" if c == text_col else f"_keep_{c}" for c in keep}  # a text that is kept is sent once
    taken = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(a) for c, a in alias.items() if c != text_col))
    rest = [f for f in taken.schema.fields if f.name != "_text" or text_col in alias]
    names = [f.name for f in rest]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # only so many rows' strings and windows are held besides the batch
                part = batch.slice(at, 500)
                text = part.column("_text")
                raw, starts, ends = utf8_column(text)
                n = len(starts)
                pred, score = np.full(n, unknown, object), np.zeros(n)
                if net is not None:
                    ok = np.fromiter((x is not None and any(map(str.isalpha, x)) for x in text.to_pylist()), bool, n)
                    begin = np.where(ok, starts, ends)
                    total = np.zeros((n, len(net.labels)))
                    row, a, b = cut_windows(raw, begin, ends, net.length)
                    for k in range(0, len(row), 1024):
                        p = net.probabilities(read_windows(raw, a[k : k + 1024], b[k : k + 1024], net.length))
                        first = np.flatnonzero(np.diff(row[k : k + 1024], prepend=-1))
                        total[row[k : k + 1024][first]] += np.add.reduceat(p.astype(np.float64), first, axis=0)
                    seen = np.bincount(row, minlength=n)
                    best = total.argmax(axis=1)
                    pred[ok] = np.array(net.labels, object)[best[ok]]
                    score[ok] = np.clip(total[ok, best[ok]] / np.maximum(seen[ok], 1), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(pred, pa.string()), pa.array(score)], names=names + ["lang_pred", "score"])

    found = taken.mapInArrow(run, schema)
    return found.select(F.col("_id").alias(id_col), *(F.col(a).alias(c) for c, a in alias.items()), *(F.col(a).alias(b) for a, b in zip(("lang_pred", "score"), out)))
