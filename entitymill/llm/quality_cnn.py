"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes run over chunks of ``STEP`` window positions; neighbouring
chunks overlap by ``WIDTH - 1`` bytes, so every window of the whole text lies in one
chunk. Each filter is max-pooled over a chunk; mean and maximum over the chunks of a
text go through one dense unit to a probability. Training keeps, per chunk and
filter, the window that won, so gradients are sparse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import map_texts

WIDTH = 6
FILTERS = 32
STEP = 256
#: Documents with a lower score are rejected.
THRESHOLD = 0.3


def chunked(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all chunks in a row, chunks of each text, end of each text).

    Every text is filled with zeros to whole chunks, with at least ``WIDTH - 1`` of them;
    a null text counts as empty and has one chunk.
    """
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    counts = (sizes + WIDTH - 2) // STEP + 1
    ends = counts.cumsum() * STEP
    flat = np.zeros(int(ends[-1]) + WIDTH - 1 if len(texts) else 0, np.uint8)
    for text, size, end, count in zip(texts, sizes, ends, counts, strict=True):
        if size:
            at = end - count * STEP
            flat[at : at + size] = np.frombuffer(text, np.uint8)
    return flat, counts, ends


class ByteNet:
    """Weights: ``w`` (WIDTH, 256, FILTERS), ``b`` (FILTERS), ``v`` (mean and maximum part), ``c``."""

    def __init__(self, w, b, v, c):
        self.w, self.b, self.v, self.c = w, b, v, c
        # Two neighbouring bytes are looked up at once.
        pairs = [w[j][:, None] + w[j + 1][None] for j in range(0, WIDTH, 2)]
        pairs[0] = pairs[0] + b
        self.pairs = [p.reshape(-1, FILTERS).astype(np.float32) for p in pairs]

    def windows(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Filter outputs (position, filter); windows that would leave their text are 0."""
        n = len(flat) - WIDTH + 1
        two = flat[:-1].astype(np.uint16) << 8 | flat[1:]
        z = self.pairs[0].take(two[:n], axis=0)
        for j in range(1, WIDTH // 2):
            z += self.pairs[j].take(two[2 * j : 2 * j + n], axis=0)
        np.maximum(z, 0, out=z)
        z[(ends[:, None] - np.arange(1, WIDTH)).ravel()] = 0
        return z

    def pooled(self, texts: list, most: int = 256) -> np.ndarray:
        """Per text, mean and maximum over its chunks of the chunks' maxima."""
        flat, counts, ends = chunked(texts)
        best = np.empty((int(counts.sum()), FILTERS), np.float32)
        for a, z in self.blocks(flat, ends, most):
            best[a : a + len(z)] = z.max(axis=1)
        return _combined(best, counts)

    def blocks(self, flat: np.ndarray, ends: np.ndarray, most: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """(first chunk, filter outputs by chunk and window) of runs of ``most`` chunks."""
        n = int(ends[-1]) // STEP if len(ends) else 0
        for a in range(0, n, most):
            b = min(a + most, n)
            inside = ends[(ends > a * STEP) & (ends <= b * STEP)] - a * STEP
            yield a, self.windows(flat[a * STEP : b * STEP + WIDTH - 1], inside).reshape(b - a, STEP, FILTERS)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(pooled.astype(np.float64) @ self.v + self.c)))

    def score(self, texts: list) -> np.ndarray:
        return self.probabilities(self.pooled(texts)) if texts else np.empty(0)


def _combined(best: np.ndarray, counts: np.ndarray) -> np.ndarray:
    starts = counts.cumsum() - counts
    mean = np.add.reduceat(best, starts, axis=0) / counts[:, None]
    return np.concatenate([mean, np.maximum.reduceat(best, starts, axis=0)], axis=1)


def fit(texts: list, labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteNet:
    """Adam on the logistic loss. Without texts of both labels the score is constant: the
    share of label 1, or 0.5 without any."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    share = min(max(share, 0.001), 0.999)
    theta = {
        "w": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)),
        "b": np.zeros(FILTERS),
        "v": rng.normal(0, 0.1, 2 * FILTERS),
        "c": np.array(np.log(share / (1 - share))),
    }
    if len(set(labels.tolist())) < 2:
        theta["v"][:] = 0
        return ByteNet(**theta)
    m1, m2 = ({k: np.zeros_like(t) for k, t in theta.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            grads = _gradients(ByteNet(**theta), [texts[i] for i in rows], labels[rows])
            step += 1
            pace = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                theta[k] = theta[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(**theta)


def _gradients(net: ByteNet, texts: list, y: np.ndarray) -> dict[str, np.ndarray]:
    flat, counts, ends = chunked(texts)
    best, where = np.empty((int(counts.sum()), FILTERS), np.float32), np.empty((int(counts.sum()), FILTERS), np.int64)
    for a, z in net.blocks(flat, ends):
        won = z.argmax(axis=1)
        where[a : a + len(z)], best[a : a + len(z)] = won, np.take_along_axis(z, won[:, None], axis=1)[:, 0]
    pooled = _combined(best, counts)
    error = (net.probabilities(pooled) - y) / len(y)
    text_of = np.repeat(np.arange(len(texts)), counts)
    # The mean's share of every chunk, and the maximum's for the first chunk that reaches it.
    back = error[text_of, None] * net.v[:FILTERS] / counts[text_of, None]
    top = best == pooled[text_of, FILTERS:]
    order = np.cumsum(top, axis=0)
    first = counts.cumsum() - counts
    before = (order[first] - top[first])[text_of]
    back += np.where(top & (order - before == 1), error[text_of, None] * net.v[FILTERS:], 0)
    back[best <= 0] = 0
    at = np.arange(len(best))[:, None] * STEP + where
    grad_w = np.empty_like(net.w)
    filters = np.broadcast_to(np.arange(FILTERS), at.shape)
    for j in range(WIDTH):
        cell = flat[at + j].astype(np.int64) * FILTERS + filters
        grad_w[j] = np.bincount(cell.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {"w": grad_w, "b": back.sum(axis=0), "v": pooled.T @ error, "c": np.array(error.sum())}


def fit_labelled(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    train_rows: int = 4_000, train_bytes: int = 64_000_000, folds: int = 5, epochs: int = 10,
) -> ByteNet:
    """A net fitted on whole texts of at most ``train_rows`` labelled rows, chosen by a hash of
    the id among those whose crc32(id) modulo ``folds`` is not 0, and as many of them as
    ``train_bytes`` hold. That bounds what reaches the driver; scoring has no such bound."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where("_id is not null and _y is not null")
    known = known.where(F.crc32(F.col("_id").cast("string")) % folds != 0)
    some = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(train_rows)
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).join(F.broadcast(some), "_id")
    order = [F.xxhash64("_id"), "_id", "_y"]
    sizes = rows.select("_id", "_y", F.octet_length("_text").alias("_size")).orderBy(*order, "_size").limit(train_rows).collect()
    total, last = 0, None
    for r in sizes:
        total += r["_size"]
        if total > train_bytes:
            break
        last = r
    if last is None:
        return fit([], np.zeros(0), epochs=epochs)
    # All rows up to the last id that fits; copies of it come along as far as they fit.
    own = F.lit(last["_id"]).cast(rows.schema["_id"].dataType)
    upto = F.struct(F.xxhash64("_id"), "_id", "_y") <= F.struct(F.xxhash64(own), own, F.lit(last["_y"]))
    sample = rows.where(upto).orderBy(*order, F.octet_length("_text"), "_text").limit(sizes.index(last) + 1).collect()
    return fit([bytes(r["_text"]) for r in sample], np.array([r["_y"] for r in sample], float), epochs=epochs)


def scored(docs: DataFrame, net: ByteNet, keep, text_col: str = "text", score: str = "score") -> DataFrame:
    """The ``keep`` columns of every row and its ``score``, from nothing but the whole text."""

    def work():
        return lambda texts: {score: pa.array(net.score(texts), pa.float64())}

    return map_texts(docs, text_col, list(keep), f"{score} double", work, block_bytes=500_000)


def score_quality(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """id, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Null and empty texts get the score of an empty chunk; equal texts get equal scores;
    a null id is never held out nor learned from; a table without rows gives none;
    further columns play no part.
    """
    found = scored(docs, net, [id_col], text_col)
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == 0, F.lit(False))
    return found.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
