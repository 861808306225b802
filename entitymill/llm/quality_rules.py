"""Quality rules: document statistics, fixed base rules and gradient-boosted trees.

The trees are fitted here with numpy on histograms, flattened into node arrays and
scored for whole batches at a time. Statistics marked in ``MONOTONE`` can only lower
(-1) or raise (+1) the score as they grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import SPACE, map_texts, written

# Characters that count as symbols, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_shouts", "n_stops"]

#: Features with the direction in which the score may change as they grow; 0: either.
MONOTONE = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "shout_share": -1, "distinct_share": 0, "stops_a_word": 0,
    "words_a_line": 0,
}

_SPACE = SPACE.encode()
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeated_words(words: list[bytes], size: int = 3) -> tuple[int, int]:
    """(words that lie in a window of ``size`` words found twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(codes) - size + 1
    if n < 2:
        return 0, len(ids)
    window = codes[:n]
    for k in range(1, size):
        # Renumbering keeps (window so far, next word) exact in 64 bits.
        if len(ids) ** (k + 1) >= 2**62:
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(ids) + codes[k : k + n]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(size):
        covered[k : k + n] |= twice
    return int(covered.sum()), len(ids)


def counts_of(raw: bytes | None) -> list[int]:
    """The values of ``COUNTS`` for one text; a null text counts as empty."""
    raw = raw or b""
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    chars = len(raw.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, distinct = repeated_words(words)

    def count(of: bytes) -> int:
        return len(raw) - len(raw.translate(None, of))

    return [
        len(words), chars - spaces, count(SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), distinct, count(_UPPER), count(b"0123456789"), count(b"!?"), count(b"."),
    ]


def document_stats(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    def work():
        def run(texts: list) -> dict:
            table = np.array([counts_of(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
            return {c: table[:, i] for i, c in enumerate(COUNTS)}

        return run

    return map_texts(docs, text_col, list(keep), ", ".join(f"{c} long" for c in COUNTS), work)


def features(table: np.ndarray) -> np.ndarray:
    """Rows of ``COUNTS`` to rows of the features in ``MONOTONE``; shares of nothing are 0."""
    c = {name: table[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars,
            c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars,
            c["n_digits"] / chars, c["n_shouts"] / chars, c["n_distinct_words"] / words,
            c["n_stops"] / words, c["n_words"] / lines,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf is its own child."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``, all trees and rows level by level."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[at]] <= self.cut[at]
            at = np.where(go_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone, trees: int = 80, depth: int = 3, rate: float = 0.15,
    bins: int = 64, least: float = 0.5, ridge: float = 1.0,
) -> Trees:
    """Newton boosting on the logistic loss. Without rows of both labels the score is constant."""
    both = len(y) and 0 < y.mean() < 1
    start = float(np.log(y.mean() / (1 - y.mean()))) if both else (4.0 if len(y) and y.mean() else 0.0)
    nodes = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []

    def add(value: float) -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("cut", 0.0), ("left", k), ("right", k), ("value", value)):
            nodes[name].append(v)
        return k

    if both:
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        code = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    logit = np.full(len(y), start)

    def grow(rows, g, h, level, low, high) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = None
        if level < depth:
            for f, way in enumerate(monotone):
                n = len(cuts[f]) + 1
                gl = np.bincount(code[rows, f], g[rows], n).cumsum()[:-1]
                hl = np.bincount(code[rows, f], h[rows], n).cumsum()[:-1]
                gr, hr = total_g - gl, total_h - hl
                wl = np.clip(-gl / (hl + ridge), low, high)
                wr = np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + gr * wr) - ((hl + ridge) * wl**2 + (hr + ridge) * wr**2) / 2
                gain = gain + total_g * value + (total_h + ridge) * value**2 / 2
                gain[(hl < least) | (hr < least) | (way * (wr - wl) < 0)] = -np.inf
                if len(gain) and gain.max() > (best[0] if best else 1e-6):
                    k = int(gain.argmax())
                    best = (gain[k], f, k, wl[k], wr[k])
        at = add(rate * value)
        if best:
            _, f, k, wl, wr = best
            goes = code[rows, f] <= k
            middle, way = (wl + wr) / 2, monotone[f]
            a = grow(rows[goes], g, h, level + 1, middle if way < 0 else low, middle if way > 0 else high)
            b = grow(rows[~goes], g, h, level + 1, middle if way > 0 else low, middle if way < 0 else high)
            for name, v in (("feature", f), ("cut", cuts[f][k]), ("left", a), ("right", b), ("value", 0.0)):
                nodes[name][at] = v
        else:
            logit[rows] += rate * value
        return at

    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-logit))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    kinds = {"feature": np.int32, "left": np.int32, "right": np.int32}
    arrays = {k: np.array(v, kinds.get(k, np.float64)) for k, v in nodes.items()}
    return Trees(start, np.array(roots, np.int32), **arrays, depth=depth)


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, id_col: str, most: int, folds: int | None) -> DataFrame:
    """``rows`` with their label, at most ``most``, chosen by a hash of the id; rows whose
    id has remainder 0 modulo ``folds`` are held out. Null ids and labels are left out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    if folds:
        known = known.where(F.crc32(F.col("_id").cast("string")) % folds != 0)
    some = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    found = rows.join(F.broadcast(some), rows[id_col] == some["_id"])
    return found.orderBy(F.xxhash64("_id"), "_id", "_y").limit(most).drop("_id")


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", train_rows: int = 20_000, folds: int | None = 5) -> Trees:
    """Trees fitted on at most ``train_rows`` labelled rows of ``stats``; only those reach the driver."""
    sample = labelled_sample(stats.select(id_col, *COUNTS), labels, "quality", id_col, train_rows, folds)
    table = sample.select(*COUNTS, "_y").toPandas().to_numpy(np.int64).reshape(-1, len(COUNTS) + 1)
    return fit_trees(features(table[:, :-1]), table[:, -1].astype(float), list(MONOTONE.values()))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, train_rows: int = 20_000, folds: int | None = 5) -> DataFrame:
    """One row per row of ``docs``: id, ``COUNTS``, ``base_failed``, ``score`` and ``kept``.

    A null or empty text has no words and fails the base rules. Repeated rows get
    equal results, a null id is kept (and never learned from), a table without rows
    gives none, and without labelled rows every score is the same. Columns of
    ``docs`` beyond id and text play no part. ``train_rows`` bounds the labelled
    sample (20,000 by default); statistics and scores cover all rows and whole texts.
    """
    stats = written(document_stats(docs, [id_col], text_col), "quality-stats")
    model = fit_rules(stats, labels, id_col, train_rows, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(1 + i).to_numpy() for i in range(len(COUNTS))], axis=1)
            scores = model.score(features(table)) if len(table) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    kind = stats.schema[id_col].dataType.simpleString()
    scored = stats.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
