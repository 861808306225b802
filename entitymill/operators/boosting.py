"""Gradient boosting of binary labels on histograms, leaf-wise or level by level.

Values become bins (0: missing), one byte a value. For every tree, tasks add up
gradients and hessians of their rows by (node, feature, bin); the sums are shuffled to
tasks that find the best split of a node, and only splits reach the driver. Several
models - folds, or trials with other settings - grow in the same passes over one table.

Gradients are whole numbers of 1 / ``UNIT``, so sums are exact, and trees don't depend
on how rows lie in partitions. Margins are written every few rounds, with the bins
of some rows in a block column by column; the trees since then are applied again in each
pass. Blocks are small, as Spark reads and hands on thousands of them at a time; tasks put
many together.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.functions.scalar import named
from entitymill.operators.cuts import columns_of, find_cuts
from entitymill.operators.metrics import table_auc, table_loss
from entitymill.sources.staging import remove, share_code, shared_dir, written

UNIT = 1 << 24
WIDTH = 256
#: Features whose best split is sought together, bytes of histograms that a task holds, rounds between two writes of margins.
BLOCK = 32
HISTOGRAM_BYTES = 128_000_000
LOOK = 10
#: Bytes of rows and margins that are kept together, that a task works on at a time, and that Spark reads at a time.
STATE_BYTES = 40_000
WORK_BYTES = 4_000_000
READ_BYTES = 16_000_000


@dataclass(frozen=True)
class Settings:
    """``best_first`` splits the leaf with the greatest gain next, otherwise levels are split in order.

    Limits of 0 are none. ``alpha`` and ``lam`` are the penalties on leaf values, by size and
    by square; ``min_gain`` is what a split must gain more than, as a sum over the rows of
    the node, like ``min_weight``, the least sum of hessians of a leaf. Rows are drawn anew
    every ``subsample_every`` rounds, or never (0). ``patience`` ends a fit so many rounds
    after the one with the best AUC on the rows held out.
    """

    rounds: int = 100
    rate: float = 0.1
    max_leaves: int = 31
    max_depth: int = 0
    min_rows: int = 20
    min_weight: float = 1e-3
    alpha: float = 0.0
    lam: float = 0.0
    min_gain: float = 0.0
    subsample: float = 1.0
    subsample_every: int = 1
    by_tree: float = 1.0
    by_level: float = 1.0
    bins: int = 255
    best_first: bool = True
    from_average: bool = True
    patience: int | None = None
    seed: int = 1


# The published settings. The leaf-wise run names a share of rows but no
# frequency, for which its library takes all rows.
LEAF_WISE = Settings(
    rounds=10_000, rate=0.02, max_leaves=39, max_depth=7, min_rows=629, min_weight=37, alpha=8.9675927624, lam=9.8953903428,
    min_gain=0.911786867, subsample=0.5336340435, subsample_every=0, by_tree=0.0587705926, patience=200,
)
DEPTH_WISE = Settings(
    rounds=10_000, rate=0.001, max_leaves=40, max_depth=16, min_rows=1, min_weight=4, alpha=0.001, lam=0.001, subsample=0.5,
    by_tree=0.5, best_first=False, from_average=False, patience=100,
)


# ---- trees -----------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as arrays, the root first; ``feature`` is -1 in leaves."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row; quickest where the columns of ``codes`` lie in one piece.

        A small tree compares all rows at each of its nodes, byte by byte; in a large one
        only the rows that reach a node are looked at.
        """
        if len(self.feature) <= 256:
            at, open_ = np.zeros(len(codes), np.uint8), [(0, None)]
            while open_:
                node, here = open_.pop()
                f = self.feature[node]
                if f < 0:
                    at |= np.uint8(node) if here is None else here.view(np.uint8) * np.uint8(node)
                    continue
                left = codes[:, f] <= self.cut[node]
                if not self.missing_left[node]:
                    left &= codes[:, f] > 0
                right = ~left
                if here is not None:
                    left &= here
                    right &= here
                open_ += [(self.left[node], left), (self.right[node], right)]
            return at
        at = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            code = codes[rows, self.feature[node]]
            left = np.where(code == 0, self.missing_left[node], code <= self.cut[node])
            at[rows] = np.where(left, self.left[node], self.right[node])
        return at

    def add_to(self, margins: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return margins + self.value[self.leaves(codes)]


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: tuple[int, int, int]  # gradients, hessians, rows
    right: tuple[int, int, int]


@dataclass
class Node:
    depth: int
    sums: tuple[int, int, int] | None = None
    known: bool = False
    split: Split | None = None
    children: tuple[int, int] | None = None


def _pull(gradient, alpha: float):
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0)


def leaf_value(sums: tuple[int, int, int], s: Settings) -> float:
    g, h = sums[0] / UNIT, sums[1] / UNIT
    return float(-s.rate * _pull(g, s.alpha) / (h + s.lam)) if h + s.lam > 0 else 0.0


def _score(g, h, s: Settings):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + s.lam > 0, _pull(g, s.alpha) ** 2 / (h + s.lam), 0.0)


def best_split(hist: np.ndarray, features: Sequence[int], s: Settings) -> tuple[Split | None, tuple[int, int, int]]:
    """Best split of a node from histograms (feature, gradients / hessians / rows, bin), and the node's sums.

    Bins up to a cut go left, and missing values either way. Of equal gains the lowest
    feature, then the lowest cut, then missing to the left is taken.
    """
    total = hist[0].sum(axis=1)
    below = np.cumsum(hist[:, :, 1:], axis=2)
    # (feature, cut, missing left or right, sums)
    left = np.stack([below + hist[:, :, :1], below], axis=-1).transpose(0, 2, 3, 1)
    right = total - left
    g, h, n = (left[..., k] for k in range(3))
    fits = (n >= max(s.min_rows, 1)) & (right[..., 2] >= max(s.min_rows, 1))
    fits &= (h >= s.min_weight * UNIT) & (right[..., 1] >= s.min_weight * UNIT)
    parent = _score(total[0] / UNIT, total[1] / UNIT, s)
    gain = _score(g / UNIT, h / UNIT, s) + _score(right[..., 0] / UNIT, right[..., 1] / UNIT, s) - parent
    gain = np.where(fits, gain, -np.inf)
    at = int(gain.argmax())
    best = float(gain.flat[at])
    sums = tuple(int(x) for x in total)
    if not best > max(s.min_gain, 1e-9):
        return None, sums
    f, cut, side = np.unravel_index(at, gain.shape)
    halves = [tuple(int(x) for x in part[f, cut, side]) for part in (left, right)]
    return Split(best, int(features[f]), int(cut) + 1, side == 0, *halves), sums


class Grower:
    """One tree on the way: says which nodes' histograms it needs, and learns their splits.

    Best-first growth asks for the children of all leaves that could still be split, so it
    takes about as many passes as the tree has levels; which leaves are split, and in
    which order, is as if they were asked for one by one.
    """

    def __init__(self, settings: Settings, width: int, round_: int):
        self.s, self.round, self.nodes = settings, round_, [Node(0)]
        rng = np.random.default_rng([settings.seed, round_])
        self.features = np.sort(rng.choice(width, max(1, int(width * settings.by_tree)), replace=False)) if width else np.zeros(0, int)
        self.wanted, self.splits = [0], []

    def allowed(self, depth: int) -> np.ndarray:
        """Which of the tree's features may split at a level."""
        out = np.zeros(len(self.features), bool)
        rng = np.random.default_rng([self.s.seed, self.round, depth + 1])
        out[rng.choice(len(out), max(1, int(len(out) * self.s.by_level)), replace=False)] = True
        return out

    def _children(self, i: int) -> tuple[int, int]:
        node = self.nodes[i]
        if node.children is None:
            node.children = (len(self.nodes), len(self.nodes) + 1)
            for sums in (node.split.left, node.split.right):
                child = Node(node.depth + 1, sums)
                # What can't be split needs no histogram.
                deep = self.s.max_depth and child.depth >= self.s.max_depth
                child.known = bool(deep or sums[2] < 2 * max(self.s.min_rows, 1) or sums[1] < 2 * self.s.min_weight * UNIT)
                self.nodes.append(child)
        return node.children

    def learn(self, found: dict[int, tuple[Split | None, tuple[int, int, int]]]) -> None:
        for i in self.wanted:
            split, sums = found.get(i, (None, (0, 0, 0)))
            node = self.nodes[i]
            node.known, node.split = True, split
            node.sums = node.sums or sums
        self.wanted, self.splits = (self._best_first if self.s.best_first else self._by_level)()

    def _best_first(self) -> tuple[list[int], list[int]]:
        most = self.s.max_leaves or len(self.nodes) ** 2 + 2
        leaves, queue, splits = 1, [], []

        def add(i: int) -> None:
            if self.nodes[i].split:
                heapq.heappush(queue, (-self.nodes[i].split.gain, i))

        unknown = [0] if not self.nodes[0].known else []
        add(0)
        while not unknown and queue and leaves < most:
            _, i = heapq.heappop(queue)
            splits.append(i)
            leaves += 1
            for c in self._children(i):
                add(c) if self.nodes[c].known else unknown.append(c)
        if not unknown or leaves >= most:
            return [], splits
        for _, i in heapq.nsmallest(most - leaves, queue):
            unknown += [c for c in self._children(i) if not self.nodes[c].known]
        return unknown, splits

    def _by_level(self) -> tuple[list[int], list[int]]:
        most = self.s.max_leaves or 1 << 62
        leaves, level, splits = 1, [0], []
        while level:
            unknown = [i for i in level if not self.nodes[i].known]
            if unknown:
                return unknown, splits
            below = []
            for i in level:
                if self.nodes[i].split and leaves < most:
                    splits.append(i)
                    leaves += 1
                    below += self._children(i)
            level = below if leaves < most else []
        return [], splits

    def tree(self, all_known: bool = False) -> Tree:
        """The tree grown; with ``all_known`` every node that has children, to find rows of wanted nodes."""
        n = len(self.nodes)
        out = Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n, int), np.zeros(n, int), np.zeros(n), np.zeros(n))
        chosen = [i for i, node in enumerate(self.nodes) if node.children] if all_known else self.splits
        for i in chosen:
            split, (left, right) = self.nodes[i].split, self.nodes[i].children
            out.feature[i], out.cut[i], out.missing_left[i], out.gain[i] = split.feature, split.cut, split.missing_left, split.gain
            out.left[i], out.right[i] = left, right
        if not all_known:
            out.value = np.array([leaf_value(node.sums, self.s) if node.sums else 0.0 for node in self.nodes])
        return out


# ---- the table -------------------------------------------------------------


@dataclass
class Binned:
    """A table of (id, label, fold, key, bins), with the names and cut points of its features."""

    rows: DataFrame
    id_col: str
    names: list[str]
    cuts: list[np.ndarray]


def bin_table(df: DataFrame, id_col: str, label: str, features: Sequence[str], bins: int = 255, folds: DataFrame | None = None, weight: str | None = None) -> Binned:
    """Bins of all rows, written. Cut points come from the labelled rows; ``folds`` has id and fold."""
    if not 2 <= bins < WIDTH:
        raise ValueError(f"2 to {WIDTH - 1} bins, not {bins}")
    share_code(df.sparkSession)
    features = list(features)
    cuts = find_cuts(df.filter(named(label).isNotNull()), features, bins, weight)
    names = [f"f{i}" for i in range(len(features))]
    rows = df.select(
        named(id_col).alias("id"), named(label).cast("double").alias("label"), F.xxhash64(named(id_col)).alias("key"),
        *[named(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)],
    )
    kind = rows.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = columns_of(batch, names)
            codes = np.zeros(values.shape, np.uint8)
            for i, c in enumerate(cuts):
                codes[:, i] = np.where(np.isnan(values[:, i]), 0, 1 + np.searchsorted(c, values[:, i]))
            starts = np.arange(len(codes) + 1, dtype=np.int32) * len(names)
            raw = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(starts), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], raw], names=["id", "label", "key", "bins"])

    coded = rows.mapInArrow(code, f"id {kind}, label double, key long, bins binary")
    if folds is None:
        coded = coded.withColumn("fold", F.lit(-1))
    else:
        folds = folds.select(named(id_col).alias("_id"), F.col("fold").cast("int").alias("fold"))
        coded = coded.join(folds, coded["id"] == folds["_id"], "left").drop("_id")
    return Binned(written(coded), id_col, features, cuts)


def codes_of(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.binary())
    n = len(column)
    if not n or not width:
        return np.zeros((n, width), np.uint8)
    stops = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[stops[0] : stops[-1]].reshape(n, width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _drawn(key: np.ndarray, settings: Settings, round_: int) -> np.ndarray | bool:
    """Which rows a round's tree sees: by a hash of the row's id and the draw."""
    if settings.subsample >= 1 or not settings.subsample_every:
        return True
    draw = round_ // settings.subsample_every
    salt = np.random.default_rng([settings.seed, draw, 1 << 20]).integers(1 << 63, dtype=np.uint64)
    x = key.astype(np.uint64) ^ salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < settings.subsample


# ---- training --------------------------------------------------------------


@dataclass
class Model:
    settings: Settings
    fold: int | None
    base: float
    trees: list[Tree] = field(default_factory=list, repr=False)
    trace: list[tuple[int, str, float | None, float]] = field(default_factory=list, repr=False)  # round, part, auc, loss
    stopped: bool = False

    def best_round(self) -> int | None:
        """The first round with the best AUC on the rows held out; None without any."""
        found = [(r, a) for r, part, a, _ in self.trace if part == "valid" and a is not None]
        return max(found, key=lambda x: (x[1], -x[0]))[0] if found else None

    def probability(self, codes: np.ndarray) -> np.ndarray:
        margins, codes = np.full(len(codes), self.base), np.asfortranarray(codes)
        for tree in self.trees:
            margins = tree.add_to(margins, codes)
        return _sigmoid(margins)

    def gains(self, width: int) -> np.ndarray:
        """Summed gain of every feature's splits."""
        out = np.zeros(width)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(out, tree.feature[inner], tree.gain[inner])
        return out


@dataclass
class _Query:
    """What a pass needs to know of one model: which rows to add up for which nodes."""

    at: int
    model: Model
    grower: Grower
    nodes: list[int]
    recent: list[Tree]
    start: tuple[float, int | None, list[Tree]]

    def packed(self) -> dict:
        tree = self.grower.tree(all_known=True)
        slots = np.full(len(self.grower.nodes), -1)
        slots[self.nodes] = np.arange(len(self.nodes))
        depths = [self.grower.nodes[i].depth for i in self.nodes]
        return {
            "at": self.at, "fold": self.model.fold, "settings": self.model.settings, "round": self.grower.round, "tree": tree,
            "slots": slots, "nodes": self.nodes, "recent": self.recent, "start": self.start, "features": self.grower.features,
            "allowed": [self.grower.allowed(d) for d in depths],
        }


def fit(table: Binned, settings: Sequence[Settings], folds: Sequence[int | None], both_parts: bool = False, rounds: int | None = None, models: Sequence[Model] | None = None) -> list[Model]:
    """One model for each of ``settings``, without the rows of its fold (None: with all).

    All grow at the same time, round by round, until their rounds are done or their patience
    ends; ``keep_best`` then cuts them back. ``both_parts`` traces AUC and loss of the rows
    learned from as well. ``rounds`` ends this call early; ``models`` of such a call go on
    where they ended.
    """
    labelled = table.rows.where("label IS NOT NULL").select("key", "label", "fold", "bins")
    if models is None:
        counts = {r["fold"]: (r["n"], r["pos"]) for r in labelled.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}
        models = [Model(s, fold, _base(counts, fold) if s.from_average else 0.0) for s, fold in zip(settings, folds, strict=True)]
    trainer = _Trainer(table, labelled, list(models), both_parts)
    trainer.run(rounds)
    return trainer.models


def _base(counts: dict, fold: int | None) -> float:
    """Log odds of the label among the rows learned from, kept finite for a single class."""
    n, pos = (sum(c[k] for f, c in counts.items() if fold is None or f != fold) for k in (0, 1))
    share = min(max(pos / n, 1e-9), 1 - 1e-9) if n else 0.5
    return float(np.log(share / (1 - share)))


class _Trainer:
    """``written`` says which row of a block's margins belongs to a model. A model without one starts from its base
    and the trees in ``old``; as long as a model has few trees, that costs less than to keep margins for every row."""

    def __init__(self, table: Binned, rows: DataFrame, models: list[Model], both_parts: bool):
        share_code(rows.sparkSession)
        self.width, self.models, self.both_parts = len(table.names), models, both_parts
        self.recent: list[list[Tree]] = [[] for _ in models]
        kept = [i for i, m in enumerate(models) if len(m.trees) > LOOK]
        self.written = {i: k for k, i in enumerate(kept)}
        self.old = [[] if i in self.written else list(m.trees) for i, m in enumerate(models)]
        trees, width, rows_a_block = [(models[i].base, list(models[i].trees)) for i in kept], self.width, self._rows_a_block(STATE_BYTES)

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, label, fold = (batch.column(c).to_numpy() for c in ("key", "label", "fold"))
                codes = np.asfortranarray(codes_of(batch.column("bins"), width))
                out = np.empty((len(trees), len(key)))
                for i, (base, grown) in enumerate(trees):
                    out[i] = base
                    for tree in grown:
                        out[i] = tree.add_to(out[i], codes)
                if len(key):
                    yield _State(key, label, fold, codes, out).batch(rows_a_block)

        self.state, self.path = self._kept(rows.mapInArrow(begin, _STATE))

    def _rows_a_block(self, size: int) -> int:
        return max(1, size // (20 + self.width + 8 * len(self.written)))

    def _start(self, i: int) -> tuple[float, int | None, list[Tree]]:
        return self.models[i].base, self.written.get(i), self.old[i]

    def _kept(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """``rows`` written, and held in memory as far as it goes; lost parts are read again."""
        path = f"{shared_dir(rows.sparkSession)}/entitymill/margins-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", READ_BYTES).parquet(path)
        return rows.sparkSession.read.schema(_STATE).parquet(path).persist(StorageLevel.MEMORY_AND_DISK), path

    def _drop(self, rows: DataFrame, path: str) -> None:
        rows.unpersist()
        remove(rows.sparkSession, path)

    def run(self, rounds: int | None) -> None:
        done = 0
        while rounds is None or done < rounds:
            growing = [(i, m) for i, m in enumerate(self.models) if not m.stopped and len(m.trees) < m.settings.rounds]
            if not growing:
                break
            self._round(growing)
            done += 1
            last = done == rounds or any(len(m.trees) == m.settings.rounds for _, m in growing)
            if last or max(len(r) for r in self.recent) >= LOOK:
                self._look()
                if done != rounds and any(not m.stopped and len(m.trees) < m.settings.rounds for m in self.models):
                    self._forward()
                self.recent = [[] for _ in self.models]
        self._drop(self.state, self.path)

    def _round(self, growing: list[tuple[int, Model]]) -> None:
        growers = {i: Grower(m.settings, self.width, len(m.trees)) for i, m in growing}
        while open_ := {i: g for i, g in growers.items() if g.wanted}:
            queries = [_Query(i, self.models[i], g, g.wanted, self.recent[i], self._start(i)) for i, g in open_.items()]
            found = self._search(queries)
            for i, g in open_.items():
                g.learn(found.get(i, {}))
        for i, g in growers.items():
            tree = g.tree()
            self.models[i].trees.append(tree)
            self.recent[i].append(tree)

    def _search(self, queries: list[_Query]) -> dict[int, dict[int, tuple]]:
        """Best splits by model and node. Where histograms would outgrow a task, nodes take turns."""
        turns, held = [[]], 0
        for q in queries:
            for node in q.nodes:
                size = len(q.grower.features) * 3 * WIDTH * 8
                if held and held + size > HISTOGRAM_BYTES:
                    turns.append([])
                    held = 0
                held += size
                if turns[-1] and turns[-1][-1].at == q.at:
                    turns[-1][-1].nodes.append(node)
                else:
                    turns[-1].append(replace(q, nodes=[node]))
        found: dict[int, dict[int, tuple]] = {}
        for turn in turns:
            for at, node, result in self._pass([q.packed() for q in turn]):
                found.setdefault(at, {})[node] = result
        return found

    def _pass(self, queries: list[dict]) -> Iterator[tuple]:
        shape = self.width, len(self.written), self._rows_a_block(WORK_BYTES)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {}
            for block in _blocks(batches, *shape):
                for q in queries:
                    leaves = q["tree"].leaves(block.codes)
                    wanted = q["slots"][leaves] >= 0
                    if q["fold"] is not None:
                        wanted &= block.fold != q["fold"]
                    wanted &= _drawn(block.key, q["settings"], q["round"])
                    at = np.flatnonzero(wanted)
                    if not len(at):
                        continue
                    m = block.begun(*q["start"])
                    for tree in q["recent"]:
                        m = tree.add_to(m, block.codes)
                    m = m[at]
                    p = _sigmoid(m)
                    weights = (np.rint((p - block.label[at]) * UNIT), np.rint(p * (1 - p) * UNIT), None)
                    n = len(q["nodes"]) * WIDTH
                    # Whole numbers below 2 ** 53, so doubles add them up exactly.
                    hist = sums.setdefault(q["at"], np.zeros((len(q["features"]), 3, n)))
                    cell = q["slots"][leaves[at]] * WIDTH
                    for j, f in enumerate(q["features"]):
                        index = cell + block.codes[:, f][at]
                        for k, w in enumerate(weights):
                            hist[j, k] += np.bincount(index, w, n)
            for q in queries:
                if q["at"] in sums:
                    hist = sums.pop(q["at"]).astype("<i8")
                    n = len(hist)
                    for slot, node in enumerate(q["nodes"]):
                        own = hist[:, :, slot * WIDTH : (slot + 1) * WIDTH]
                        columns = [pa.array([v] * n, pa.int32()) for v in (q["at"], node)]
                        columns += [pa.array(np.arange(n, dtype=np.int32) // BLOCK), pa.array(np.arange(n, dtype=np.int32)), pa.array([h.tobytes() for h in own], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["model", "node", "block", "feature", "hist"])

        by_model = {q["at"]: q for q in queries}

        def split(key: tuple[int, int, int], hists: list[np.ndarray]) -> dict:
            q = by_model[key[0]]
            a = key[2] * BLOCK
            hist = np.stack(hists).reshape(-1, 3, WIDTH)
            use = np.flatnonzero(q["allowed"][q["nodes"].index(key[1])][a : a + BLOCK])
            best, sums = (None, None)
            if len(use):
                best, sums = best_split(hist[use], q["features"][a : a + BLOCK][use], q["settings"])
            sums = sums or tuple(int(x) for x in hist[0].sum(axis=1))
            row = {"model": key[0], "node": key[1], "gain": -1.0, "feature": 0, "cut": 0, "missing_left": False, "g": 0, "h": 0, "n": 0}
            if best:
                row |= {"gain": best.gain, "feature": best.feature, "cut": best.cut, "missing_left": bool(best.missing_left)}
                row |= dict(zip("ghn", best.left, strict=True))
            return row | dict(zip(("all_g", "all_h", "all_n"), sums, strict=True))

        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, last, hists = None, None, []
            for batch in batches:
                out = []
                *at, raw = batch.columns
                for (*at, feature), x in zip(zip(*(c.to_pylist() for c in at), strict=True), raw, strict=True):
                    hist = np.frombuffer(x.as_buffer(), "<i8")
                    if tuple(at) == key and feature == last:
                        hists[-1] += hist
                        continue
                    if key and tuple(at) != key:
                        out.append(split(key, hists))
                        hists = []
                    key, last = tuple(at), feature
                    hists.append(hist.copy())
                yield pa.RecordBatch.from_pylist(out, schema=_SPLITS)
            if key:
                yield pa.RecordBatch.from_pylist([split(key, hists)], schema=_SPLITS)

        # A histogram of one feature a row, as Spark hands on thousands of rows at a time.
        hists = self.state.mapInArrow(add_up, "model int, node int, block int, feature int, hist binary")
        hists = hists.repartition("model", "node", "block").sortWithinPartitions("model", "node", "block", "feature")
        fields = "model int, node int, gain double, feature int, cut int, missing_left boolean, g long, h long, n long, all_g long, all_h long, all_n long"
        # The driver gets a row for every ``BLOCK`` features of a node.
        best: dict[tuple[int, int], dict] = {}
        for s in hists.mapInArrow(reduced, fields).collect():
            at = s["model"], s["node"]
            if at not in best or (s["gain"], -s["feature"]) > (best[at]["gain"], -best[at]["feature"]):
                best[at] = s
        for (model, node), s in best.items():
            every = (s["all_g"], s["all_h"], s["all_n"])
            left = (s["g"], s["h"], s["n"])
            right = tuple(a - b for a, b in zip(every, left, strict=True))
            found = Split(s["gain"], s["feature"], s["cut"], s["missing_left"], left, right) if s["gain"] > 0 else None
            yield model, node, (found, every)

    def _look(self) -> None:
        """Trace the rounds since the last time, and end fits whose patience does."""
        recent, both, starts = self.recent, self.both_parts, [self._start(i) for i in range(len(self.models))]
        shape = self.width, len(self.written), self._rows_a_block(WORK_BYTES)
        firsts = [len(m.trees) - len(r) + 1 for m, r in zip(self.models, recent, strict=True)]
        asked = [(i, m.fold) for i, m in enumerate(self.models) if recent[i]]
        asked = asked if both else [(i, f) for i, f in asked if f is not None]

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, *shape):
                for i, own in asked:
                    valid = np.zeros(len(block.label), bool) if own is None else block.fold == own
                    rows = np.arange(len(valid)) if both else np.flatnonzero(valid)
                    if not len(rows):
                        continue
                    codes = block.codes if both else np.asfortranarray(block.codes[rows])
                    begun = block.begun(*starts[i])[rows]
                    for k, (part, score, pos, neg) in enumerate(_by_score(begun, codes, recent[i], valid[rows], block.label[rows] == 1)):
                        n = len(score)
                        columns = [pa.array(np.full(n, i, np.int32)), pa.array(part), pa.array(np.full(n, firsts[i] + k, np.int32))]
                        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (score, pos, neg))], names=["model", "valid", "round", "score", "pos", "neg"])

        if asked:
            by = ["model", "valid", "round"]
            rows = self.state.mapInArrow(scores, "model int, valid boolean, round int, score double, pos long, neg long")
            table = rows.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).persist(StorageLevel.MEMORY_AND_DISK)
            found = table_auc(table, by).join(table_loss(table, by), by)
            for r in sorted(found.collect(), key=lambda r: (r["round"], r["valid"])):
                self.models[r["model"]].trace.append((r["round"], "valid" if r["valid"] else "train", r["auc"], r["loss"]))
            table.unpersist()
        for m in self.models:
            best = m.best_round()
            if m.settings.patience is not None and best is not None and len(m.trees) - best >= m.settings.patience:
                m.stopped = True

    def _forward(self) -> None:
        """Write the margins of all fits that go on."""
        on = [i for i, m in enumerate(self.models) if not m.stopped and len(m.trees) < m.settings.rounds]
        starts = [(*self._start(i)[:2], [*self.old[i], *self.recent[i]]) for i in on]
        shape = self.width, len(self.written), self._rows_a_block(WORK_BYTES)
        self.written = {i: k for k, i in enumerate(on)}
        self.old = [[] for _ in self.models]
        rows_a_block = self._rows_a_block(STATE_BYTES)

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, *shape):
                yield replace(block, margins=np.stack([block.begun(*start) for start in starts])).batch(rows_a_block)

        old = self.state, self.path
        self.state, self.path = self._kept(self.state.mapInArrow(forward, _STATE))
        self._drop(*old)


def _by_score(margins: np.ndarray, codes: np.ndarray, trees: Sequence[Tree], valid: np.ndarray, positive: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """After each of ``trees``: part, score, and rows with and without the label, for rows that have reached the same leaves."""
    first, kind = np.unique(margins, return_inverse=True)
    first, kind = np.concatenate([first, first]), kind + len(first) * valid
    part, score = np.repeat([False, True], len(first) // 2), first
    for tree in trees:
        kind = kind * len(tree.value) + tree.leaves(codes)
        kinds = len(score) * len(tree.value)
        if kinds <= 4 * len(kind):
            there = np.flatnonzero(np.bincount(kind, minlength=kinds))
            place = np.zeros(kinds, np.int64)
            place[there] = np.arange(len(there))
            kind = place[kind]
        else:
            there, kind = np.unique(kind, return_inverse=True)
        before, leaf = np.divmod(there, len(tree.value))
        part, score = part[before], score[before] + tree.value[leaf]
        pos = np.bincount(kind[positive], minlength=len(there))
        yield part, score, pos, np.bincount(kind, minlength=len(there)) - pos


_STATE = "key binary, label binary, fold binary, bins binary, margins binary"
_SPLITS = pa.schema(
    [("model", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("cut", pa.int32()),
     ("missing_left", pa.bool_()), *((c, pa.int64()) for c in ("g", "h", "n", "all_g", "all_h", "all_n"))]
)


@dataclass
class _State:
    """Rows of the table with the margins of some models, one after the other; a row of the state holds a block of them."""

    key: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    codes: np.ndarray  # rows by features, columns in one piece
    margins: np.ndarray  # models by rows

    def begun(self, base: float, written: int | None, trees: Sequence[Tree]) -> np.ndarray:
        """One model's margins: as written, or from its base, and ``trees`` on top."""
        m = np.full(len(self.key), base) if written is None else self.margins[written]
        for tree in trees:
            m = tree.add_to(m, self.codes)
        return m

    def batch(self, rows_a_block: int) -> pa.RecordBatch:
        parts = (self.key, self.label, self.fold, self.codes.T, self.margins)
        starts = range(0, len(self.key), rows_a_block)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[..., a : a + rows_a_block].tobytes() for a in starts], pa.binary()) for x in parts],
            names=["key", "label", "fold", "bins", "margins"],
        )


def _blocks(batches: Iterator[pa.RecordBatch], width: int, many: int, at_once: int) -> Iterator[_State]:
    """Blocks put together, until they have ``at_once`` rows, or a batch ends."""

    def joined(blocks: list[tuple[np.ndarray, ...]]) -> _State:
        key, label, fold, codes, margins = (np.concatenate(x, axis=-1) if len(x) > 1 else x[0] for x in zip(*blocks, strict=True))
        return _State(key, label, fold, codes.T, margins)

    for batch in batches:
        waiting, rows = [], 0
        for row in zip(*batch.columns, strict=True):
            key, label, fold, codes, margins = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i8", "<f8", "<i4", "u1", "<f8"), strict=True))
            waiting.append((key, label, fold, codes.reshape(width, len(key)), margins.reshape(many, len(key))))
            rows += len(key)
            if rows >= at_once:
                yield joined(waiting)
                waiting, rows = [], 0
        if waiting:
            yield joined(waiting)


def keep_best(models: Sequence[Model]) -> None:
    """Cut models with patience back to their best round."""
    for m in models:
        if m.settings.patience is not None and m.best_round():
            del m.trees[m.best_round() :]


def predict(table: Binned, models: Sequence[Model], rows: DataFrame, own_fold: bool = False) -> DataFrame:
    """``rows`` of the table (id, label, fold) with ``prediction``: the mean over all models, or
    with ``own_fold`` that of the model which did not see the row's fold."""
    width, models = len(table.names), list(models)
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, fold = codes_of(batch.column("bins"), width), batch.column("fold").to_numpy(zero_copy_only=False)
            out = np.zeros(len(codes))
            for m in models:
                at = np.flatnonzero(fold == m.fold) if own_fold else np.arange(len(codes))
                if len(at):
                    out[at] += m.probability(codes[at])
            out = out if own_fold else out / len(models)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["id", "label", "fold", "prediction"])

    return rows.select("id", "label", "fold", "bins").mapInArrow(score, f"id {kind}, label double, fold int, prediction double")


def tree_table(table: Binned, model: Model, number: int) -> list[dict]:
    """The nodes of a tree with names of features and values of cuts; leaves have neither."""
    tree, out = model.trees[number], []

    def walk(i: int, path: str) -> None:
        row = {"path": path, "feature": None, "cut": None, "missing_left": None, "gain": None, "value": float(tree.value[i])}
        f = int(tree.feature[i])
        if f >= 0:
            cuts, c = table.cuts[f], int(tree.cut[i])
            row |= {"feature": table.names[f], "cut": float(cuts[c - 1]) if c <= len(cuts) else float("inf"),
                    "missing_left": bool(tree.missing_left[i]), "gain": float(tree.gain[i])}
        out.append(row)
        if f >= 0:
            walk(int(tree.left[i]), path + "L")
            walk(int(tree.right[i]), path + "R")

    walk(0, "")
    return out
