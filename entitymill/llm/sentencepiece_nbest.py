"""SentencePiece encoding with the n best segmentations, and decoding.

A text is a lattice of pieces. Forward Viterbi scores tell for every position the best
score of reaching it from the start; used as heuristic of a backward A* search they are
exact, so the search completes segmentations in the order of their score and expands
nothing else.

No piece crosses certain borders (before white space after something else, between a word
and a mark that no piece has behind a letter, and around characters that are in no piece
of two or more), so the lattice falls apart there into
units; the n best of a text are put together from the n best of its units, and these
are kept for units that come again. New units of a block of texts are searched side by
side, as rows of arrays; single long ones with a heap.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import combinations
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from entitymill.llm.common import map_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BLANK = "▁"
#: Letters (ASCII and Latin), and marks that often follow a word.
LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
MARKS = ".,;:!?)"
#: Units of more characters are not kept.
KEPT_LENGTH = 48
#: Cost of a change that does not exist.
NONE = np.iinfo(np.int64).max
#: Score of what can't be; far below any sum of scores of a unit.
NO_WAY = -(2**60)
#: Units that are searched together.
SIDE_BY_SIDE = 4_096


def _bytes_of(ids) -> bytes:
    return np.array(ids, "<u2").tobytes()


class _Steps:
    """A tree of characters as two hash tables (node, character) -> node with exact keys."""

    def __init__(self, tree: dict, bits: int = 20):
        keys, nodes, piece, todo, self.depth = [], [], [-1], [(tree, 0, 0)], 0
        while todo:
            node, number, depth = todo.pop()
            self.depth = max(self.depth, depth)
            for c, child in node.items():
                if c == "":
                    piece[number] = child[1][0]
                else:
                    keys.append(number << 21 | ord(c))
                    nodes.append(len(piece))
                    todo.append((child, len(piece), depth + 1))
                    piece.append(-1)
        self.dead = len(piece)
        self.piece = np.array([*piece, -1], np.int64)
        keys, nodes = np.array(keys, np.int64), np.array(nodes, np.int64)
        self.tables = []
        while len(keys):
            multiplier = np.int64(0x1E3779B97F4A7C15 + 2 * len(self.tables))
            slot = self._slot(keys, multiplier, bits)
            first = np.unique(slot, return_index=True)[1]
            table_keys, table_nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.dead, np.int64)
            table_keys[slot[first]], table_nodes[slot[first]] = keys[first], nodes[first]
            self.tables.append((multiplier, bits, table_keys, table_nodes))
            others = np.ones(len(keys), bool)
            others[first] = False
            keys, nodes, bits = keys[others], nodes[others], 12

    @staticmethod
    def _slot(keys: np.ndarray, multiplier: np.int64, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * multiplier) >> np.int64(64 - bits) & np.int64((1 << bits) - 1)

    def pieces(self, chars: np.ndarray, none: int) -> list[np.ndarray]:
        """Per length - 1, the piece of that length from each position (row) of each text, or ``none``."""
        out, node = [], np.zeros(chars.shape, np.int64)
        for k in range(min(self.depth, len(chars))):
            key = node[: len(chars) - k] << 21 | chars[k:]
            node = np.full(key.shape, self.dead, np.int64)
            for multiplier, bits, keys, nodes in self.tables:
                slot = self._slot(key, multiplier, bits)
                hit = keys[slot] == key
                node[hit] = nodes[slot[hit]]
            piece = self.piece[node]
            out.append(np.where(piece < 0, none, piece))
            if (node == self.dead).all():
                break
        return out


class Lattice:
    """Pieces of a model as a tree of characters, with their scores as whole numbers.

    ``scale`` scores are rounded after multiplication with it: 1 is exact for a model
    whose scores are whole, as those of merge ranks are. A character without a piece is
    spelled by its bytes' pieces.
    """

    def __init__(self, path: str, n: int, scale: int = 1, most: int = 250_000):
        model = SentencePieceProcessor(model_file=path)
        self.n, self.most = n, most
        self.tree: dict = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.score = []
        self.pairs = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.score.append(round(model.get_score(i) * scale))
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(piece.replace(BLANK, " ").encode())
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {piece!r} crosses a border of units")
                self.pairs |= {piece[k : k + 2] for k in range(len(piece) - 1)}
                node = self.tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (self.score[i], (i,))
        joined = "".join(self.pairs)
        lone = "".join(c for c in "\n\t\r" if c not in joined)
        # Where no piece has one of these marks behind a letter, a word ends in front of them.
        behind_letters = {p[1] for p in self.pairs if LETTER.fullmatch(p[0])}
        marks = re.escape("".join(c for c in MARKS if c not in behind_letters))
        word = f"{BLANK}*{LETTER.pattern}++(?![^{BLANK}{marks}{lone}])|" if marks else ""
        self.units = re.compile(word + (f"{BLANK}*[^{BLANK}{lone}]+|{BLANK}+|[{lone}]" if lone else f"{BLANK}*[^{BLANK}]+|{BLANK}+"))
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.steps = _Steps(self.tree)
        # One more piece stands for "none".
        self.scores = np.array([*self.score, NO_WAY], np.int64)

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best segmentations as (score, ids), best first; fewer if there are fewer."""
        size, tree = len(text), self.tree
        # Ways into every position, best first: (best score through it, from where, score, ids).
        into: list[list] = [[] for _ in range(size + 1)]
        here = 0
        for at in range(size):
            if at:
                into[at].sort(reverse=True)
                here = into[at][0][0]
            node, end, lone = tree.get(text[at]), at + 1, True
            while node is not None:
                if "" in node:
                    score, ids = node[""]
                    into[end].append((here + score, at, score, ids))
                    if end == at + 1:
                        lone = False
                node = node.get(text[end]) if end < size else None
                end += 1
            if lone:
                ids = tuple([self.byte_id[b] for b in text[at].encode()])
                score = sum([self.score[i] for i in ids])
                into[at + 1].append((here + score, at, score, ids))
        into[size].sort(reverse=True)
        # (minus the best total through here, newest first, position, which way into it, score
        # of the rest, rest). A way that is taken leaves the next one to the heap.
        heap = [(-into[size][0][0], 0, size, 0, 0, None)]
        out, count = [], 0
        while heap:
            total, _, at, rank, rest, path = heappop(heap)
            while at:
                ways = into[at]
                if rank + 1 < len(ways):
                    count -= 1
                    heappush(heap, (-(ways[rank + 1][0] + rest), count, at, rank + 1, rest, path))
                _, at, score, ids = ways[rank]
                rest, path, rank = rest + score, (ids, path), 0
            ids = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((-total, tuple(ids)))
            if len(out) == n:
                break
        return out

    def _parts(self, unit: str) -> list[str]:
        """``unit`` cut between characters that no piece has next to each other."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in pairs]
        if not cuts:
            return [unit]
        return [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _learn(self, units: set[str]) -> None:
        """Puts the n best segmentations of all ``units`` into the new generation."""
        new = self.new
        # Words of letters have few inner borders, so none are looked for.
        mixed = [u for u in units if len(u) <= KEPT_LENGTH and not u[1:].isalpha()]
        parts = [self._parts(u) for u in mixed]
        wanted = units.difference(mixed)
        for some in parts:
            wanted.update(some)
        wanted = sorted(wanted.difference(new), key=len)
        short = [p for p in wanted if len(p) <= KEPT_LENGTH]
        for a in range(0, len(short), SIDE_BY_SIDE):
            some = short[a : a + SIDE_BY_SIDE]
            for part, found in zip(some, self.n_best_many(some), strict=True):
                new[part] = self._packed(found)
        for part in wanted[len(short) :]:
            found = self.n_best(part, self.n)
            new[part] = self._packed([(score, _bytes_of(ids)) for score, ids in found])
        for unit, some in zip(mixed, parts, strict=True):
            if len(some) > 1:
                ids, score, cost, more = new[some[0]]
                for part in some[1:]:
                    last, added, other, ways = new[part]
                    if ways and more:
                        both = [(a + b, x + y) for a, x in [(0, ids), *more] for b, y in [(0, last), *ways]]
                        both.sort(key=itemgetter(0))
                        more = both[1 : self.n]
                    else:
                        more = [(a, x + last) for a, x in more] or [(b, ids + y) for b, y in ways]
                    ids, score, cost = ids + last, score + added, min(cost, other)
                new[unit] = ids, score, cost, tuple(more)

    def n_best_many(self, texts: list[str]) -> list[list[tuple[int, bytes]]]:
        """``n_best`` of many short texts at once; columns of the arrays are texts.

        The forward pass keeps the ``n`` best ways into every position. The backward
        search then takes, for all texts together, the best way that no path has
        taken so far: its total through the forward scores is exact.
        """
        sizes = np.array([len(t) for t in texts])
        most, count, n = int(sizes.max()), len(texts), self.n
        chars = "".join(t.ljust(most, "\0") for t in texts).encode("utf-32-le")
        chars = np.frombuffer(chars, "<u4").reshape(count, most).T.astype(np.int64)
        pieces = self.steps.pieces(chars, len(self.score))
        spelled = self._spell(chars, pieces)
        scores = np.concatenate([self.scores, [sum(self.score[i] for i in ids) for ids in spelled]]).astype(np.int64)
        # Forward: ways[r] is the r-th best way into a position: total, length and piece.
        total = np.full((n, most + 1, count), NO_WAY, np.int64)
        length = np.zeros((n, most + 1, count), np.int64)
        piece = np.full((n, most + 1, count), len(self.score), np.int64)
        total[0, 0] = 0
        for end in range(1, most + 1):
            reach = min(end, len(pieces))
            into = np.stack([pieces[k][end - 1 - k] for k in range(reach)])
            sums = np.stack([total[0, end - 1 - k] for k in range(reach)]) + scores[into]
            order = np.argsort(-sums, axis=0, kind="stable")[:n]
            ranks = len(order)
            total[:ranks, end] = np.take_along_axis(sums, order, axis=0)
            piece[:ranks, end] = np.take_along_axis(into, order, axis=0)
            length[:ranks, end] = order + 1
        # Backward: paths as steps from the end; an open way at a step is the next best there.
        column = np.arange(count)
        at, rest, step = sizes.copy(), np.zeros(count, np.int64), np.zeros(count, np.int64)
        rank = np.zeros(count, np.int64)
        paths, found = [], [[] for _ in texts]
        none = np.full((most + 1, count), -1, np.int64)
        taken, path = none.copy(), np.zeros(count, np.int64)
        going = np.ones(count, bool)
        for turn in range(n):
            nodes, rests, opened, ranks = none.copy(), none.copy(), np.full((most + 1, count), NO_WAY, np.int64), none.copy()
            sums = np.where(going, total[rank, at, column] + rest, NO_WAY)
            live = going & (at > 0)
            fresh = np.zeros(count, bool)
            while live.any():
                w = column[live]
                t, v, r = step[w], at[w], rank[w]
                nodes[t, w], rests[t, w], ranks[t, w] = v, rest[w], r
                taken[t, w] = piece[r, v, w]
                # The way behind the one that a path branched off by stays with its parent.
                following = np.where(r + 1 < n, total[np.minimum(r + 1, n - 1), v, w], NO_WAY)
                opened[t, w] = np.where((turn > 0) & ~fresh[w], NO_WAY, following + rest[w])
                fresh[w] = True
                rest[w] += scores[taken[t, w]]
                at[w] = v - length[r, v, w]
                rank[w] = 0
                step[w] = t + 1
                live = going & (at > 0)
            paths.append((nodes, rests, opened, ranks, taken.copy()))
            self._collect(found, sums, taken, going, spelled)
            if turn + 1 == n:
                break
            frontier = np.concatenate([p[2] for p in paths])
            pick = frontier.argmax(axis=0)
            going = going & (frontier[pick, column] > NO_WAY // 2)
            path, step = np.divmod(pick, most + 1)
            taken, at, rest, rank = none.copy(), np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
            for j, (nodes, rests, opened, ranks, pieces_of) in enumerate(paths):
                w = column[going & (path == j)]
                t = step[w]
                at[w], rest[w] = nodes[t, w], rests[t, w]
                ranks[t, w] += 1
                rank[w] = ranks[t, w]
                after = np.minimum(rank[w] + 1, n - 1)
                opened[t, w] = np.where(rank[w] + 1 < n, total[after, at[w], w] + rest[w], NO_WAY)
                before = np.arange(most + 1)[:, None] < t
                taken[:, w] = np.where(before, pieces_of[:, w], -1)
        return found

    def _spell(self, chars: np.ndarray, pieces: list[np.ndarray]) -> list[tuple[int, ...]]:
        """Bytes' pieces of characters without a piece of their own, entered as further pieces."""
        lone = pieces[0] == len(self.score)
        values, place = np.unique(chars[lone], return_inverse=True)
        pieces[0][lone] = len(self.score) + 1 + place
        return [tuple(self.byte_id[b] for b in chr(c).encode("utf-8", "replace")) for c in values.tolist()]

    def _collect(self, found: list, sums: np.ndarray, taken: np.ndarray, going: np.ndarray, spelled: list) -> None:
        """Appends (score, ids) of this turn's path of every text that has one."""
        steps = taken[::-1].T
        real = steps >= 0
        ends = np.cumsum(real.sum(axis=1)).tolist()
        plain = steps[real]
        raw = plain.astype("<u2").tobytes()
        odd = ((steps > len(self.score)) & real).any(axis=1).tolist() if spelled else [False] * len(found)
        a = 0
        for k, (b, score, goes) in enumerate(zip(ends, sums.tolist(), going.tolist(), strict=True)):
            if goes and odd[k]:
                ids = [spelled[i - len(self.score) - 1] if i > len(self.score) else (i,) for i in plain[a:b].tolist()]
                found[k].append((score, _bytes_of([i for some in ids for i in some])))
            elif goes:
                found[k].append((score, raw[2 * a : 2 * b]))
            a = b

    def _packed(self, found: list[tuple[int, bytes]]) -> tuple:
        """(best ids, best score, cost of the second best, costs and ids of all but the best)."""
        score, ids = found[0]
        more = tuple([(score - other, changed) for other, changed in found[1:]])
        return ids, score, more[0][0] if more else NONE, more

    def encode(self, text: str) -> list[tuple[int, bytes]]:
        """The ``n`` best segmentations of a text as (score, ids in 16 bits), best first.

        Equal scores come in a fixed order: units late in the text change first.
        """
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[tuple[int, bytes]]]:
        """``encode`` of several texts, whose new units are searched together."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        units_of = [self.units.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        entries_of = [list(map(new.get, units)) for units in units_of]
        missing = set()
        for units, entries in zip(units_of, entries_of, strict=True):
            if None in entries:
                missing.update([u for u, e in zip(units, entries, strict=True) if e is None])
        known = missing.intersection(old)
        new.update([(u, old[u]) for u in known])
        missing -= known
        self._learn(missing)
        out = []
        for units, entries in zip(units_of, entries_of, strict=True):
            if None in entries:
                entries = [new[u] if e is None else e for u, e in zip(units, entries, strict=True)]
            pieces = [e[0] for e in entries]
            score = sum([e[1] for e in entries])
            found = [(score, b"".join(pieces))]
            for cost, changes in self._changes(entries):
                other = pieces.copy()
                for place, rank in changes:
                    other[place] = entries[place][3][rank - 1][1]
                found.append((score - cost, b"".join(other)))
            out.append(found)
        for unit in missing:
            if len(unit) > KEPT_LENGTH:
                del new[unit]
        return out

    def _changes(self, entries: list[tuple]) -> list[tuple[int, list]]:
        """The n - 1 cheapest changes of the best segmentation: (cost, [(unit, rank)]).

        Only the n - 1 cheapest changes of single units can take part: any other is
        preceded by all of those. Of equally cheap ones the last in the text count.
        """
        n = self.n - 1
        if not n or not entries:
            return []
        first = np.array([e[2] for e in entries])
        some = np.arange(len(first))
        if len(first) > n:
            limit = np.partition(first, n - 1)[n - 1]
            some = np.concatenate([np.flatnonzero(first < limit), np.flatnonzero(first == limit)[-n:]])
        single = []
        for place in some.tolist():
            single += [(cost, -place, rank) for rank, (cost, _) in enumerate(entries[place][3], 1)]
        single = sorted(single)[:n]
        options = []
        for size in range(1, len(single) + 1):
            for chosen in combinations(single, size):
                order = sorted((-place, rank) for _, place, rank in chosen)
                if len({place for place, _ in order}) == size:
                    options.append((sum(c for c, _, _ in chosen), [(-place, rank) for place, rank in order]))
        options.sort()
        return [(cost, [(-place, rank) for place, rank in order]) for cost, order in options[:n]]

    def _raw(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids)).removeprefix(b" ")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a segmentation: pieces' bytes without the blank put in front."""
        return self._raw(ids).decode("utf-8", "replace")

    def decodes_to(self, ids: Sequence[int], text: str, raw: bytes) -> bool:
        """Whether ``decode`` gives ``text``, which was read from ``raw``."""
        return self._raw(ids) == raw or self.decode(ids) == text


@lru_cache(maxsize=2)
def _lattice(path: str, n: int) -> Lattice:
    """One per Python worker; its units serve all tasks that the worker runs."""
    return Lattice(path, n)


def segment(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, with_ids: bool = False) -> DataFrame:
    """For every row: id, ``n_found``, ``n_pieces`` and ``score`` of the best segmentation,
    ``scores`` and ``ids_crc32`` of all found (by comma, best first; checksums of the
    ids as little-endian unsigned 32-bit numbers) and ``round_trip``: whether the best
    decodes to the text.

    Null and empty texts have the one empty segmentation. A text that holds the blank
    mark U+2581 itself does not round-trip, as decoding gives a blank. Long texts and
    units without blanks are searched whole; equal texts give equal results; null ids
    are kept; an empty table gives no rows; further columns play no part. ``with_ids``
    adds ``ids``, an array of the found segmentations (16 bits an id).
    """
    added = ", ids array<binary>" if with_ids else ""

    def work():
        lattice = _lattice(path, n)

        def run(texts: list) -> dict:
            names = ("n_found", "n_pieces", "score", "scores", "ids_crc32", "round_trip", "ids")
            columns = {k: [] for k in names}
            raws = [raw or b"" for raw in texts]
            texts = [raw.decode("utf-8", "replace") for raw in raws]
            # Units make no reference cycles, but very many objects to look for cycles in.
            gc.disable()
            try:
                encoded = lattice.encode_all(texts)
            finally:
                gc.enable()
            for raw, text, found in zip(raws, texts, encoded, strict=True):
                ids = [np.frombuffer(i, "<u2") for _, i in found]
                values = (
                    len(found), len(ids[0]), found[0][0], ",".join(str(s) for s, _ in found),
                    ",".join(str(zlib.crc32(i.astype("<u4").tobytes())) for i in ids),
                    lattice.decodes_to(ids[0].tolist(), text, raw), [i for _, i in found],
                )
                for k, v in zip(names, values, strict=True):
                    columns[k].append(v)
            if with_ids:
                columns["ids"] = pa.array(columns["ids"], pa.list_(pa.binary()))
            return columns

        return run

    schema = "n_found long, n_pieces long, score long, scores string, ids_crc32 string, round_trip boolean"
    return map_texts(docs, text_col, [id_col], schema + added, work)
