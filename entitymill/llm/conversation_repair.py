"""Cheapest repairs of conversations whose roles must read ``(s?(ua)+)?`` by their initials.

Every row becomes one symbol: the initial of its role, or that it must go (blank or a
duplicate), or that it is truncated. A conversation is thus a word. Words are cut into
chunks, and the distinct chunks, sorted from their ends, make up an automaton in which
equal suffixes are one node. Cost-to-go and best audit suffix are computed once for
each node and state of the grammar, for all conversations that pass it.

A conversation may hold any share of the rows: what lies behind a chunk enters as the
costs of the four states, which follow from products of the chunks' transition costs
along ranges of sorted chunks, and one product per range on the driver.

Nulls: a null role or text counts as one blank, rows without a conversation id form a
conversation, rows without a turn come first. Rows of equal turns come in the order of
a digest of role and text. Roles other than system, user and assistant (by initial) can
be reroled or deleted, but not kept. Empty tables give no rows; further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import SPACE, written
from entitymill.sources.staging import share_code

#: Rows a chunk; the costs below; a cost that no way has.
CHUNK = 256
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 40
#: The grammar: states 0 start, 1 behind system, 2 behind user, 3 behind assistant; 0 and 3 may end.
STATES = 4
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURNS = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
MUST_GO = "x"
#: What lies behind the last chunk: costs to an end, and the edits there.
END = ((0, 4, 2, 0), ("", "II", "I", ""))
PIECE_BYTES = 1_000_000
MOST_SEEN = 100_000


# ---- the automaton ---------------------------------------------------------


class Automaton:
    """Suffix-shared automaton over words that come sorted by their reversed symbols.

    Node ``d`` of the stack stands for the last ``d`` symbols of the word at hand and
    holds, for each state: cost-to-go, best audit suffix, and the state behind the word.
    Nodes of the suffix that the next word shares stay as they are.
    """

    def __init__(self, costs: Sequence[int], audits: Sequence[str] = ("",) * STATES):
        self.word = ""
        self.nodes = [[(costs[s], audits[s], s) for s in range(STATES)]]

    def solve(self, word: str) -> list[tuple[int, str, int]]:
        """(cost, audit, state behind) for every state in front of ``word``."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[-1 - shared] == self.word[-1 - shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reversed(word[: len(word) - shared]):
            self.nodes.append(step(symbol, self.nodes[-1]))
        self.word = word
        return self.nodes[-1]


def step(symbol: str, behind: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The node in front of ``symbol``, given the node behind it.

    No two edits of a state share a letter, so the least (cost, letter) is the least
    (cost, audit).
    """
    role, cut = symbol.lower(), TRUNCATED * symbol.isupper()

    def edit(letter: str, cost: int, at: tuple[int, str, int]) -> tuple[int, str, int]:
        return min(cost + at[0], NEVER), letter + at[1], at[2]

    out = []
    for s in range(STATES):
        ways = [edit("D", DELETE, behind[s])]
        if symbol != MUST_GO:
            if role in KEEPS[s]:
                ways.append(edit("K", cut, behind[KEEPS[s][role]]))
            ways.append(edit("R", REROLE + cut, behind[TURNS[s]]))
        out.append(min(ways))
    user, assistant = out[2], out[3]
    out[2] = min(user, edit("I", INSERT, assistant))
    out[3] = min(assistant, edit("I", INSERT, user))
    for s in (0, 1):
        out[s] = min(out[s], edit("I", INSERT, out[2]))
    return out


def product(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Of two matrices of transition costs (row by row): first ``a``, then ``b``, cheapest way between."""
    a, b = np.array(a).reshape(STATES, STATES), np.array(b).reshape(STATES, STATES)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NEVER).ravel().tolist()


IDENTITY = [0 if s == t else NEVER for s in range(STATES) for t in range(STATES)]


# ---- rows ------------------------------------------------------------------


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit(""))


def _blank(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(" "))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``id:turn`` modulo 20: 0 drops the row, 1
    empties its text, 2 removes the marks ``.!?``, 3 repeats it, 4 makes it the user's."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    fate = F.crc32(F.concat(_blank(conv), F.lit(":"), _blank(turn)).cast("binary")) % 20
    rows = conversations.select(conv.alias("conv"), turn.cast("long").alias("turn"), _blank(role).alias("role"), _blank(text).alias("text"), fate.alias("fate"))
    plain = F.translate("text", ".!?", "")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, plain).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    rows = rows.where("fate <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def _rows(conversations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """key, place (rank, turn, digest) and role, text of every row."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in columns)
    rows = conversations.select(
        _key(conv).alias("key"), turn.isNotNull().cast("int").alias("rank"),
        F.coalesce(turn.cast("long"), F.lit(0)).alias("turn"), _blank(role).alias("role"), _blank(text).alias("text"),
    )
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.withColumn("digest", digest)


PLACE = ["key", "rank", "turn", "digest"]


def _numbered(rows: DataFrame) -> DataFrame:
    """The sorted rows in range partitions, written, with ``range``, ``at`` (place among the
    rows of the conversation in the range) and ``prev`` (initial of the row before, there)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, initial, place = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, initials = batch.column("key"), batch.column("initial")
            before = pa.concat_arrays([pa.array([key], pa.string()), keys.slice(0, n - 1)])
            starts = pc.fill_null(pc.not_equal(keys, before), True).to_numpy(zero_copy_only=False)
            count = np.arange(n)
            at = count - np.maximum.accumulate(np.where(starts, count, -place))
            prev = pa.concat_arrays([pa.array([initial], pa.string()), initials.slice(0, n - 1)])
            prev = pc.if_else(pa.array(starts), pa.scalar(None, pa.string()), prev)
            key, initial, place = keys[n - 1].as_py(), initials[n - 1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at, pa.int64()), prev],
                names=[*batch.schema.names, "range", "at", "prev"],
            )

    ranges = rows.repartitionByRange(*PLACE, F.monotonically_increasing_id()).sortWithinPartitions(*PLACE)
    return written(ranges.mapInArrow(number, f"{fields}, range int, at long, prev string"), "repair-rows")


def _marked(conversations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row's place, symbol and first fault, without its text."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    fault = F.when(trimmed == "", "blank").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    rows = _rows(conversations, columns)
    rows = rows.select(*PLACE, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    rows = _numbered(rows)
    firsts = rows.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("range", "at")).alias("first"))
    firsts = written(firsts.where("n > 1").drop("n"), "repair-repeats")
    seen = (F.col("first") < F.struct("range", "at")) & ~F.col("fault").eqNullSafe(F.lit("blank"))
    rows = rows.join(firsts, ["key", "digest"], "left")
    rows = rows.withColumn("fault", F.when(seen, "duplicate").otherwise(F.col("fault"))).drop("first")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return rows.withColumn("symbol", symbol)


def _facts(marked: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated and illegal of every conversation."""
    # One row per range: the ends meet where a conversation goes on in the next range.
    edge = F.struct("key", "initial")
    order = F.struct(*PLACE, "at")
    ends = marked.groupBy("range").agg(F.min_by(edge, order).alias("first"), F.max_by(edge, order).alias("last")).orderBy("range").collect()
    meets = [
        (b["first"]["key"], int(a["last"]["initial"] + b["first"]["initial"] not in ("su", "ua", "au")))
        for a, b in zip(ends, ends[1:])
        if a["last"]["key"] == b["first"]["key"]
    ]
    bad = F.col("prev").isNotNull() & ~F.concat("prev", "initial").isin("su", "ua", "au")
    turn = F.when(F.col("rank") == 1, F.col("turn"))
    faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.max(turn).cast("decimal(20,0)") - F.min(turn).cast("decimal(20,0)") + 1 - F.count_distinct(turn)
    facts = marked.groupBy("key").agg(F.coalesce(gaps.try_cast("long"), F.lit(0).cast("long")).alias("gaps"), *faults, F.count(F.when(bad, 1)).alias("bad"))
    meets = marked.sparkSession.createDataFrame(meets, "key string, met long").groupBy("key").agg(F.sum("met").alias("met"))
    facts = facts.join(meets, "key", "left")
    return facts.select("key", "gaps", "blank", "duplicate", "truncated", (F.col("bad") + F.coalesce("met", F.lit(0))).alias("illegal"))


# ---- chunks ----------------------------------------------------------------


def _chunks(marked: DataFrame, rows_a_chunk: int) -> DataFrame:
    """One row per chunk: key, place (range, block), ``word`` and the places of its rows."""
    row = F.struct("at", "symbol", "rank", "turn", "digest")
    block = (F.col("at") / rows_a_chunk).cast("long").alias("block")
    chunks = marked.groupBy("key", "range", block).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    word = F.array_join(F.col("rows.symbol"), "")
    chunks = chunks.select("key", "range", "block", word.alias("word"), F.transform("rows", lambda r: r.dropFields("at", "symbol")).alias("rows"))
    return written(chunks, "repair-chunks")


def _placed(chunks: DataFrame) -> DataFrame:
    """``chunks`` without their rows, with ``first``, ``last`` and ``only`` of their conversation."""
    place = F.struct("range", "block")
    ends = chunks.groupBy("key").agg(F.min(place).alias("start"), F.max(place).alias("end"))
    flags = [(place == F.col("start")).alias("first"), (place == F.col("end")).alias("last"), (F.col("start") == F.col("end")).alias("only")]
    return written(chunks.drop("rows").join(ends, "key").select("key", "range", "block", "word", *flags), "repair-places")


def _solved(words: DataFrame) -> DataFrame:
    """Of the distinct (word, behind): costs, audits and states behind, for each state in front.

    ``behind`` is ``end``, ``unit t`` (only state t may lie behind) or four costs. Words are
    range-sorted from their ends, so the words of a task share what their ends share.
    """
    reverse = F.reverse("word")
    # Only the words' ends decide the ranges; what one task begins another may have to repeat.
    words = words.distinct().repartitionByRange("behind", reverse).sortWithinPartitions("behind", reverse)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, automaton = None, None
        for batch in batches:
            out = []
            for word, behind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if behind != kind:
                    kind, automaton = behind, _automaton(behind)
                out.append(list(zip(*automaton.solve(word), strict=True)))
            costs, audits, states = ([list(x[k]) for x in out] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())),
                 pa.array(states, pa.list_(pa.int32()))],
                names=["word", "behind", "costs", "audits", "states"],
            )

    return words.mapInArrow(solve, "word string, behind string, costs array<long>, audits array<string>, states array<int>")


def _automaton(behind: str) -> Automaton:
    if behind == "end":
        return Automaton(*END)
    if behind.startswith("unit "):
        return Automaton([0 if s == int(behind[5:]) else NEVER for s in range(STATES)])
    return Automaton([int(c) for c in behind.split(",")])


def prefix_products(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` (key, range, block, matrix) with ``before``: the product of the matrices of all
    rows of the key that come first in ``order`` (by which rows are unique within a key).

    Products run inside range partitions; the driver gets one row per range.
    """
    spark = rows.sparkSession
    kind = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, first, so_far = TaskContext.get().partitionId(), None, None, IDENTITY
        for batch in batches:
            before, opening, totals = [], [], []
            for k, matrix in zip(batch.column("key").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                first = k if first is None else first
                if k != key:
                    key, so_far = k, IDENTITY
                before.append(so_far)
                opening.append(k == first)
                so_far = product(so_far, matrix)
                totals.append(so_far)
            n = len(before)
            columns = [pa.array([part] * n, pa.int32()), pa.array(opening, pa.bool_()), *(pa.array(x, pa.list_(pa.int64())) for x in (before, totals))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "opening", "before", "total"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    ranges = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ranges = written(ranges.mapInArrow(run, f"{fields}, part int, opening boolean, before array<long>, total array<long>"), "repair-products")
    last = F.max_by(F.struct("key", "total", "opening"), F.struct("key", *order))
    ends = ranges.groupBy("part").agg(last.alias("last"), F.min("key").alias("first")).orderBy("part").collect()
    carried, key, coming = IDENTITY, None, {}
    for e in ends:
        into = carried if key == e["first"] else IDENTITY
        coming[e["part"]] = into
        carried, key = list(e["last"]["total"]), e["last"]["key"]
        if e["last"]["opening"]:
            carried = product(into, carried)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "opening", "before"))
            before = [product(coming[p], b) if o else b for p, o, b in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kind), pa.array(before, pa.list_(pa.int64()))], names=[*(f.name for f in kind), "before"])

    share_code(spark)
    return ranges.mapInArrow(join, f"{fields}, before array<long>")


def _audited(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their best ``audit`` and its ``cost`` (of all from this chunk on, in first chunks) and ``entry`` state."""
    several = chunks.where("NOT only")
    units = several.select("word", F.explode(F.array(*[F.lit(f"unit {t}") for t in range(STATES)])).alias("behind"))
    # One row per word, with its four columns of transition costs.
    units = _solved(units).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("behind", "costs"))).alias("u"))
    across = F.flatten(F.col("u.costs"))  # column by column: the transposed matrix, row by row
    units = written(units.select("word", across.alias("matrix")), "repair-units")
    matrices = several.select("key", "range", "block", "word", "last").join(units, "word").drop("word")
    # From the last chunk back: products of transposed matrices.
    behind = prefix_products(matrices, [-F.col("range"), -F.col("block")])
    # Costs of the four states behind a chunk: the transposed product, applied to the costs at the end.
    ends = F.array(*[F.lit(c) for c in END[0]])
    costs = F.transform(
        F.sequence(F.lit(0), F.lit(STATES - 1)),
        lambda s: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda t: F.get(F.col("before"), t * STATES + s) + F.get(ends, t))),
    )
    behind = behind.withColumn("costs", costs).withColumn("least", F.array_min("costs"))
    offsets = F.array_join(F.transform("costs", lambda c: (c - F.col("least")).cast("string")), ",")
    behind = behind.select("key", "range", "block", F.when(F.col("last"), "end").otherwise(offsets).alias("behind"), F.when(F.col("last"), 0).otherwise(F.col("least")).alias("least"))
    alone = chunks.where("only").select("key", "range", "block", F.lit("end").alias("behind"), F.lit(0).cast("long").alias("least"))
    behind = written(behind.unionByName(alone), "repair-behind")
    chunks = chunks.join(behind, ["key", "range", "block"])
    solved = written(_solved(chunks.select("word", "behind")), "repair-solved")
    chunks = written(chunks.join(solved, ["word", "behind"]), "repair-answers")
    # From the first chunk on: which state each one starts in.
    moves = F.flatten(F.transform("states", lambda t: F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.when(t == s, F.lit(0)).otherwise(F.lit(NEVER)).cast("long"))))
    moves = chunks.where("NOT only").select("key", "range", "block", moves.alias("matrix"))
    entries = prefix_products(moves, [F.col("range"), F.col("block")])
    entry = F.array_position(F.slice("before", 1, STATES), F.lit(0).cast("long")) - 1
    entries = entries.select("key", "range", "block", entry.cast("int").alias("entry"))
    alone = chunks.where("only").select("key", "range", "block", F.lit(0).alias("entry"))
    chunks = chunks.join(entries.unionByName(alone), ["key", "range", "block"])
    audit = F.get(F.col("audits"), F.col("entry"))
    cost = F.when(F.col("first"), F.get(F.col("costs"), F.col("entry")) + F.col("least"))
    columns = ["key", "range", "block", "word", "entry"]
    return written(chunks.select(*columns, audit.alias("audit"), cost.alias("cost")), "repair-audits")


# ---- outputs ---------------------------------------------------------------


class Repair:
    """Repairs of all conversations of a table: ``conversations()`` with facts and audits, ``rows()`` repaired."""

    def __init__(
        self, table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
        rows_a_chunk: int = CHUNK,
    ):
        share_code(table.sparkSession)
        self.table, self.columns = table, (conv_col, turn_col, role_col, text_col)
        self.marked = written(_marked(table, self.columns), "repair-marked")
        self.chunks = _chunks(self.marked, rows_a_chunk)
        self.audited = _audited(_placed(self.chunks))

    def conversations(self) -> DataFrame:
        """key, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``."""
        part = F.struct("range", "block", "audit")
        audits = self.audited.groupBy("key").agg(F.max("cost").alias("cost"), F.sort_array(F.collect_list(part)).alias("parts"))
        audits = audits.select("key", "cost", F.array_join(F.col("parts.audit"), "").alias("audit"))
        return _facts(self.marked).join(audits, "key")

    def _edits(self) -> DataFrame:
        """One row per row that stays (place, ``inserted`` names in front, new ``role`` if any), one
        per conversation with what is inserted at its end (rank 2)."""

        def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for key, word, rows, state, audit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    # No insertion comes just before a deletion: the other way round is less in ASCII.
                    place, inserted = 0, []
                    for letter in audit:
                        if letter == "I":
                            state = TURNS[state]
                            inserted.append(NAMES[state])
                            continue
                        if letter != "D":
                            state, role = (KEEPS[state][word[place].lower()], None) if letter == "K" else (TURNS[state], NAMES[TURNS[state]])
                            row = rows[place]
                            out.append((key, row["rank"], row["turn"], row["digest"], inserted, role))
                            inserted = []
                        place += 1
                    if inserted:
                        out.append((key, 2, 0, b"", inserted, MUST_GO))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)

        schema = pa.schema([("key", pa.string()), ("rank", pa.int32()), ("turn", pa.int64()), ("digest", pa.binary()), ("inserted", pa.list_(pa.string())), ("role", pa.string())])
        found = self.audited.join(self.chunks.drop("word"), ["key", "range", "block"]).select("key", "word", "rows", "entry", "audit")
        return found.mapInArrow(edits, "key string, rank int, turn long, digest binary, inserted array<string>, role string")

    def rows(self) -> DataFrame:
        """The repaired rows (key, role, text) in range partitions, in order inside each.

        Texts are shuffled once: edits and rows are sorted together, and a row without an
        edit in front is gone. Copies of a row are dropped before the shuffle, task by task.
        """
        edits = self._edits().withColumns({"text": F.lit(None).cast("string"), "kind": F.lit(0)})
        texts = _one_of_each(_rows(self.table, self.columns)).withColumns({"inserted": F.lit(None).cast("array<string>"), "kind": F.lit(1)})
        both = edits.unionByName(texts).repartitionByRange(*PLACE).sortWithinPartitions(*PLACE, "kind")
        names = ["key", "digest", "inserted", "kind", "role", "text"]

        def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edit = None
            for batch in batches:
                out = []
                for key, digest, inserted, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == 0:
                        out += [(key, name, "") for name in inserted]
                        edit = None if role == MUST_GO else (key, digest, role)
                    elif edit and edit[:2] == (key, digest):
                        out.append((key, edit[2] or role, text))
                        edit = None
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["key", "role", "text"])

        return both.select(*names).mapInArrow(repaired, "key string, role string, text string")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` without copies that the same task has had among its last ``MOST_SEEN`` places or so."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for place in zip(*(batch.column(c).to_pylist() for c in PLACE), strict=True):
                keep.append(place not in seen)
                seen.add(place)
            if len(seen) > MOST_SEEN:
                seen.clear()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(distinct, fields)


def digests(repaired: DataFrame) -> DataFrame:
    """(key, ``repaired_sha256``) over the ``role:text`` lines of ``Repair.rows()``, joined by line feeds.

    Conversations that lie inside a range, up to ``PIECE_BYTES``, are hashed where they are.
    A hash runs through its text in order, so the others' lines go, in pieces, to one task a
    conversation, which hashes them one after the other.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, lines, size, number, loose = TaskContext.get().partitionId(), None, [], 0, 0, True

        def row(last: bool):
            data = b"\n".join(lines)
            if last and not loose:
                return key, hashlib.sha256(data).hexdigest(), part, number, None
            return key, None, part, number, data

        for batch in batches:
            out = []
            for k, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if lines:
                        out.append(row(True))
                    # The first conversation of a range may have begun in another.
                    loose, lines, size, number = key is None, [], 0, number + 1
                    key = k
                line = f"{role}:{text}".encode()
                lines.append(line)
                size += len(line) + 1
                if size >= PIECE_BYTES:
                    loose = True
                    out.append(row(False))
                    lines, size, number = [], 0, number + 1
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
        if lines:
            loose = True
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row(True), strict=True))], schema=schema)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k == key:
                    sha.update(b"\n")
                else:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(data)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["key", "sha"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["key", "sha"])

    schema = pa.schema([("key", pa.string()), ("sha", pa.string()), ("range", pa.int32()), ("number", pa.int64()), ("piece", pa.binary())])
    found = written(repaired.mapInArrow(hashed, "key string, sha string, range int, number long, piece binary"), "repair-hashes")
    loose = found.where("sha IS NULL").repartition("key").sortWithinPartitions("key", "range", "number")
    loose = loose.select("key", "piece").mapInArrow(closed, "key string, sha string")
    return found.where("sha IS NOT NULL").select("key", "sha").unionByName(loose).withColumnRenamed("sha", "repaired_sha256")


def audit_conversations(table: DataFrame, damaged: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Facts, cost, audit and digest of the repairs of ``damaged``, for every conversation id of
    ``table``; ids without a row get zeros, an empty audit and the digest of nothing."""
    repair = Repair(damaged, conv_col)
    found = repair.conversations().join(digests(repair.rows()), "key", "left")
    ids = table.select(F.col(f"`{conv_col}`").alias(conv_col)).distinct()
    ids = ids.withColumn("key", _key(F.col(conv_col)))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, "key", "left").select(
        conv_col,
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
