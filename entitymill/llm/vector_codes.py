"""Vector codes by Lloyd's algorithm whose members stay where they are.

Vectors are cut into parts, each position with a codebook of its own. Parts lie in a
table partitioned by (position, entry, salt). In every round the tasks that own the parts
of an entry add up its resident members, the entries become their means, and the owners
compare their members with the new entries: members that keep their entry are written
where they are, and only those that change it take part in the next shuffle.

A row of the table is a block of parts of one (position, entry); their numbers and components
lie in two binary columns, so Spark moves blocks and numpy works on whole arrays. All
arithmetic is exact: components become whole numbers, entries are floors of means.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import scratch
from entitymill.sources.staging import remove, share_code

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of a component once scaled.
MOST = 1 << 62
#: Parts a block.
BLOCK = 4_096
#: Kinds of rows: blocks that stay, blocks that move, sums of an owner, ids and labels of vectors.
MEMBER, MOVER, SUM, NAME = "member", "mover", "sum", "name"


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers; components beyond ``MOST`` are refused."""
    out = np.floor(values.astype(np.float64) * scale)
    if out.size and not np.abs(out).max() < MOST:
        raise ValueError(f"a component is too large for whole numbers: {values.flat[np.abs(out).argmax()]}")
    return out.astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equal ones) to each part, and the squared distance."""
    top = max(int(np.abs(a).max()) if a.size else 0 for a in (parts, entries))
    if 4 * top * top * parts.shape[1] >= 1 << 63:  # Python's whole numbers have no bound.
        parts, entries = parts.astype(object), entries.astype(object)
    distances = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    found = distances.argmin(axis=1)
    return found, distances[np.arange(len(parts)), found]


class Sums:
    """Counts and exact component sums of the members of each (position, entry)."""

    def __init__(self):
        self.cells: dict[tuple[int, int], list] = {}

    def add(self, position: int, entry: int, parts: np.ndarray) -> None:
        if not len(parts):
            return
        # Half words, so that no sum of a block overflows.
        low, high = (parts & 0xFFFFFFFF).sum(axis=0).tolist(), (parts >> 32).sum(axis=0).tolist()
        total = self.cells.setdefault((position, entry), [0, [0] * parts.shape[1]])
        total[0] += len(parts)
        total[1] = [t + (h << 32) + l for t, h, l in zip(total[1], high, low, strict=True)]


class Blocks:
    """Parts gathered by (position, entry), given out as blocks of up to ``BLOCK``.

    Blocks of an entry take turns in their salts, as it may have any share of all parts.
    """

    def __init__(self, kind: str, salts: int = 1, salt: int = 0):
        self.kind, self.salts, self.salt = kind, salts, salt
        self.waiting: dict[tuple[int, int], list] = {}
        self.out: list[dict] = []

    def add(self, position: int, entry: int, rows: np.ndarray, parts: np.ndarray) -> None:
        for a in range(0, len(rows), BLOCK):
            held = self.waiting.setdefault((position, entry), [0, [], []])
            held[0] += len(rows[a : a + BLOCK])
            held[1].append(rows[a : a + BLOCK])
            held[2].append(parts[a : a + BLOCK])
            if held[0] >= BLOCK:
                self._close(position, entry)

    def _close(self, position: int, entry: int) -> None:
        n, rows, parts = self.waiting.pop((position, entry))
        self.salt = (self.salt + 1) % self.salts
        self.out.append({
            "position": position, "entry": entry, "salt": self.salt, "n": n, "rows": np.concatenate(rows).astype("<i8").tobytes(),
            "parts": np.concatenate(parts).astype("<i8").tobytes(), "kind": self.kind,
        })

    def taken(self, last: bool = False) -> list[dict]:
        """The blocks that are full, or at last all."""
        for position, entry in list(self.waiting) if last else []:
            self._close(position, entry)
        out, self.out = self.out, []
        return out


def _parts_of(rows: bytes, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(rows, "<i8")
    return numbers, np.frombuffer(parts, "<i8").reshape(len(numbers), -1)


class Lloyd:
    """Codebooks of a table of vectors, and the members that they were made from."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int, entries: int, scale: int):
        self.spark, self.parts, self.scale = vectors.sparkSession, parts, scale
        share_code(self.spark)
        vector, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
        rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), vector.cast("array<double>").alias("vector"))
        finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        kept = rows.where(F.col("vector").isNotNull() & finite)
        self.width, self.codebooks = self._first_entries(kept, entries)
        fits = (F.size("vector") == self.width) if self.width else F.lit(False)
        self.misfits = kept.where(~fits).select("id", "label")
        self.kept = kept.where(fits)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        id_type, label_type = (_arrow_type(rows.schema[c]) for c in ("id", "label"))
        self.name_types = pa.list_(id_type), pa.list_(label_type)
        self.schema = pa.schema(
            [("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("rows", pa.binary()), ("parts", pa.binary()),
             ("sums", pa.list_(pa.decimal128(38, 0))), ("ids", self.name_types[0]), ("labels", self.name_types[1]), ("kind", pa.string())]
        )
        self.fields = (
            "position int, entry int, salt int, n long, rows binary, parts binary, sums array<decimal(38,0)>,"
            f" ids array<{kinds['id']}>, labels array<{kinds['label']}>, kind string"
        )
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # Many salts: an entry may have any share of a position's members.
        self.salts = max(1, self.partitions // parts)
        self.moved: list[int] = []

    def _first_entries(self, kept: DataFrame, entries: int) -> tuple[int, np.ndarray]:
        """Width of the vectors, and the codebooks (position, entry, component) of the smallest ids."""
        whole = kept.where((F.size("vector") > 0) & (F.size("vector") % self.parts == 0))
        first = whole.orderBy(F.asc_nulls_last("id"), "vector").select(F.size("vector").alias("width")).first()
        if first is None:
            return 0, np.zeros((self.parts, 0, 0), np.int64)
        whole = whole.where(F.size("vector") == first["width"])
        ids = [r["id"] for r in whole.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
        chosen = F.col("id").isin([i for i in ids if i is not None])
        if None in ids:
            chosen = chosen | F.col("id").isNull()
        found = whole.where(F.coalesce(chosen, F.lit(False))).groupBy("id").agg(F.min("vector").alias("vector"))
        found = found.orderBy(F.asc_nulls_last("id")).collect()
        whole_numbers = scaled(np.array([r["vector"] for r in found]), self.scale)
        return first["width"], whole_numbers.reshape(len(found), self.parts, -1).transpose(1, 0, 2)

    # ---- passes ------------------------------------------------------------

    def _cut(self, path: str) -> None:
        """Write all parts as movers to their nearest first entries, and the vectors' ids and labels."""
        codebooks, schema, parts, scale, width, salts = self.codebooks, self.schema, self.parts, self.scale, self.width, self.salts
        name_types = self.name_types

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            movers = Blocks(MOVER, salts, TaskContext.get().partitionId() % salts)
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                numbers = batch.column("row").to_numpy()
                vectors = scaled(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, width), scale)
                for p, values in enumerate(np.split(vectors, parts, axis=1)):
                    _spread(movers, p, nearest(values, codebooks[p])[0], numbers, values)
                ends = pa.array([0, n], pa.int32())
                names = [pa.ListArray.from_arrays(ends, batch.column(c)).cast(t) for c, t in zip(("id", "label"), name_types, strict=True)]
                some = {"n": pa.array([n], pa.int64()), "rows": pa.array([numbers.astype("<i8").tobytes()], pa.binary()),
                        "ids": names[0], "labels": names[1], "kind": pa.array([NAME])}
                yield pa.RecordBatch.from_arrays([some.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
                yield pa.RecordBatch.from_pylist(movers.taken(), schema=schema)
            yield pa.RecordBatch.from_pylist(movers.taken(True), schema=schema)

        self._write(self.kept.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, self.fields), path)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)

    def _settled(self, movers: DataFrame, path: str) -> None:
        """Shuffle the blocks of ``movers`` to the owners of their entries, and write them there with their sums."""
        dealt = movers.repartition(self.partitions, "position", "entry", "salt").sortWithinPartitions("position", "entry")
        self._owned(dealt, None, path)

    def _owned(self, members: DataFrame, codebooks: np.ndarray | None, path: str) -> None:
        """One pass of the owners over ``members``: those that stay and their sums, and those that move.

        Without ``codebooks`` all stay.
        """
        schema, salts = self.schema, self.salts

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, stay, move = Sums(), Blocks(MEMBER), Blocks(MOVER, salts, TaskContext.get().partitionId() % salts)
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("position", "entry", "rows", "parts"))
                for position, entry, rows, parts in zip(*columns, strict=True):
                    rows, parts = _parts_of(rows, parts)
                    new = np.full(len(rows), entry) if codebooks is None else nearest(parts, codebooks[position])[0]
                    same = new == entry
                    sums.add(position, entry, parts[same])
                    stay.add(position, entry, rows[same], parts[same])
                    _spread(move, position, new[~same], rows[~same], parts[~same])
                yield pa.RecordBatch.from_pylist(stay.taken() + move.taken(), schema=schema)
            rest = [{"position": p, "entry": e, "n": n, "sums": s, "kind": SUM} for (p, e), (n, s) in sums.cells.items()]
            yield pa.RecordBatch.from_pylist(stay.taken(True) + move.taken(True) + rest, schema=schema)

        self._write(members.mapInArrow(own, self.fields), path)

    def _read(self, paths: Sequence[str], kind: str) -> DataFrame:
        frames = [self.spark.read.schema(self.fields).parquet(p).where(F.col("kind") == kind) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    def _means(self, paths: Sequence[str]) -> np.ndarray:
        """The entries' next values, from the sums of their owners; entries without members stay.

        The driver gets one row per entry and component.
        """
        cells = self._read(paths, SUM).select("position", "entry", "n", F.posexplode("sums").alias("at", "value"))
        cells = cells.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        out = self.codebooks.copy()
        for r in cells.collect():
            out[r["position"], r["entry"], r["at"]] = int(r["value"]) // r["n"]
        return out

    def train(self, rounds: int) -> None:
        """``rounds`` rounds of assigning all parts and averaging; the members lie under ``self.paths`` afterwards."""
        self.names = scratch(self.spark, "codes-cut")
        self.paths = [scratch(self.spark, "codes-members")]
        self._cut(self.names)
        self._settled(self._read([self.names], MOVER), self.paths[0])
        remove(self.spark, f"{self.names}/kind={MOVER}")
        for r in range(rounds):
            self.codebooks = self._means(self.paths)
            if r + 1 == rounds:
                break
            stayed, arrived = scratch(self.spark, "codes-members"), scratch(self.spark, "codes-arrived")
            self._owned(self._read(self.paths, MEMBER), self.codebooks, stayed)
            movers = self._read([stayed], MOVER)
            self.moved.append(movers.agg(F.sum("n")).first()[0] or 0)
            self._settled(movers, arrived)
            for path in self.paths:
                remove(self.spark, path)
            self.paths = [stayed, arrived]

    def codes(self) -> DataFrame:
        """(id, label, code, error) of every kept vector with the final codebooks."""
        codebooks = self.codebooks

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for position, rows, parts in zip(*(batch.column(c).to_pylist() for c in ("position", "rows", "parts")), strict=True):
                    rows, parts = _parts_of(rows, parts)
                    entry, error = nearest(parts, codebooks[position])
                    columns = [pa.array(rows), pa.array(np.full(len(rows), position, np.int32)), pa.array(entry.astype(np.int32)),
                               pa.array(error if error.dtype == np.int64 else error.tolist(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "position", "entry", "error"])

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    rows = np.frombuffer(batch.column("rows")[k].as_py(), "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(rows), *(batch.column(c)[k].values for c in ("ids", "labels"))], names=["_row", "id", "label"])

        parts = self._read(self.paths, MEMBER).mapInArrow(code, "row long, position int, entry int, error long")
        digits = F.struct("position", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("digits"))
        whole = parts.groupBy("row").agg(F.sort_array(F.collect_list(digits)).alias("digits"), F.sum("error").alias("error"))
        kinds = [self.misfits.schema[c].dataType.simpleString() for c in ("id", "label")]
        names = self._read([self.names], NAME).mapInArrow(name, f"_row long, id {kinds[0]}, label {kinds[1]}")
        whole = whole.join(names, whole["row"] == names["_row"])
        whole = whole.select("id", "label", F.array_join(F.col("digits.digits"), "").alias("code"), "error")
        misfits = self.misfits.withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
        return whole.unionByName(misfits)

    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.codebooks.ravel().tolist()).encode()).hexdigest()


def _spread(blocks: Blocks, position: int, entry: np.ndarray, rows: np.ndarray, parts: np.ndarray) -> None:
    """Put parts into the blocks of their entries."""
    for e in np.unique(entry).tolist():
        at = entry == e
        blocks.add(position, e, rows[at], parts[at])


def _arrow_type(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Lloyd]:
    """(id, label, ``code``, ``error``) of every vector, and what gives its codebooks.

    Vectors that are null or hold a null or non-finite component are dropped. The first
    entries are those of the smallest ids (null last; of rows with equal ids the least
    vector); fewer ids make fewer entries. Vectors that differ in width from that of the
    smallest id, or can't be cut evenly, take no part and have neither code nor error.
    Repeated rows count as often as they are there; an empty table has no codes; further
    columns play no part. Errors beyond a long are refused.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits: 256 entries at most")
    lloyd = Lloyd(vectors, id_col, vector_col, label_col, parts, entries, scale)
    lloyd.train(rounds)
    return lloyd.codes(), lloyd


def decode(codes: Sequence[str], lloyd: Lloyd) -> np.ndarray:
    """The scaled vectors that codes stand for."""
    indexes = np.array([list(bytes.fromhex(c)) for c in codes], int).reshape(len(codes), lloyd.parts)
    return lloyd.codebooks[np.arange(lloyd.parts), indexes].reshape(len(codes), -1)
