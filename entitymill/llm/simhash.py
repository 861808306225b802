"""SimHash near-duplicates by covering locality-sensitive hashing.

Covering: every bit position i gets a code c(i) of ``radius + 1`` bits; for each
nonzero v the table v keeps the bits with an odd inner product <c(i), v>. For any
``radius`` positions some nonzero v is orthogonal to all their codes, so the two
fingerprints agree on everything that table v keeps: every pair within the radius
meets in some table, for certain.

Small buckets are compared directly; a bucket with many fingerprints is split by
writing, for every choice of ``radius`` bits that its table does not keep, the
fingerprint with those bits cleared: fingerprints within the radius share such a
key, at most 2 ** radius fingerprints can have the same one, and all of those are
linked. No bucket is cut and none is compared all against all beyond that size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import free_name, map_texts, written
from entitymill.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints of a bucket that are compared directly.
SMALL_BUCKET = 64


def shingle_hashes(raw: bytes | None, size: int) -> np.ndarray:
    """XXH64 of all word shingles, A-Z lower-cased; a short text is one shingle, none without words."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray, block: int = 65_536) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    if len(hashes) == 1:
        return int(hashes[0])
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), block):
        part = hashes[a : a + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""

    def work():
        def run(texts: list) -> dict:
            values = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts], np.uint64)
            return {"fp": pa.array(values.view(np.int64))}

        return run

    return map_texts(docs, text_col, list(keep), "fp long", work)


def covering_masks(radius: int) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks, as signed 64-bit integers.

    The codes run through all values in turn, so each mask keeps about half of the bits.
    """
    size = 2 ** (radius + 1)
    masks = []
    for v in range(1, size):
        mask = sum(1 << i for i in range(BITS) if ((i % size) & v).bit_count() % 2)
        masks.append(_signed(mask))
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _free_pairs(masks: list[int], radius: int) -> list[list[int]]:
    """Per table, the masks that clear each choice of ``radius`` bits which the table does not keep."""
    out = []
    for mask in masks:
        free = [i for i in range(BITS) if not (mask >> i) & 1]
        out.append([_signed(~sum(1 << i for i in c) & (2**BITS - 1)) for c in combinations(free, min(radius, len(free)))])
    return out


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): pairs of different fingerprints within ``radius`` bits that connect all such pairs.

    ``distinct`` has one row per fingerprint ``fp``. Within a bucket only a spanning
    set of the links is given; each pair that is given is within the radius.
    """
    spark = distinct.sparkSession
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    keyed = written(distinct.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key"), "simhash-keys")
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    members = written(keyed.join(sizes, ["t", "key"]), "simhash-members")

    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    few = small.select("fps").mapInArrow(lambda batches: _bucket_links(batches, radius), "a long, b long")

    clears = F.array(*[F.array(*[F.lit(m) for m in one]) for one in _free_pairs(masks, radius)])
    large = members.where(F.col("n") > SMALL_BUCKET)
    cleared = large.select("fp", F.explode(clears[F.col("t")]).alias("clear"))
    cleared = cleared.select("fp", "clear", F.col("fp").bitwiseAND(F.col("clear")).alias("rest"))
    # At most 2 ** radius fingerprints agree outside ``radius`` bits.
    shared = cleared.groupBy("clear", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    many = shared.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return few.unionAll(many).distinct()


def _bucket_links(batches, radius: int):
    """A spanning set of the links inside each (small) bucket."""
    for batch in batches:
        a, b = [], []
        for fps in batch.column(0).to_pylist():
            x = np.array(fps, np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            seen = np.zeros(len(x), bool)
            for root in range(len(x)):
                todo = [] if seen[root] else [root]
                seen[root] = True
                while todo:
                    at = todo.pop()
                    new = np.flatnonzero(near[at] & ~seen)
                    seen[new] = True
                    a += [fps[at]] * len(new)
                    b += [fps[i] for i in new]
                    todo += new.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def component_roots(docs: DataFrame, keep, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """The ``keep`` columns of every row, its ``fp`` and ``root`` (the least fingerprint of its
    component) with ``least``, the component's smallest id."""
    prints = written(fingerprints(docs, keep, text_col, shingle), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left")
    rooted = written(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("least")), "simhash-least")
    classes = rooted.select(F.col("fp").alias("_fp"), "root").join(least, "root")
    classes = written(classes, "simhash-classes")
    return prints.join(classes, prints.fp == classes["_fp"]).drop("_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """id, ``fp`` (signed) and ``component_id`` of every row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``radius`` bits, and
    ``component_id`` is the smallest id reachable over links (null only if all those
    ids are null). Texts without words (null, empty, white space) have fingerprint 0
    and are linked like any other; equal rows have equal results; whole texts count,
    however long; an empty table gives no rows. Further columns play no part.
    """
    found = component_roots(docs.select(docs[f"`{id_col}`"], docs[f"`{text_col}`"]), [id_col], id_col, text_col, shingle, radius)
    return found.select(f"`{id_col}`", "fp", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null last; of
    equal ids the first row written). All columns stay, and cases are as in ``near_duplicates``."""
    row = free_name(docs, "row_number")
    source = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-source")
    found = component_roots(source, [row, id_col], id_col, text_col, shingle, radius)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row))
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias("_first"))
    first = written(first, "simhash-first")
    return source.join(first.hint("shuffle_hash"), source[row] == first["_first"], "left_semi").drop(row)


def hex_digits(fp: str = "fp"):
    """16 lower-case hexadecimal digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
