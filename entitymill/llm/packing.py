"""Packing along a space-filling curve.

Every document's token counts, hashed to a vector, are projected to few dimensions;
its place on a Hilbert curve through them is its key. Documents are range-sorted by
key and laid end to end in fixed-length sequences, so neighbours on the curve share
sequences and only the very end is not full; that end is cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import map_texts, written
from entitymill.llm.word_encoder import shared_encoder

LENGTH = 4096
END = 2
VECTOR = 256
DIMENSIONS = 4
DEPTH = 8
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def project(ids: np.ndarray, seed: int = 11) -> np.ndarray:
    """A text's hashed, normalised count vector on ``DIMENSIONS`` random directions, each in [0, 1).

    Texts without ids lie in the middle. The directions are fixed by ``seed``, and the
    scale by the vector's length, so a text's place does not depend on other texts.
    """
    directions = _directions(seed)
    bucket = (ids.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    vector = np.sqrt(np.bincount(bucket, minlength=VECTOR))
    vector = vector - vector.mean()
    norm = np.sqrt((vector**2).sum())
    place = directions @ vector / norm if norm else np.zeros(DIMENSIONS)
    return 1 / (1 + np.exp(-1.7 * place))


@lru_cache(maxsize=4)
def _directions(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((DIMENSIONS, VECTOR))


def hilbert_key(places: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``places`` (values in [0, 1)).

    The curve runs through a grid of 2 ** depth cells per dimension. From the coarsest
    bit down, each cell's order is a Gray code, turned so that it starts and ends where
    its neighbours do.
    """
    n, dims = places.shape
    x = np.minimum((places * 2**depth).astype(np.int64), 2**depth - 1).T.copy()
    for level in range(depth - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):
            on = (x[i] >> level) & 1 == 1
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    for level in range(depth - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(n, np.int64)
    for level in range(depth - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> level) & 1
    return key


def tokenized(docs: DataFrame, keep=("doc_id",), text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns, ``curve`` (Hilbert key), ``doc_tokens`` and ``ids`` (unsigned 16-bit,
    little-endian, closed by ``END``) of every row; a null text has just ``END``."""

    def work():
        encoder = shared_encoder(path)

        def run(texts: list) -> dict:
            ids = encoder.encode_all(texts)
            places = [project(np.frombuffer(i, "<u2")) for i in ids]
            end = END.to_bytes(2, "little")
            return {
                "curve": pa.array(hilbert_key(np.array(places).reshape(-1, DIMENSIONS))),
                "doc_tokens": pa.array([len(i) // 2 + 1 for i in ids], pa.int64()),
                "ids": pa.array([i + end for i in ids], pa.binary()),
            }

        return run

    return map_texts(docs, text_col, list(keep), "curve long, doc_tokens long, ids binary", work)


def along_curve(rows: DataFrame, size: str, order: list[str]) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` over all rows that come first in ``order``.

    Rows are range-sorted once; each range sums its own rows, and the driver gets one
    total per range. ``order`` must be total, so that hot keys are split between ranges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = rows.columns.index(size)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column(at).to_numpy()
            ends = n.cumsum() + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=[*batch.schema.names, "_inside"])
            total = int(ends[-1]) if len(n) else total

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranges = ranges.mapInArrow(running, f"{fields}, _inside long")
    ranges = written(ranges.withColumn("_range", F.spark_partition_id()), "pack-ranges")
    totals = ranges.groupBy("_range").agg(F.sum(size).alias("n")).collect()
    starts, first = {}, 0
    for r in sorted(totals, key=lambda r: r["_range"]):
        starts[r["_range"]], first = first, first + r["n"]
    starts = spark.createDataFrame(list(starts.items()), "_range int, _first long")
    sums = ranges.join(F.broadcast(starts), "_range")
    return sums.withColumn("before", F.col("_first") + F.col("_inside")).drop("_range", "_first", "_inside")


def tail_cuts(total: int, length: int = LENGTH) -> list[int]:
    """Where sequences start in a stream of ``total`` ids, from the first that is not full.

    The rest is cut at falling powers of two: such sequences need no padding.
    """
    at, cuts = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    return cuts


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str = TOKENIZER) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (unsigned 32-bit, little-endian).

    Every id of every text, whole and closed by ``END``, lies in one piece, and every
    sequence but those of the last partial one is full. Null and empty texts are just
    ``END``; null ids and repeated rows are packed like all others (rows get a number of
    their own); ties on the curve are in the order of id and number; an empty table has
    no pieces; further columns play no part.
    """
    tokens = tokenized(docs, [id_col], text_col, path)
    tokens = written(tokens.withColumn("_row", F.monotonically_increasing_id()), "pack-tokens")
    kind = tokens.schema[id_col].dataType.simpleString()
    laid = along_curve(tokens.select("_row", id_col, "curve", "doc_tokens"), "doc_tokens", ["curve", id_col, "_row"])
    laid = written(laid.select(F.col("_row").alias("_at"), "before"), "pack-layout")
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    cuts = np.array(tail_cuts(total, length), np.int64)
    full = total // length
    placed = tokens.join(laid.hint("shuffle_hash"), tokens["_row"] == laid["_at"]).select(id_col, "doc_tokens", "before", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[] for _ in range(7)]
            for i, (tokens_of, before, ids) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < tokens_of:
                    at = before + start
                    if at < full * length:
                        sequence, offset = divmod(at, length)
                        end = (sequence + 1) * length
                    else:
                        k = int(np.searchsorted(cuts, at, side="right")) - 1
                        sequence, offset = full + k, at - int(cuts[k])
                        end = int(cuts[k + 1]) if k + 1 < len(cuts) else total
                    n = min(end - at, tokens_of - start)
                    piece = ids[start : start + n].tobytes()
                    rows.append(i)
                    for column, v in zip(columns, (start, n, zlib.crc32(piece), tokens_of, sequence, offset, piece), strict=True):
                        column.append(v)
                    start += n
            kinds = [pa.int64()] * 6 + [pa.binary()]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id``, its ``length`` and its pieces in order; a sequence has at most LENGTH of them."""
    piece = F.struct("offset", F.col(id_col), "start", "length", "ids")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(piece)).alias("pieces"))
