"""Token ids in binary files, with one zstandard dictionary for all documents.

A folder holds ``dictionary`` (one file) and ``blocks`` (files of blocks, in ascending
order of the ids of documents). The dictionary is trained on serialised id arrays.
Every document is a compressed frame of its own, so one can be read without the
others; a block keeps the SHA-256 of the dictionary that its frames need and an index
of their offsets. Spark's text writer puts the bytes of each block and a line feed
behind it, so files are committed and lost tasks repeated as with any other table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.llm.common import text_blocks, written
from entitymill.llm.word_encoder import shared_encoder
from entitymill.sources.staging import share_code

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAGIC = b"TOKB"
#: magic, bytes an id, documents, range and number of the block, ids of earlier documents
#: in the range, bytes of all frames, SHA-256 of the dictionary.
HEADER = struct.Struct("<4sIIIIqq32s")
#: Of every document in a block: its id, 1 if that is null, where its frame ends, its ids.
INDEX = np.dtype([("doc", "<i8"), ("none", "u1"), ("stop", "<i8"), ("tokens", "<i8")])
WIDTH = 2
LEVEL = 3
DICTIONARY_BYTES = 65_536
#: The dictionary is trained on at most so many texts of at most so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 65_536


def _serialised(encoder, texts: Sequence[bytes | None], end: int) -> list[bytes]:
    """Ids of every text and ``end``, as little-endian unsigned numbers of ``WIDTH`` bytes."""
    last = end.to_bytes(WIDTH, "little")
    return [ids + last for ids in encoder.encode_all(texts)]


def train_dictionary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = 1, path: str = TOKENIZER, rows: int = SAMPLE_ROWS,
) -> bytes:
    """A dictionary from the id arrays of up to ``rows`` texts of at most ``SAMPLE_BYTES``.

    The texts are those of the rows with the least hashes, sought among a few times as many
    rows whatever the table's size; one task trains, the driver gets the dictionary alone.
    With too few texts to train on it holds their arrays as they are, and without any it is
    empty.
    """
    share_code(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("binary")
    sample = docs.select(text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("hash"))
    share = 8 * rows / max(docs.count(), 1)
    if share < 1:
        sample = sample.where(F.pmod("hash", F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = sample.where(F.octet_length("text").between(1, SAMPLE_BYTES)).orderBy("hash", "text").limit(rows).select("text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, arrays = shared_encoder(path), []
        for batch in batches:
            arrays += _serialised(encoder, batch.column(0).to_pylist(), end)
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, arrays, k=512, d=8).as_bytes()
        except zstandard.ZstdError:
            trained = b"".join(arrays)[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], names=["dictionary"])

    found = sample.mapInArrow(train, "dictionary binary").collect()
    return max((bytes(r["dictionary"]) for r in found), key=len, default=b"")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _block(docs: list, frames: list[bytes], tokens: list[int], place: tuple[int, int, int], digest: bytes) -> bytes:
    index = np.zeros(len(docs), INDEX)
    index["doc"] = [d or 0 for d in docs]
    index["none"] = [d is None for d in docs]
    index["stop"] = np.cumsum([len(f) for f in frames], dtype=np.int64)
    index["tokens"] = tokens
    head = HEADER.pack(MAGIC, WIDTH, len(docs), *place, int(index["stop"][-1]), digest)
    return b"".join([head, index.tobytes(), *frames])


def _raw_files(df: DataFrame, path: str, rows_a_file: int) -> None:
    """Write a binary column ``value``: its bytes as they are, each row closed by a line feed."""
    df.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", rows_a_file).text(path)


def write_ids(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, tokenizer: str = TOKENIZER,
    block_bytes: int = 4_000_000, blocks_a_file: int = 8, dictionary: bytes | None = None,
) -> None:
    """Encode every whole text (null: empty), close it with ``end``, and write files under ``path``.

    Documents are range-sorted by id (a whole number; null first), then by a hash of the
    text; rows that agree in both may come in either order, and are all written. A block
    holds ``block_bytes`` of frames or one longer frame. An empty table leaves only the
    dictionary; further columns play no part.
    """
    spark = docs.sparkSession
    if dictionary is None:
        dictionary = train_dictionary(docs, id_col, text_col, end, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    _raw_files(spark.createDataFrame([(bytearray(dictionary),)], "value binary"), f"{path}/dictionary", 1)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    order = [F.asc_nulls_first("doc"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(F.asc_nulls_first("doc"), F.xxhash64("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)).compress
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs, frames, tokens, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            raw = _block(docs, frames, tokens, (part, number, before), digest)
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, texts in text_blocks(batch.column(1), 2_000_000):
                for doc, raw in zip(ids[a : a + len(texts)], _serialised(encoder, texts, end), strict=True):
                    frame = compress(raw)
                    if docs and size + len(frame) > block_bytes:
                        yield closed()
                        number, before = number + 1, before + sum(tokens)
                        docs, frames, tokens, size = [], [], [], 0
                    docs.append(doc)
                    frames.append(frame)
                    tokens.append(len(raw) // WIDTH)
                    size += len(frame)
        if docs:
            yield closed()

    _raw_files(rows.mapInArrow(blocks, "value binary"), f"{path}/blocks", blocks_a_file)


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/dictionary")
    return b"".join(bytes(r["content"]) for r in files.select("content").collect())[:-1]


class Block:
    """Header and index of the block at ``at`` in ``data``; raises ValueError unless it is whole."""

    def __init__(self, data: memoryview, at: int):
        if len(data) < at + HEADER.size:
            raise ValueError(f"a block at {at} is cut off")
        magic, self.width, n, self.range, self.number, self.before, size, self.digest = HEADER.unpack_from(data, at)
        if magic != MAGIC or self.width != WIDTH:
            raise ValueError(f"no block at {at}")
        index = at + HEADER.size
        self.frames = index + n * INDEX.itemsize
        self.next = self.frames + size + 1
        if len(data) < self.next or data[self.next - 1] != ord("\n"):
            raise ValueError(f"the block at {at} is cut off")
        self.index = np.frombuffer(data, INDEX, n, index)
        stops = self.index["stop"]
        if n == 0 or stops[-1] != size or (np.diff(stops) <= 0).any():
            raise ValueError(f"the index of the block at {at} is damaged")

    def docs(self) -> list[int | None]:
        return [None if none else d for d, none in zip(self.index["doc"].tolist(), self.index["none"].tolist(), strict=True)]

    def spans(self) -> list[tuple[int, int]]:
        """Where each frame starts and stops in the file."""
        stops = (self.index["stop"] + self.frames).tolist()
        return list(zip([self.frames, *stops[:-1]], stops, strict=True))


def _each_block(data: memoryview) -> Iterator[Block]:
    at = 0
    while at < len(data):
        block = Block(data, at)
        yield block
        at = block.next


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks")
    return files.select("path", "content")


def _decompressor(dictionary: bytes, digest: bytes):
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("a block was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress


def _decoded(decompress, data: memoryview, span: tuple[int, int], tokens: int) -> np.ndarray:
    ids = np.frombuffer(decompress(data[span[0] : span[1]]), "<u2").astype("<u4")
    if len(ids) != tokens:
        raise ValueError(f"a frame has {len(ids)} ids, its index says {tokens}")
    return ids


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document in the files: its id, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` of its decoded ids and, if asked for, ``ids`` (both as
    unsigned 32-bit, little-endian).

    Cut or damaged files and a dictionary of another hash are refused. A task takes one
    file at a time; the driver gets one total per range.
    """
    share_code(spark)
    dictionary = read_dictionary(spark, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = memoryview(batch.column(1)[k].as_buffer())
                for block in _each_block(data):
                    decompress = _decompressor(dictionary, block.digest)
                    tokens = block.index["tokens"]
                    found = [_decoded(decompress, data, s, n) for s, n in zip(block.spans(), tokens.tolist(), strict=True)]
                    columns = [
                        pa.array(block.docs(), pa.int64()), pa.array([block.range] * len(tokens), pa.int32()),
                        pa.array(block.before + np.cumsum(tokens) - tokens), pa.array(tokens),
                        pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([x.tobytes() for x in found], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc", "range", "inside", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    schema = "doc long, range int, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    found = written(_files(spark, path).mapInArrow(rows, schema), "token-rows")
    totals = found.groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect()
    firsts, first = [], 0
    for r in totals:
        firsts.append((r["range"], first))
        first += r["n"]
    firsts = spark.createDataFrame(firsts, "range int, first long")
    found = found.join(F.broadcast(firsts), "range")
    rest = [c for c in names if c not in ("doc", "range", "inside")]
    return found.select(F.col("doc").alias(id_col), (F.col("first") + F.col("inside")).alias("start"), *rest)


def index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The offset index of all files: document, ``file``, where its frame starts and stops there, ``n_tokens``."""
    share_code(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(0)[k].as_py()
                for block in _each_block(memoryview(batch.column(1)[k].as_buffer())):
                    spans = block.spans()
                    columns = [
                        pa.array(block.docs(), pa.int64()), pa.array([file] * len(spans), pa.string()),
                        pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64()),
                        pa.array(block.index["tokens"]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "file", "frame_start", "frame_stop", "n_tokens"])

    schema = f"`{id_col}` long, file string, frame_start long, frame_stop long, n_tokens long"
    return _files(spark, path).mapInArrow(rows, schema)


def fetch(spark: SparkSession, path: str, entry) -> list[int]:
    """The ids of one document, given its row of ``index``: reads only the bytes of its frame."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(entry["file"])
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        stream.seek(entry["frame_start"])
        frame = bytes(stream.readNBytes(entry["frame_stop"] - entry["frame_start"]))
    finally:
        stream.close()
    dictionary = read_dictionary(spark, path)
    return _decoded(_decompressor(dictionary, hashlib.sha256(dictionary).digest()), memoryview(frame), (0, len(frame)), entry["n_tokens"]).tolist()
