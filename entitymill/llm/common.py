"""Shared helpers: batched work on texts, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from entitymill.sources.staging import remove, share_code, shared_dir

#: White space of all operators: blank, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments splits at exactly these.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


_SCOPES: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all ``scratch`` paths that were made inside; what is to last must be written elsewhere by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            remove(spark, path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once and read again: its lineage is cut, lost executors cost nothing."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_blocks(values: pa.Array, most: int) -> Iterator[tuple[int, list]]:
    """(place of the first, texts as bytes or None) of runs of about ``most`` bytes, one text at least."""
    values = values.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    a = size = 0
    for b, n in enumerate(sizes, 1):
        size += n
        if size >= most or b == len(sizes):
            yield a, values.slice(a, b - a).to_pylist()
            a, size = b, 0


def map_texts(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    schema: str,
    work: Callable[[], Callable[[list], dict[str, Sequence]]],
    block_bytes: int = 2_000_000,
) -> DataFrame:
    """``work()`` once per task gives a function from a list of UTF-8 texts (bytes
    or None) to columns; the result has the columns ``keep`` and those of ``schema``,
    whose names must not be among ``keep`` and hold no blanks.

    Texts come in blocks of about ``block_bytes``, so memory follows the block and
    the longest text, not the partition.
    """
    share_code(docs.sparkSession)
    source = docs.select(*[docs[f"`{c}`"] for c in dict.fromkeys([*keep, text])])
    fields = [source.schema[c] for c in keep]
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), schema])
    added = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, texts in text_blocks(batch.column(at), block_bytes):
                columns = function(texts)
                part = batch.slice(a, len(texts))
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[c] for c in added)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])

    return source.mapInArrow(run, full)
