"""WARC archives: written with revisit records, read back by verified record boundaries.

The text ``WARC/1.0`` may stand inside a payload, so a place where it is found is only
a candidate. Tasks emit every candidate with its successor, the offset at which its
header says the next record starts. Pointer jumping from the start of each file then
finds, in as many rounds as the logarithm of the records in a file, which candidates
the chain reaches; all others lie inside payloads.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.llm.common import written
from entitymill.sources.staging import share_code

# Marks and profile of the format.
MAGIC = b"WARC/1.0\r\n"
CLOSE = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 100

#: Stands, with the size of an archive, for its end among the candidates.
END = "end"

_MAGIC = re.compile(re.escape(MAGIC))
_FIELD = re.compile(rb"[!-9;-~]+[ \t]*:[^\r\n]*\r\n")
_RECORD = re.compile(r"<urn:page:(\d+):(-?\d*)>")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per row of ``pages`` as a column ``record`` (without its closing ``CLOSE``).

    Of equal payloads of at least 100 bytes the one with the smallest id (null last; of
    equal ids the first row) is a response, the others revisit it and hold no payload. A
    null payload is empty, a null address is left out. An empty table has no records, and
    further columns play no part.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        payload.alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "warc-pages")
    digest, size = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    rows = rows.withColumn("digest", digest).withColumn("size", size)
    order = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    firsts = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    firsts = written(firsts.where("n > 1").select(F.col("digest").alias("_digest"), "first"), "warc-firsts")
    same = (rows["digest"] == firsts["_digest"]) & (rows["size"] >= LEAST_REVISIT)
    rows = rows.join(firsts, same, "left")

    def name(row, page):
        return F.concat(F.lit("<urn:page:"), row, F.lit(":"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    # Blanks, control characters and the per cent sign of an address are escaped, so it stays one header line.
    address = F.concat(F.lit("WARC-Target-URI: "), _escaped(F.col("url")), F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    refers = F.concat(
        F.lit("WARC-Refers-To: "), name(F.col("first.row"), F.col("first.page")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n")
    )
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("row"), F.col("page")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(address, F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_size.cast("string"),
        F.lit("\r\n\r\n"),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    return rows.select(record.alias("record"))


def _escaped(text):
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in " \r\n\t":
        out = F.replace(out, F.lit(c), F.lit(quote(c)))
    return out


def write_archives(records: DataFrame, path: str, records_a_file: int = 5_000, bytes_a_file: int = 128_000_000) -> None:
    """Compressed archives under ``path``, of at most ``records_a_file`` records and ``bytes_a_file``
    bytes before compression, or one larger record.

    A record ends with ``CLOSE``, which is what Spark's text writer puts after each row.
    """
    share_code(records.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count, size = 0, 0, 0
        for batch in batches:
            numbers = []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if count and (count == records_a_file or size + n > bytes_a_file):
                    number, count, size = number + 1, 0, 0
                count, size = count + 1, size + n + len(CLOSE)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], names=["record", "archive"])

    dealt = records.select("record").mapInArrow(deal, "record string, archive int")
    dealt.write.partitionBy("archive").option("lineSep", CLOSE).option("compression", "gzip").text(path)


FIELDS = (
    "file string, at long, to long, kind string, page long, url string, payload_digest string, "
    "refers_to long, payload_bytes long, payload binary"
)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(field: str | None) -> int | None:
    m = _RECORD.fullmatch(field or "")
    return int(m[2]) if m and m[2] else None


def parse_at(data: bytes, at: int) -> dict | None:
    """The record that would start at ``at``, or None if no whole one can.

    Its header ends at the first line that is no field, so what follows another magic
    is not read again.
    """
    end = at + len(MAGIC)
    while field := _FIELD.match(data, end):
        end = field.end()
    if not data.startswith(b"\r\n", end):
        return None
    fields = _headers(data[at + len(MAGIC) : end])
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit() and "warc-type" in fields):
        return None
    start, stop = end + 2, end + 2 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    head, _, payload = data[start:stop].partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    length = _headers(head).get("content-length", "") if kind == "revisit" else str(len(payload))
    url = fields.get("warc-target-uri")
    return {
        "at": at, "to": stop + 4, "kind": kind, "page": _page(fields.get("warc-record-id")),
        "url": None if url is None else unquote(url),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest(),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(length) if length.isdigit() else None,
        "payload": payload,
    }


def candidates(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every place in the archives under ``path`` where a record could start, with its successor,
    and the end of every archive.

    One task reads one archive at a time, so memory follows the size of an archive.
    Payloads are given only if asked for.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("file", pa.string()), ("at", pa.int64()), ("to", pa.int64()), ("kind", pa.string()), ("page", pa.int64()),
             ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for m in _MAGIC.finditer(data):
                    if found := parse_at(data, m.start()):
                        found |= {"file": file, "payload": found["payload"] if payloads else None}
                        rows.append(found)
                        size += len(found["payload"] or b"")
                    if len(rows) >= 10_000 or size >= 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                rows.append({"file": file, "at": len(data), "kind": END})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # Each archive is a row of its own size: few of them at a time go to Python.
    share_code(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(find, FIELDS)


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates that the chain from offset 0 of their file reaches.

    Round k knows all candidates up to 2 ** k records from the start, and for every
    candidate the one 2 ** k records on; a chain that leaves the candidates ends.
    """
    reached = written(found.where("at = 0").select("file", "at"), "warc-reached")
    starts = found.select("file", "at")
    jumps = found.select("file", F.col("at").alias("from"), F.col("to").alias("at"))
    jumps = written(jumps.join(starts.hint("shuffle_hash"), ["file", "at"], "left_semi").select("file", "from", F.col("at").alias("to")), "warc-jumps")
    while not jumps.isEmpty():
        heads = reached.select("file", F.col("at").alias("from"))
        more = heads.join(jumps.hint("shuffle_hash"), ["file", "from"]).select("file", F.col("to").alias("at"))
        reached = written(reached.unionAll(more), "warc-reached")
        second = jumps.select("file", F.col("from").alias("to"), F.col("to").alias("end"))
        jumps = jumps.join(second.hint("shuffle_hash"), ["file", "to"]).select("file", "from", F.col("end").alias("to"))
        jumps = written(jumps, "warc-jumps")
    return reached


def read_archives(spark: SparkSession, path: str, payloads: bool = False, whole: bool = False) -> DataFrame:
    """The records of all archives under ``path``: the candidates that are reached.

    Records found only inside payloads are not given. A damaged or cut archive gives its
    records up to the damage, or with ``whole`` a ValueError: the chain must reach its end.
    An empty one gives none.
    """
    found = written(candidates(spark, path, payloads), "warc-candidates")
    kept = reachable(found.select("file", "at", "to"))
    if whole:
        ends = found.where(F.col("kind") == END).select("file", "at")
        cut = ends.join(kept.hint("shuffle_hash"), ["file", "at"], "left_anti").select("file").limit(3).collect()
        if cut:
            raise ValueError(f"archives that are cut or damaged: {', '.join(r['file'] for r in cut)}")
    return found.where(F.col("kind") != END).join(kept.hint("shuffle_hash"), ["file", "at"], "left_semi")
