"""Exact deduplication as a stateful stream over a table's files.

A streaming aggregation keeps, per digest of the normalised text, how many rows had
it, and of the row that stays its id and where its content lies (file and row). The
state lives on disk (RocksDB) and never expires, so files can be added and the stream
continued. Rows whose digest was hit are then compared by their full bytes, and only
rows with equal bytes count as equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.llm.common import SPACE, free_name, scratch, written

#: Tasks that share the rows of a digest while their bytes are compared.
SPREAD = 32
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(files: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, bytes (the normalised text) and ``place``, by which the greatest row of a class stays:
    most code points, smallest id (none last), then the place of the content in the files."""
    text = normalised(F.col(f"`{text_col}`"))
    place = F.struct(
        F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("chars"),
        (-F.col(f"`{id_col}`").cast("long")).alias("minus_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return files.select(digest(text).alias("digest"), text.alias("bytes"), place.alias("place"))


def digest_state(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", files_a_batch: int = 1_000,
    digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None,
) -> DataFrame:
    """(digest, n, place) for every digest in the parquet files at ``path``.

    Reads all files as a stream, ``files_a_batch`` at a time. Each batch is counted per
    task before the shuffle and merged into the keyed state under ``checkpoint``, whose
    last committed version is then read as a table. With a folder of an earlier call
    only new files are read and added.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Many small stores: don't reserve disk space for each of their files, and share one
    # bounded memory among those of an executor.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may name a folder or a single file.
    files = own.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    stream = files.parquet(f"{path[:-1]}[{path[-1]}]")
    state = _rows(stream, id_col, text_col, digest).groupBy("digest")
    state = state.agg(F.count("*").alias("n"), F.max("place").alias("place"))
    checkpoint = checkpoint or scratch(spark, "dedup-state")
    running = (
        state.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    kept = own.read.format("statestore").load(checkpoint)
    return kept.select("key.digest", F.col("value.count").alias("n"), F.col("value.max").alias("place"))


def mark_duplicates(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", files_a_batch: int = 1_000,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """For every row in the parquet files at ``path``: its id, ``keep_id`` (of the row that
    stays), ``group_size``, ``kept``, ``text_sha256`` of the normalised text, and its place
    as ``file`` and ``row``.

    Texts are equal if they are so without white space; null counts as empty. Of equal
    texts the row with the most code points stays, then the smallest id (null last), then
    the first by place in reverse, so exactly one of fully equal rows stays. An empty
    table gives no rows. Ids are whole numbers; further columns play no part.

    ``digest`` may be any deterministic function of the text: rows that share a
    digest but not their bytes are told apart.
    """
    state = written(digest_state(spark, path, id_col, text_col, files_a_batch, digest), "dedup-classes")
    files = spark.read.parquet(path)
    rows = _rows(files, id_col, text_col, digest)

    # Full bytes of all hits. The rows of a digest are dealt over several tasks, each of
    # which sends on one row of what has equal bytes.
    hits = state.where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(SPREAD)).cast("int"))
    checked = dealt.join(hits.hint("shuffle_hash"), ["digest", "part"], "left_semi")
    checked = checked.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("place").alias("place"))
    classes = written(checked.select("digest", "n", "place"), "dedup-checked")
    mixed = written(classes.groupBy("digest").agg(F.count("*").alias("m")).where("m > 1").select("digest"), "dedup-mixed")

    single = state.where("n = 1").unionByName(classes.join(mixed, "digest", "left_anti"))
    single = written(single.select(F.col("digest").alias("_digest"), "n", F.col("place").alias("best")), "dedup-single")
    sha = sha256(F.col("bytes"))
    plain = rows.join(single, rows["digest"] == single["_digest"])
    plain = plain.select("place", "n", "best", sha.alias("sha") if digest is not sha256 else F.col("digest").alias("sha"))
    if not mixed.isEmpty():
        odd = rows.join(mixed, "digest", "left_semi")
        groups = odd.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("place").alias("best"))
        groups = groups.select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "n", "best")
        same = (odd["digest"] == groups["_digest"]) & (odd["bytes"] == groups["_bytes"])
        plain = plain.unionByName(odd.join(groups, same).select("place", "n", "best", sha.alias("sha")))
    return plain.select(
        (-F.col("place.minus_id")).alias(id_col),
        (-F.col("best.minus_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("best")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("place.file").alias("file"),
        F.col("place.row").alias("row"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``mark_duplicates`` doesn't keep; all columns stay."""
    spark = docs.sparkSession
    path = scratch(spark, "dedup-source")
    docs.write.parquet(path)
    marked = mark_duplicates(spark, path, id_col, text_col).where("kept")
    kept = written(marked.select(F.col("file").alias("_file"), F.col("row").alias("_row")), "dedup-kept")
    source = spark.read.schema(docs.schema).parquet(path)
    file, row = free_name(docs, "file"), free_name(docs, "row")
    source = source.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    same = (source[file] == kept["_file"]) & (source[row] == kept["_row"])
    return source.join(kept.hint("shuffle_hash"), same, "left_semi").drop(file, row)
