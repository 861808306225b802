"""Writing intermediate results where every executor can read them again."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's active checkpoint folder, which ``spark.checkpoint.dir`` or
    ``setCheckpointDir`` names. A session without one is refused; ``session.py``
    has ``ensure_shared_dir`` for local sessions.
    """
    share_code(spark)
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where executors don't share that place, the package has to be installed there or
    sent along with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    places = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in places:
        environment["PYTHONPATH"] = os.pathsep.join([root, *places])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes the rows and their partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths that ``written`` has made for what this thread builds, if that is to be ``cleared``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING: dict = {"scopes": 0, "before": None}
_LOCK = threading.Lock()


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that this thread has ``written`` inside, and every query's shuffle files as it ends.

    What is to last must be written elsewhere by then. Without this, a long run keeps all its
    shuffles and intermediate tables on disk at once.
    """
    paths: list[str] = []
    token = _MADE.set(paths)
    with _LOCK:
        if not _CLEANING["scopes"]:
            _CLEANING["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _CLEANING["scopes"] += 1
    try:
        yield
    finally:
        _MADE.reset(token)
        with _LOCK:
            _CLEANING["scopes"] -= 1
            if not _CLEANING["scopes"]:
                spark.conf.unset(CLEANUP) if _CLEANING["before"] is None else spark.conf.set(CLEANUP, _CLEANING["before"])
        for path in paths:
            remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there.

    Like a checkpoint it cuts the lineage, but later reads take only the columns that
    they need, and nothing is computed twice on the way.
    """
    path = f"{shared_dir(df.sparkSession)}/entitymill/table-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, path: str, key: str, build=None, buckets: int | None = None) -> DataFrame:
    """A table under ``path`` that is hashed and sorted by ``key``, one file a bucket.

    Joins of such tables on their key move no row. With ``build`` (a function
    without arguments that returns the frame) it is written first; otherwise it must be there.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"staged_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if build is not None:
        rows = build().repartition(buckets, f"`{key}`").sortWithinPartitions(f"`{key}`")
        out = rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        out.option("path", path).saveAsTable(name)
    elif not spark.catalog.tableExists(name):
        # Written by another session: the table's description is made anew from its files.
        fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
            f" INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    # The frame knows its files and buckets; the catalog need not keep a name for them.
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(build, path: str, spark: SparkSession, made_from: Mapping | None = None, key: str | None = None) -> DataFrame:
    """Feature table written under ``path``, and read from there; with ``key`` it is bucketed by it.

    ``build`` is a function without arguments that returns the frame. ``made_from``
    says all that decides its rows (input files, row limits, orders, options); it
    becomes part of the folder's name, and a table that was written from the same is
    read again. Without it the table is always built anew. A folder counts as
    written once its success marker is there. Tables that ``build`` has ``written`` on the
    way are deleted then, so nothing but the frame it returns may read them.
    """
    if made_from is not None:
        if key is not None:  # How many buckets there are is part of what a table is.
            made_from = {**made_from, "buckets": spark.conf.get("spark.sql.shuffle.partitions")}
        text = json.dumps(made_from, sort_keys=True, default=str)
        path = f"{path}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    build = None if made_from is not None and _is_written(spark, path) else build
    with cleared(spark) if build is not None else nullcontext():
        if key is not None:
            return bucketed(spark, path, key, build)
        if build is not None:
            build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class StagedRows:
    """A small table that grows by appended rows, under a folder whose name says what it belongs to."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        if not place.getFileSystem(conf).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)


def staged_table(spark: SparkSession, path: str, made_from: Mapping, schema: str) -> StagedRows:
    """Rows that were appended under ``path`` for the same ``made_from``, if any, and a way to append more."""
    text = json.dumps(made_from, sort_keys=True, default=str)
    return StagedRows(spark, f"{path}-{hashlib.sha256(text.encode()).hexdigest()[:16]}", schema)


def file_facts(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of every file at a path; empty if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found, files = [], system.listFiles(place, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def _is_written(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)
