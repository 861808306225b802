"""Local Spark session for tests, the benchmark and the driver contract."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("entitymill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_shared_dir(spark)
    return spark


def ensure_shared_dir(spark: SparkSession) -> None:
    """Give a local session a checkpoint folder where none is set; clusters must name one."""
    unset = spark.sparkContext.getCheckpointDir() is None
    if unset and not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.master.startswith("local"):
            folder = os.path.join(tempfile.gettempdir(), "entitymill-checkpoints")
            spark.sparkContext.setCheckpointDir(folder)
