"""A training corpus from raw documents: five stages, each an operator of ``llm``.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``docs``, whatever they are; rows may have null or repeated
ids, and columns may bear any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitymill.llm import exact_dedup, packing, quality_cnn, secrets, simhash
from entitymill.llm.common import cleared, free_name, scratch, written
from entitymill.session import ensure_shared_dir
from entitymill.sources.staging import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality_cnn.fit_labelled(docs, labels)
    score = free_name(docs, "score")
    return quality_cnn.scored(docs, net, docs.columns, "text", score).where(F.col(score) >= quality_cnn.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=3, radius=2)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked in the text, and ``n_chars`` counted anew."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length token sequences along the curve, with their ids, for ``packing.sequences``."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written and read again.

    What a stage wrote on its way is deleted with its end, and its result once the next is written.
    """
    ensure_shared_dir(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        with cleared(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
