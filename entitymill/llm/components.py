"""Connected components of a distributed edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitymill.llm.common import written


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Both directions' edges (u, v) with m, the least of u and its neighbours.

    The least is written before it is joined, so that both sides of the join are
    plain shuffles and a node with very many neighbours can be split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = written(least.select("u", F.least("u", "m").alias("m")), name)
    return edges.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    Each round ties every node's larger neighbours, then its smaller ones, to the
    least node around it; rounds grow with the logarithm of the longest path.
    Rows with a null end and loops count as no edge; without edges the result is empty.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    pairs = written(
        pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc-edges"
    )
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "cc-large").where("v > u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-pairs")
        small = _with_least(large, "cc-small")
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.unionAll(small.select("u", F.col("m").alias("v")))
        pairs = written(star.where("u <> v").distinct(), "cc-edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
