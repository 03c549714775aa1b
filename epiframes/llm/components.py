"""Connected components of an edge table by alternating star contractions, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _pull(pairs: DataFrame, keep) -> DataFrame:
    """Each vertex's neighbours are tied to the least vertex among them and itself."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return pairs.join(least, "a").where(keep)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns (vertex, root): every vertex of ``edges`` (a, b) with the least vertex it can reach.

    Rounds are few (about the logarithm of the longest path); each is written to the shared folder, so
    lineage stays short.  Raises if it has not settled after ``most_rounds``.
    """
    now = written(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        # large star: larger neighbours of a vertex go to the least of its neighbourhood
        large = _pull(_both(now), F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the vertex itself go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components have not settled")
    return now.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root")).union(now.select("b", "b").distinct())
