"""Connected components of a graph given as an edge table, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.scratch import drop, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("long"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns a, b, any integer type); a component is named by its least node.

    Alternates large-star and small-star steps: each links every node to the least node that it
    sees, so distances shrink by halves while the number of edges never grows. Every step is
    written to the shared folder. Loops, repeated and reversed edges, and nulls are harmless.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    e = written(e.where(F.col("a") != F.col("b")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(small.unionByName(lower.withColumnRenamed("m", "b")).distinct(), "edges")
        after = _state(new)
        drop(e)
        e = new
        if after == state:
            break
        state = after
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
