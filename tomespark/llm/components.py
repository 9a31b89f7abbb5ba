"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger (large) or to its smaller neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # each edge belongs to its larger end, which takes part as a neighbour of its own
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    linked = common.with_counts(both, least, ["u"], F.col("v"), total)
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, label for every node that has an edge; label is the smallest id of its component.

    ``edges`` has the columns a and b. Each step cuts its lineage with a
    written table; the rounds grow with the logarithm of a component's size.
    The centre of a large star is a hot key, whose rows are dealt among tasks.
    """
    edges = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda: edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now, before = state(), None
    while now != before:
        before = now
        for large in (True, False):
            last, edges = edges, common.written(_stars(edges, large, 2 * before["n"]), "edges")
            common.released(last)
        now = state()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
