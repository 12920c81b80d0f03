"""Connected components of a link table, as Spark jobs only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fanchart.session import cut_lineage, drop_written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable. Nulls are ignored.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest neighbour, then
    every node hands its smaller ones. Each is a map-side minimum by node and a join with it, so that the neighbours of
    a hub are never gathered; Spark splits a hub's partition of the join. Each round is written to the shared folder and
    replaces the one before. Rounds grow with the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")
    table = cut_lineage(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while True:
        state = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if state == before:
            break
        before = state
        both = table.union(table.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("b", "m"), F.struct(a.alias("b"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter(a != b).distinct()
        after = cut_lineage(small)
        drop_written(table)
        table = after
    roots = table.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(a.alias("node"), b.alias("root")).union(table.select(b, b).distinct())
