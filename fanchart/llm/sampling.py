"""Bounded samples chosen by hash, so that they depend neither on order nor on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def smallest_hashes(df: DataFrame, key: str, total: int, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``df``, which has ``total`` rows: those with the smallest hashes of ``key``.

    A bound on the hash leaves about a fifth more rows than wanted before they are ordered, so that what the tasks hand
    to the last one does not grow with their number.
    """
    hashed = F.xxhash64(key)
    share = 1.2 * limit / max(total, 1)
    if share < 1:
        df = df.filter(hashed < int(share * 2**64) - 2**63)
    return df.orderBy(hashed, key).limit(limit)


def distinct_texts(df: DataFrame, limit: int, *values: Column, total: int | None = None) -> DataFrame:
    """(digest, text, ``values`` aggregated per text): at most ``limit`` distinct texts of ``df``, those with the smallest
    digests. A null text is one too.

    With ``total``, the number of rows, a bound on the digest comes first, as in ``smallest_hashes``; where many rows are
    copies, it leaves fewer texts than ``limit``. Digests alone are read to find the last one, and copies of a text meet
    within their tasks before they are shuffled.
    """
    rows = df.withColumn("digest", F.xxhash64("text"))
    if total and 1.2 * limit < total:
        rows = rows.filter(F.col("digest") < int(1.2 * limit / total * 2**64) - 2**63)
    last = rows.select("digest").distinct().orderBy("digest").limit(limit).agg(F.max("digest")).first()[0]
    chosen = rows.filter(F.col("digest") <= last)
    return chosen.groupBy("digest", "text").agg(*values) if values else chosen.select("digest", "text").distinct()
