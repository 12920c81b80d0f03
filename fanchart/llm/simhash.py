"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit per bit of the shingle hashes: 1 if set in over half of them. For radius r every bit position
gets a vector of r + 1 bits, and every non-zero vector v gives a mask: the positions whose vector has an odd product
with v. Any r differing positions have vectors orthogonal to some v, so two fingerprints at distance r or less agree under at
least one of the 2^(r+1) - 1 masks: no pair is missed. Buckets of equal masked fingerprints hold the candidates, and
their distances are computed.

Equal fingerprints are one node, so exact copies never meet pairwise. A bucket gives a spanning forest of its links
rather than all pairs. A bucket beyond ``GROUP`` fingerprints is split into chunks, and each pair of chunks is a group
of its own.

Null and empty texts have no words and the fingerprint 0, linked like any other. Texts shorter than a shingle are one
shingle. Ties (a bit set in exactly half) give 0. Repeated ids are kept row by row; a null id never names a component
unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fanchart.llm.arrow import bounds, map_groups, map_rows
from fanchart.llm.components import connected_components
from fanchart.session import cut_lineage, small_side

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
# Buckets of more fingerprints are split into chunks of about this many.
GROUP = 4096
# Shingle hashes counted at a time, and groups up to this size compared by shifting instead of one by one.
_COUNTED, _TINY = 1 << 15, 8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as an unsigned number. Words are split at ASCII white space after lower-casing A-Z."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts, ends = np.append(0, ends[: len(words) - size] + 1), ends[size - 1 :]
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _COUNTED):
        part = [joined[a:b] for a, b in zip(starts[at : at + _COUNTED].tolist(), ends[at : at + _COUNTED].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype="<u8", count=len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed long."""

    def start():
        def signed(value: str | None) -> tuple:
            number = fingerprint(value, shingle)
            return (number - (1 << BITS) if number >> (BITS - 1) else number,)

        return signed

    return map_rows(docs, [text], {"fp": "bigint"}, start)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks as signed longs. Positions take the vectors 1, 2, ... in turn, zero left out, which keeps all masks
    near half of the bits; positions that share a vector differ together or not at all under every mask."""
    vectors = 1 << (radius + 1)
    of_position = [1 + i % (vectors - 1) for i in range(bits)]
    masks = []
    for v in range(1, vectors):
        mask = sum(1 << i for i, own in enumerate(of_position) if (own & v).bit_count() % 2 == 1)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def spanning_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what chains of pairs within ``radius`` connect: a search that compares each value reached with
    those not reached yet, so that a dense group costs little."""
    left, right, open_ = [], [], values
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            value = queue.pop()
            near = np.bitwise_count(open_ ^ value) <= radius
            if near.any():
                found = open_[near]
                left.append(np.full(len(found), value))
                right.append(found)
                queue += list(found)
                open_ = open_[~near]
    empty = np.empty(0, dtype=values.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links_in_groups(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between values (sorted by key) of equal keys: all of them in tiny groups, a spanning forest in others."""
    cuts = bounds(keys)
    sizes = np.repeat(np.diff(cuts), np.diff(cuts))
    left, right = [], []
    tiny = np.flatnonzero((sizes > 1) & (sizes <= _TINY))
    k, v = keys[tiny], values[tiny]
    for shift in range(1, _TINY):
        near = np.flatnonzero((k[shift:] == k[:-shift]) & (np.bitwise_count(v[shift:] ^ v[:-shift]) <= radius)) if shift < len(k) else []
        if len(near):
            left.append(v[near])
            right.append(v[near + shift])
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end - start > _TINY:
            a, b = spanning_links(values[start:end], radius)
            left.append(a)
            right.append(b)
    empty = np.empty(0, dtype=values.dtype)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def chunked(keyed: DataFrame, key: str, value: str, group: int) -> DataFrame:
    """``keyed`` with hot keys split: a key with more than ``group`` rows becomes a group for every pair of its chunks.

    ``side`` is -1 in whole groups and in groups of a chunk with itself. In a group of two chunks it names the row's
    chunk, so that only pairs of different sides are new there. Counting is a map-side aggregate; the list of hot keys
    is short and joined by its measured size.
    """
    hot = keyed.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > group)
    hot = small_side(hot.select(key, F.ceil(F.col("_n") / group).cast("int").alias("_k")))
    own = F.pmod(F.xxhash64(F.lit(7), value), F.col("_k")).cast("int")

    def pair(other: Column) -> Column:
        name = F.xxhash64(key, F.least(own, other), F.greatest(own, other))
        return F.struct(name.alias("key"), F.when(own == other, F.lit(-1)).otherwise(own).alias("side"))

    whole = F.array(F.struct(F.col(key).alias("key"), F.lit(-1).alias("side")))
    parts = F.when(F.col("_k").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), pair))
    rest = [c for c in keyed.columns if c != key]
    split = keyed.join(hot, key, "left").select(F.explode(parts).alias("_part"), *rest)
    return split.select(F.col("_part.key").alias(key), *rest, F.col("_part.side").alias("side"))


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp`` within ``radius``; they connect what all such pairs connect."""
    masked = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(covering_masks(radius))]
    keyed = fingerprints.select(F.explode(F.array(*masked)).alias("bucket"), "fp")

    def start():
        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, values = (rows.column(c).to_numpy() for c in ("bucket", "fp"))
            a, b = links_in_groups(keys, values.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        return links

    parted = chunked(keyed, "bucket", "fp", group).drop("side")
    return map_groups(parted, "bucket", ["fp"], "a bigint, b bigint", start)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) for every row: the smallest doc_id reachable over fingerprints within ``radius``.

    ``root`` is the component's smallest fingerprint, which tells apart components that a repeated id names alike.
    """
    written = cut_lineage(with_fingerprints(docs.select("doc_id", text), shingle, text), ["doc_id", "fp"])
    nodes = cut_lineage(written.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # One row per distinct fingerprint; a fingerprint of many copies is hot on the left side only, which Spark splits.
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return written.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
