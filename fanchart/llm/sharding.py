"""Sharding through fixed virtual slots, with DataFrame functions only.

A record's slot is a hash of the record and never changes. Bytes are summed per slot, and a slot-to-shard map, a table with
a version, says where each slot lies. The first version deals slots out so that the shards' bytes are near equal; a
rebalance edits the map: a new shard takes slots, and no slot moves between old shards. Work on slots is bounded by
their fixed number, whatever the number of records.

Which columns are hashed decides what can be told apart: the law ``bytes`` holds as long as no single slot outweighs a
shard's share, so a caller with repeated ids hashes more than the id. Rows equal in all those columns are numbered
(``told_apart``), and the number is hashed too. A null hashes like any value. Sizes are UTF-8 bytes plus
one, so that empty and null texts count too. An empty table gives an empty result. ``place`` replaces columns of the
records named ``shard`` or ``place``; other names are free, ``_part``, ``_rank`` and ``_start`` excepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fanchart.session import small_side

SLOTS = 4096
# A slot's records are numbered in this many independent parts, so that no window gathers a whole slot.
PARTS = 64


def size_of(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def virtual_slot(*record: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*record), F.lit(slots)).cast("int")


def told_apart(records: DataFrame, *columns: str) -> DataFrame:
    """``records`` with ``_record``, a hash of ``columns``, and ``_repeat``: 0, or a number per row where rows are equal in them.

    Equal rows are interchangeable, so it does not matter which gets which number. The numbers follow the partitions that
    rows are read in; write the records once and go on from there.
    """
    hashed = records.withColumn("_record", F.xxhash64(*columns))
    repeated = hashed.groupBy("_record").agg(F.count("*").alias("n")).filter("n > 1").select("_record", F.lit(True).alias("_again"))
    joined = hashed.join(small_side(repeated), "_record", "left")
    number = F.when(F.col("_again"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("bigint"))
    return joined.withColumn("_repeat", number).drop("_again")


def slot_bytes(records: DataFrame, size: str = "size", slot: str = "virtual_slot") -> DataFrame:
    """(virtual_slot, bytes): summed on the map side before the shuffle."""
    return records.groupBy(slot).agg(F.sum(size).alias("bytes"))


def initial_map(usage: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, virtual_slot, shard), for the slots of ``usage``.

    The largest slot not yet dealt goes to the shard with the fewest bytes. The slots, at most ``SLOTS`` rows, are
    folded in one expression.
    """
    ordered = usage.agg(F.sort_array(F.collect_list(F.struct(-F.col("bytes"), F.col("virtual_slot").alias("s")))).alias("slots"))
    state = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"), F.array().cast("array<int>").alias("dealt")
    )

    def deal(now: Column, slot: Column) -> Column:
        least = F.array_position(now["loads"], F.array_min(now["loads"])).cast("int") - 1
        loads = F.transform(now["loads"], lambda load, i: F.when(i == least, load - slot["col1"]).otherwise(load))
        return F.struct(loads.alias("loads"), F.concat(now["dealt"], F.array(least)).alias("dealt"))

    dealt = ordered.select("slots", F.aggregate("slots", state, deal)["dealt"].alias("dealt"))
    pairs = dealt.select(F.explode(F.arrays_zip(F.col("slots.s").alias("slot"), "dealt")).alias("p"))
    return pairs.select(
        F.lit(1).alias("version"), F.col("p.slot").alias("virtual_slot"), F.col("p.dealt").alias("shard")
    )


def grown_map(current: DataFrame, usage: DataFrame) -> DataFrame:
    """The next version, with one more shard: each old shard hands over slots until the new one has its share.

    Old shards give what they hold above the new mean, smallest slots first. All other slots stay where they are.
    """
    known = current.join(usage, "virtual_slot", "left").na.fill({"bytes": 0})
    totals = known.agg(F.sum("bytes").alias("total"), (F.max("shard") + 1).alias("shards"))
    within = Window.partitionBy("shard")
    upto = F.sum("bytes").over(within.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    surplus = F.sum("bytes").over(within) - F.col("total") / (F.col("shards") + 1)
    # totals is one row.
    moved = known.join(F.broadcast(totals)).select(
        "version", "virtual_slot", "shards", "shard", (upto <= surplus).alias("goes")
    )
    shard = F.when(F.col("goes"), F.col("shards")).otherwise(F.col("shard"))
    return moved.select((F.col("version") + 1).alias("version"), "virtual_slot", shard.cast("int").alias("shard"))


def place(records: DataFrame, slot_map: DataFrame, record: str, slot: str = "virtual_slot") -> DataFrame:
    """``records`` with ``shard`` and ``place``, a number without gaps from 0 within the shard.

    Records are counted per slot and part, the counts (at most ``SLOTS * PARTS`` rows) are summed up along each shard,
    and a record's place is its part's start plus its rank in the part. The map has at most ``SLOTS`` rows.
    """
    # The part has to depend on more than the slot does.
    records = records.drop("shard", "place")
    parted = records.join(F.broadcast(slot_map.select(slot, "shard")), slot).withColumn(
        "_part", F.pmod(F.xxhash64(F.lit(1), *records.columns), F.lit(PARTS)).cast("int")
    )
    counts = parted.groupBy("shard", slot, "_part").agg(F.count("*").alias("n"))
    along = Window.partitionBy("shard").orderBy(slot, "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("n").over(along), F.lit(0))).select(slot, "_part", "_start")
    rank = F.row_number().over(Window.partitionBy(slot, "_part").orderBy(record)) - 1
    ranked = parted.withColumn("_rank", rank)
    return ranked.join(F.broadcast(starts), [slot, "_part"]).withColumn("place", F.col("_start") + F.col("_rank")).drop(
        "_part", "_rank", "_start"
    )
