"""Sharding by fixed virtual slots: records hash into slots, slots map to shards, and only the map is edited.

The map is a small versioned table of one row per slot (a constant number), kept as Parquet; moving a slot changes one
row, and records are found by hash and map alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192


class SlotMap(NamedTuple):
    """``shard_of[slot]`` at one ``version``."""

    version: int
    shard_of: list[int]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version bigint, virtual_slot int, shard int")


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a record; a null key has a slot of its own hash."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, size: str = "size", slot: str = "virtual_slot", slots: int = SLOTS) -> list[int]:
    """Bytes of every slot; at most ``slots`` rows reach the driver, however many records there are."""
    out = [0] * slots
    for row in records.groupBy(slot).agg(F.sum(size).alias("bytes")).collect():
        out[row[0]] = row[1]
    return out


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots dealt to the shards in turn."""
    return SlotMap(1, [slot % shards for slot in range(slots)])


def rebalance(current: SlotMap, sizes: list[int], shards: int, tolerance: float = 0.001) -> SlotMap:
    """The next version: slots move, or two change places, between the fullest and the emptiest shard until they differ by
    ``tolerance`` of the mean or no such step narrows the gap.

    Serves uneven slots as well as added shards (shard numbers up to ``shards`` - 1 that own nothing yet).
    """
    owner = list(current.shard_of)
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(owner):
        held[shard].add(slot)
    load = [sum(sizes[s] for s in group) for group in held]
    target = sum(load) / shards
    while True:
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if gap <= max(1, tolerance * target):
            break
        step = _best_step(held[high], held[low], sizes, gap)
        if step is None:
            break
        out, back = step
        for slot, old, new in ((out, high, low), (back, low, high)):
            if slot is not None:
                held[old].remove(slot)
                held[new].add(slot)
                owner[slot] = new
                load[old] -= sizes[slot]
                load[new] += sizes[slot]
    return SlotMap(current.version + 1, owner)


def _best_step(high: set[int], low: set[int], sizes: list[int], gap: int) -> tuple[int, int | None] | None:
    """The move or exchange whose bytes are nearest to half the gap, if it lies strictly inside it."""
    import bisect

    downs = sorted((sizes[s], s) for s in low)
    best, found = gap / 2, None
    for slot in sorted(high, key=lambda s: (sizes[s], s)):
        if abs(sizes[slot] - gap / 2) < best and 0 < sizes[slot] < gap:
            best, found = abs(sizes[slot] - gap / 2), (slot, None)
        at = bisect.bisect_left(downs, (sizes[slot] - gap / 2, -1))
        for size, other in downs[max(0, at - 1):at + 1]:
            moved = sizes[slot] - size
            if 0 < moved < gap and abs(moved - gap / 2) < best:
                best, found = abs(moved - gap / 2), (slot, other)
    return found


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Stores one version beside the earlier ones."""
    slot_map.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given or the newest stored version."""
    stored = spark.read.parquet(path)
    chosen = version if version is not None else stored.agg(F.max("version")).first()[0]
    rows = spark.read.parquet(path).where(F.col("version") == chosen).select("virtual_slot", "shard").collect()
    return SlotMap(int(chosen), [shard for _, shard in sorted(rows)])


def assign(records: DataFrame, slot_map: DataFrame, key: str = "doc_id", slot: str = "virtual_slot") -> DataFrame:
    """``records`` with ``shard`` and ``slot``: the record's place in its shard, gapless from 0.

    ``slot_map`` has a constant number of rows, so broadcasting it is safe at any size. Places come from counts per virtual
    slot and a rank inside each slot (a shard is many small sorts). Records with equal keys sit side by side.
    """
    counts = records.groupBy(slot).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("shard").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.join(counts, slot, "left").select(
        slot, "shard", F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(order), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(slot).orderBy(key, "size", "text_crc32")
    placed = records.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(offsets), slot)
    return placed.withColumn("slot", (F.col("_offset") + F.col("_rank") - 1).cast("bigint")).drop("_offset", "_rank")


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot): law `bytes`, sizes of the shards near equal.

    Size is the text's UTF-8 bytes plus 8 (null: 8; its checksum is that of an empty text). Records hash by doc_id, so
    copies of one text spread over slots and a text held by a third of all rows fills no shard. Repeated rows are records
    of their own in one slot. An empty table gives no rows. With ``path`` the first and the rebalanced map are stored there, and
    the stored one places the records.
    """
    from ..runtime import cut_lineage

    text = F.coalesce("text", F.lit(""))
    records = cut_lineage(docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                                      virtual_slot(F.col("doc_id"), slots).alias("virtual_slot")))
    spark = docs.sparkSession
    initial = first_map(shards, slots)
    balanced = rebalance(initial, slot_bytes(records, slots=slots), shards)
    if path:
        save_map(spark, initial, path)
        save_map(spark, balanced, path)
        balanced = load_map(spark, path, balanced.version)
    return assign(records, balanced.frame(spark).drop("version"))
