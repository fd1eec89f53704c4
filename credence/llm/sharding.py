"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots. Bytes are summed
per slot, and a versioned table maps slots to shards. Rebalancing or growing
edits that table: a new version moves few slots, and no record is rehashed.

Defined results: a null text has size 1; rows that are equal in id and text
fall into the same slot and get consecutive positions; an empty table gives
no rows and a map of empty slots; other columns of the input are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm.common import bounded_rows, work_folder, written

#: Slots per map. At 100 TB a slot of 65,536 holds about 1.5 GB.
SLOTS = 4096
SHARDS = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32 and virtual_slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot. The result has ``slots`` entries at any input size."""
    found = bounded_rows(
        rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), slots, "slots"
    )
    out = [(0, 0)] * slots
    for slot, size, n in found:
        out[slot] = (size, n)
    return out


def new_map(sizes: list[int], shards: int = SHARDS) -> list[int]:
    """Shard of every slot: the largest slot first, each to the emptiest shard."""
    heap = [(0, shard) for shard in range(shards)]
    out = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda s: (-sizes[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes[slot], shard))
    return out


def rebalanced(slot_map: list[int], sizes: list[int], shards: int, tolerance: float = 0.01) -> list[int]:
    """An edited map: slots move one by one from the fullest to the emptiest shard.

    Each move picks the slot that best halves the difference of the two, and
    moving ends when all shards are within ``tolerance`` of the mean or no
    move narrows the difference.
    """
    out = list(slot_map)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += sizes[slot]
        held[shard].append(slot)
    mean = sum(load) / shards
    while True:
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        movable = [s for s in held[high] if 0 < sizes[s] < gap]
        if gap <= 2 * tolerance * mean or not movable:
            return out
        slot = min(movable, key=lambda s: (abs(sizes[s] - gap / 2), s))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
        out[slot] = low


def grown(slot_map: list[int], sizes: list[int], shards: int) -> list[int]:
    """A map with one more shard, filled to the mean by slots from the fullest others."""
    out = list(slot_map)
    load = [0] * (shards + 1)
    held: list[list[int]] = [[] for _ in range(shards + 1)]
    for slot, shard in enumerate(out):
        load[shard] += sizes[slot]
        held[shard].append(slot)
    mean = sum(load) / (shards + 1)
    for shard in range(shards):
        held[shard].sort(key=lambda s: (sizes[s], -s))
    while load[shards] < mean:
        high = max(range(shards), key=lambda s: (load[s], -s))
        slot = next((s for s in reversed(held[high]) if 0 < sizes[s] <= mean - load[shards]), None)
        if slot is None:
            break
        held[high].remove(slot)
        load[high] -= sizes[slot]
        load[shards] += sizes[slot]
        out[slot] = shards
    return out


class Maps:
    """The versions of a slot map as a written table: version, virtual_slot, shard, slot_bytes, slot_rows, first.

    A version has one row a slot, and ``first`` tells where the slot begins in
    its shard. Versions are only ever added; each edits the one before it.
    """

    SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long, first long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_folder(spark)

    def add(self, version: int, slot_map: list[int], sizes: list[tuple[int, int]]) -> None:
        begins: dict[int, int] = {}
        rows = []
        for slot, shard in enumerate(slot_map):
            size, n = sizes[slot]
            rows.append((version, slot, shard, size, n, begins.get(shard, 0)))
            begins[shard] = begins.get(shard, 0) + n
        # a version that is written again replaces itself
        where = f"{self.path}/version={version}"
        self.spark.createDataFrame(rows, self.SCHEMA).drop("version").coalesce(1).write.mode("overwrite").parquet(where)

    def read(self, version: int | None = None) -> DataFrame:
        every = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        latest = every.agg(F.max("version")).first()[0] if version is None else version
        return every.where(F.col("version") == latest)

    def shards_of(self, version: int | None = None) -> list[int]:
        """Shard of every slot; a version has a fixed number of rows."""
        return [r["shard"] for r in self.read(version).orderBy("virtual_slot").select("shard").collect()]


def laid_out(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: Maps | None = None) -> Maps:
    """The maps of ``records``: version 1 deals slots by size, version 2 is version 1 edited until shards are even."""
    maps = maps or Maps(rows.sparkSession)
    sizes = slot_sizes(rows, slots)
    maps.add(1, new_map([s for s, _ in sizes], shards), sizes)
    maps.add(2, rebalanced(maps.shards_of(1), [s for s, _ in sizes], shards), sizes)
    return maps


def grow(maps: Maps, shards: int) -> int:
    """Add a version with one more shard, which takes slots only into itself; returns its number."""
    last = maps.read().orderBy("virtual_slot").collect()  # one row a slot
    sizes = [(r["slot_bytes"], r["slot_rows"]) for r in last]
    version = last[0]["version"] + 1
    maps.add(version, grown([r["shard"] for r in last], [s for s, _ in sizes], shards), sizes)
    return version


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Shard and place of every document under the latest version of a new map.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (place in the
    shard, gapless from 0), grown_shard (null), virtual_slot and map_version.
    Ranks are taken within virtual slots, so no task sorts a whole shard.
    Records are hashed by id and text, so documents of equal texts are spread:
    kept together, a text that a third of all rows share would fill one shard.
    """
    rows = written(records(docs, slots))
    table = laid_out(rows, shards, slots).read()
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(place))
        # the map has one row per slot, a fixed number
        .join(F.broadcast(table.select("version", "virtual_slot", "shard", "first")), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            F.col("virtual_slot"),
            F.col("version").alias("map_version"),
        )
    )
