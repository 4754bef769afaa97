"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of ``n_slots`` virtual slots (a function of its
key alone).  Bytes are summed per slot, and a map of slots to shards is stored
as one table per version: version 1 deals slots to shards by size, later
versions are edits of the one before (``rebalance``).  Records never move
because of a hash change, only because the map says so.

The map has ``n_slots`` rows (fixed, thousands), so it is the one thing the
driver holds and every task gets.  Records are numbered inside a shard by
(slot, key): a window over one virtual slot plus the counts of the slots
before it, so no task sees a whole shard.

Defined results: a NULL text has 0 bytes (size 1, crc of no bytes); a NULL
key hashes like any other value; repeated rows each get a place of their own;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard and bytes of each slot."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out


def with_slots(records: DataFrame, key: str, n_slots: int = N_SLOTS) -> DataFrame:
    """Add ``virtual_slot``: the hash of the key's text, modulo the number of slots."""
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n_slots)).cast("int"))


def slot_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> list[tuple[int, int]]:
    """(bytes, records) per slot: at most ``n_slots`` rows reach the driver."""
    got = {r[0]: (int(r[1]), int(r[2])) for r in records.groupBy("virtual_slot").agg(
        F.sum("size"), F.count(F.lit(1))).collect()}
    return [got.get(s, (0, 0)) for s in range(n_slots)]


def initial_map(sizes: list[int], n_shards: int) -> SlotMap:
    """Version 1: slots in order of falling size, each to the shard with the fewest bytes so far."""
    import heapq

    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * len(sizes)
    for slot in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        load, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + sizes[slot], s))
    return SlotMap(1, n_shards, tuple(shard), tuple(sizes))


def rebalance(old: SlotMap, sizes: list[int], n_shards: int) -> SlotMap:
    """The next version: moves slots only from shards above the mean to shards below it.

    With one shard more, slots move only into the new shard.  Slots of shards
    that are no longer wanted all move.
    """
    shard, loads = list(old.shard), [0] * max(n_shards, old.n_shards)
    for slot, b in enumerate(sizes):
        loads[shard[slot]] += b
    mean = sum(sizes) / n_shards
    by_shard: dict[int, list[int]] = {}
    for slot in sorted(range(len(sizes)), key=lambda x: (-sizes[x], x)):
        by_shard.setdefault(shard[slot], []).append(slot)
    grown = list(range(old.n_shards, n_shards))

    def move(slot: int, targets: list[int], most: float | None) -> bool:
        to = min(targets, key=lambda s: (loads[s], s))
        if most is not None and loads[to] + sizes[slot] > most:
            return False
        loads[shard[slot]] -= sizes[slot]
        loads[to] += sizes[slot]
        shard[slot] = to
        return True

    for s, slots in sorted(by_shard.items()):
        for slot in slots:
            if s >= n_shards:
                move(slot, list(range(n_shards)), None)
            elif loads[s] - sizes[slot] >= mean:
                move(slot, grown or list(range(n_shards)), mean)
    return SlotMap(old.version + 1, n_shards, tuple(shard), tuple(sizes))


def store_map(spark: SparkSession, m: SlotMap, folder: str | None = None) -> str:
    """Write one version as a table (version, slot, shard, bytes); returns the folder of all versions."""
    folder = folder or shared_path(spark, "slot-map")
    rows = [(m.version, m.n_shards, i, s, b) for i, (s, b) in enumerate(zip(m.shard, m.bytes, strict=True))]
    spark.createDataFrame(rows, "version int, n_shards int, slot int, shard int, bytes long").coalesce(1).write.parquet(
        f"{folder.rstrip('/')}/version={m.version:06d}")
    return folder


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder.rstrip('/')}/version={version:06d}").select(
        "slot", "shard", "bytes", "n_shards").collect())
    return SlotMap(version, rows[0][3], tuple(r[1] for r in rows), tuple(r[2] for r in rows))


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and ``place`` (gapless from 0 in the shard) of every document."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rec = with_slots(docs.select("doc_id", (F.octet_length(data).cast("long") + 1).alias("size"),
                                 F.crc32(data).alias("text_crc32")), "doc_id", n_slots)
    sizes = slot_sizes(rec, n_slots)
    m = initial_map([b for b, _ in sizes], n_shards)
    folder = store_map(spark, m, folder)
    m = load_map(spark, folder, 1)  # what later readers see
    ahead, begin = [0] * n_shards, []
    for s, (_, n) in zip(m.shard, sizes, strict=True):
        begin.append(ahead[s])
        ahead[s] += n
    table = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(m.shard, begin, strict=True))],
                                  "virtual_slot int, shard int, begin long")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (rec.join(F.broadcast(table), "virtual_slot").withColumn("place", F.col("begin") + inside)
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "place"))
