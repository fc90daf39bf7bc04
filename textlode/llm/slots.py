"""Sharding through fixed virtual slots.

A record's virtual slot is a hash of its id, its text's checksum and its number among rows that are equal in both and in
size: 0 for all but repeated rows. So it depends on neither the layout of the files nor on rows that are added, and a stored map
finds each record again; and equal rows don't meet in one slot. Copies are numbered by counts of each partition and sums over partitions,
so that no task holds all copies. Bytes are summed by slot; a map from slots to shards,
stored with a version, puts the slots in descending size on the least filled shard (law `bytes`: sizes near equal).
Rebalancing edits the map: only slots that have to move do, and the edited map is stored as the next version.

A record's place within its shard is the number of records in the shard's earlier virtual slots plus its own number
within its virtual slot, so that no task ever orders a whole shard.

Rows: null text has no bytes and size 1; null, repeated and equal ids spread over all slots; repeated rows are records of
their own; ties within a slot go by id, checksum, size and number; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlode.session import drop_path, materialise, workspace

#: Virtual slots: far more than shards ever, and few enough that the map is a small table.
SLOTS = 8192


def virtual_slot(*columns: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot is in. `shards[v]` is the shard of slot v."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def build(cls, sizes: list[int], n_shards: int) -> SlotMap:
        """Slots in descending size, each to the least filled shard (smallest number on ties)."""
        heap, shards = [(0, s) for s in range(n_shards)], [0] * len(sizes)
        for v in sorted(range(len(sizes)), key=lambda v: (-sizes[v], v)):
            filled, s = heapq.heappop(heap)
            shards[v] = s
            heapq.heappush(heap, (filled + sizes[v], s))
        return cls(1, n_shards, tuple(shards))

    def rebalanced(self, sizes: list[int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots of dropped shards move, then slots move from the fullest to the emptiest shard for as
        long as that brings their sizes nearer; all others stay."""
        n = n_shards or self.n_shards
        shards, filled, members = list(self.shards), [0] * n, [[] for _ in range(n)]
        homeless = []
        for v, s in enumerate(shards):
            if s < n:
                filled[s] += sizes[v]
                members[s].append((sizes[v], v))
            else:
                homeless.append(v)
        for v in sorted(homeless, key=lambda v: (-sizes[v], v)):
            s = min(range(n), key=lambda s: (filled[s], s))
            shards[v] = s
            filled[s] += sizes[v]
            members[s].append((sizes[v], v))
        for m in members:
            m.sort()
        while True:
            high, low = max(range(n), key=lambda s: (filled[s], -s)), min(range(n), key=lambda s: (filled[s], s))
            gap = filled[high] - filled[low]
            fitting = [x for x in members[high] if 0 < x[0] < gap]
            if not fitting:
                return SlotMap(self.version + 1, n, tuple(shards))
            best = min(fitting, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
            members[high].remove(best)
            members[low].append(best)
            members[low].sort()
            shards[best[1]] = low
            filled[high] -= best[0]
            filled[low] += best[0]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(v, s) for v, s in enumerate(self.shards)], "vslot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Write this version below `path`; a version that is there already is an error."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}-of={self.n_shards}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int, n_shards: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}-of={n_shards}").collect()
        return cls(version, n_shards, tuple(s for _, s in sorted((r.vslot, r.shard) for r in rows)))

    def drop(self, spark: SparkSession, path: str) -> None:
        drop_path(spark, f"{path}/version={self.version}-of={self.n_shards}")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, nth, vslot): what sharding needs of a record, without its text."""
    text, spark = F.coalesce(F.col(text_col), F.lit("")), df.sparkSession
    place = workspace(spark, "slot-rows")
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    rows = materialise(rows.select("*", F.xxhash64("doc_id", "text_crc32", "size").alias("key"), F.shiftright("place", 33).alias("part")), f"{place}/rows")  # once, so that places stay
    copies = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("part")
    copies = copies.select("key", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    numbered = rows.join(copies, ["key", "part"]).select("doc_id", "size", "text_crc32", nth.alias("nth"))
    out = materialise(numbered.withColumn("vslot", virtual_slot("doc_id", "text_crc32", "nth", slots=slots)), f"{place}/numbered")
    drop_path(spark, f"{place}/rows")
    return out


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and records of each virtual slot: two lists of `slots` numbers, whatever the number of records."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toLocalIterator():
        sizes[r.vslot], counts[r.vslot] = r["size"], r.n
    return sizes, counts


def placed(rows: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """`rows` with shard and slot, the record's place in its shard."""
    spark, base, lines = rows.sparkSession, [0] * slot_map.n_shards, []
    for v, s in enumerate(slot_map.shards):
        lines.append((v, s, base[s]))
        base[s] += counts[v]
    within = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "nth")
    table = F.broadcast(spark.createDataFrame(lines, "vslot int, shard int, base long"))  # as many rows as virtual slots
    return rows.withColumn("rn", F.row_number().over(within)).join(table, "vslot").withColumn("slot", F.col("base") + F.col("rn") - 1).drop("rn", "base", "nth")
