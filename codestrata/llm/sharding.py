"""Sharding by fixed virtual slots under a versioned slot-to-shard map.

Records are hashed into thousands of virtual slots, whose bytes and rows are summed. The map from slot to shard is a
small stored table with versions; rebalancing edits it: slots move from the fullest to the emptiest shard, each time the
slot whose size comes nearest to half the gap, until no move narrows it. Only the slots moved change shard, so that an edit
moves few bytes. The law is ``bytes``: shards hold nearly equal bytes. A map that is stored at ``map_path`` is the one that
is edited, and the next version is stored beside it; records are placed by what is read back from there.

The driver sees one row for each virtual slot (4096 at any input size), which is the size bound of the broadcast map.
A record's place in its shard is numbered from 0 by offsets of whole slots plus the place within the slot; rows that are
alike in id, size and checksum are counted before they are numbered, so that they are no hot key.

Defined cases: a null text has size 1 (one byte for the end) and the checksum of the empty text; a very long text is one
record; null and repeated ids are hashed with their text's checksum, so that they spread; whole repeated rows stay in one
slot and get places of their own; slots of equal size are moved by number; an empty table gives an empty result and a first
map; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import new_folder, store, table, utf8

SLOTS = 4096
#: Rows alike over so many get their places in blocks of as many.
PLACES = 1 << 16


@dataclass
class SlotMap:
    """shards[s] is the shard of virtual slot s; edits: (version, slot, from, to)."""

    shards: np.ndarray
    n_shards: int
    version: int = 0
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    @classmethod
    def first(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(np.arange(slots) % n_shards, n_shards)

    def rebalanced(self, sizes: np.ndarray, n_shards: int | None = None) -> SlotMap:
        """The next version of the map, for the bytes of each slot and perhaps more shards."""
        n = n_shards or self.n_shards
        if n < self.n_shards:
            raise ValueError("shards can be added, not taken away")
        to, load, moves, version = self.shards.copy(), np.zeros(n), [], self.version + 1
        np.add.at(load, to, sizes)
        own = [sorted((float(sizes[s]), int(s)) for s in np.flatnonzero(to == h)) for h in range(n)]
        by_size = [np.array([x for x, _ in o]) for o in own]
        for _ in range(20 * len(to)):
            full, bare = int(load.argmax()), int(load.argmin())
            gap = load[full] - load[bare]
            at = int(np.searchsorted(by_size[full], gap / 2))
            best = min((i for i in (at - 1, at) if 0 <= i < len(own[full]) and 0 < by_size[full][i] < gap), key=lambda i: abs(by_size[full][i] - gap / 2), default=None)
            if best is not None:
                size, slot = own[full].pop(best)
                moved = [(size, slot, full, bare)]
            else:  # no slot is small enough: exchange two slots whose difference narrows the gap
                pair = _exchange(own[full], own[bare], gap)
                if pair is None:
                    break
                (a, b) = pair
                own[full].remove(a)
                own[bare].remove(b)
                moved = [(*a, full, bare), (*b, bare, full)]
            for size, slot, h, g in moved:
                own[g].append((size, slot))
                own[g].sort()
                load[h], load[g], to[slot] = load[h] - size, load[g] + size, g
                moves.append((version, slot, h, g))
            for h in (full, bare):
                by_size[h] = np.array([x for x, _ in own[h]])
        return SlotMap(to, n, version, self.edits + moves)

    def save(self, spark: SparkSession, path: str) -> None:
        """Store this version beside earlier ones: a folder for each version."""
        rows = [(self.version, self.n_shards, s, int(h)) for s, h in enumerate(self.shards)]
        table_ = spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int")
        table_.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """The stored map of a version, or the last; None where none is stored."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        versions = [int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(folder) if x.getPath().getName().startswith("version=")]
        if not versions or version is not None and version not in versions:
            return None
        got = spark.read.parquet(f"{path}/version={max(versions) if version is None else version}").orderBy("virtual_slot").collect()
        return cls(np.array([r["shard"] for r in got]), got[0]["n_shards"], got[0]["version"])


def _exchange(full: list, bare: list, gap: float):
    """The pair (a of the full, b of the bare shard) with a - b in (0, gap) nearest to gap / 2."""
    sizes, best = np.array([x for x, _ in bare]), None
    for a in full:
        if len(sizes):
            at = int(np.searchsorted(sizes, a[0] - gap / 2))
            for i in (at - 1, at):
                if 0 <= i < len(bare) and 0 < (d := a[0] - sizes[i]) < gap:
                    best = min([x for x in (best, (abs(d - gap / 2), a, bare[i])) if x], key=lambda x: x[0])
    return best and best[1:]


@dataclass
class Sharded:
    """records: a row for each record; map: the slot map in force; first: the one before the rebalancing; map_path: where both are stored."""

    records: DataFrame
    map: SlotMap
    first: SlotMap
    map_path: str


def shard(docs: DataFrame, n_shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> Sharded:
    """Shard ``docs`` under the map at ``map_path`` (a new folder if not given), edited for their bytes.

    The stored map's slots are kept; it may have fewer shards than ``n_shards``."""
    spark = docs.sparkSession
    map_path = map_path or new_folder(spark, "slot-map")
    first = SlotMap.load(spark, map_path)
    if first is None:
        first = SlotMap.first(n_shards, slots)
        first.save(spark, map_path)
    slots = len(first.shards)
    body = utf8(text_col)
    hashed = docs.select(F.col(id_col).alias("doc_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    slotted = hashed.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))
    # Rows alike once, with their number, before and after the shuffle.
    alike = store(slotted.groupBy("virtual_slot", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n")), "shard-base")
    per_slot = alike.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"), F.max("n").alias("most")).collect()  # at most `slots` rows
    sizes, rows = np.zeros(slots), np.zeros(slots, dtype=np.int64)
    for r in per_slot:
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    first.rebalanced(sizes, n_shards).save(spark, map_path)
    now = SlotMap.load(spark, map_path)
    offset = np.zeros(slots, dtype=np.int64)
    for h in range(n_shards):
        own = np.flatnonzero(now.shards == h)
        offset[own] = np.cumsum(rows[own]) - rows[own]
    placed = spark.createDataFrame([(s, int(now.shards[s]), int(offset[s])) for s in range(slots)], "virtual_slot int, shard int, offset long")
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, 0)
    ranked = alike.withColumn("before", F.sum("n").over(within) - F.col("n")).join(F.broadcast(placed), "virtual_slot")
    zero = F.lit(0).cast("long")
    upto = lambda n: F.explode(F.sequence(zero, n - 1))
    if max((r["most"] for r in per_slot), default=0) > PLACES:
        # Places of very many rows alike in blocks, which are dealt out before they become rows.
        ranked = ranked.withColumn("_block", upto(F.ceil(F.col("n") / PLACES))).withColumns({"before": F.col("before") + F.col("_block") * PLACES, "n": F.least(F.lit(PLACES).cast("long"), F.col("n") - F.col("_block") * PLACES)})
        ranked = ranked.repartition("virtual_slot", "doc_id", "_block")
    records = (
        ranked.withColumn("i", upto(F.col("n")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("before") + F.col("i")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(now.version).alias("map_version"),
        )
    )
    return Sharded(records, now, first, map_path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).records
