"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's virtual slot is a hash of its doc_id and never changes. Bytes are
aggregated per slot, so a map of a few thousand rows decides where everything lies. It
is made once, for an empty store, and then edited, never remade, when shards fill
unevenly or are added. Each edit is a new version of the stored map.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import hadoop, new_path, written

#: Virtual slots; far more than there will be shards.
SLOTS = 4096
#: Rows that a slot may have however many bytes they are.
HEAVY = 16


def virtual_slot(doc_id: Column, otherwise: Column, slots: int = SLOTS) -> Column:
    """Records without doc_id are spread by another column."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), otherwise.cast("string"))), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, virtual): UTF-8 bytes of the text plus 8; a null text has none and CRC 0."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.withColumn("virtual", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots))


def split_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows as of records(), with those of slots that a repeated or null doc_id makes heavy dealt over all slots.

    A slot is heavy if it has more than HEAVY rows and over four times the mean bytes. Its
    rows get a slot by doc_id, CRC and a number, so equal rows part too. The number is the
    row's own in this run, so the result is stored before it is used.
    """
    loads = slot_loads(rows)
    mean = sum(b for b, _ in loads.values()) / slots
    heavy = [s for s, (b, n) in loads.items() if n > HEAVY and b > 4 * mean]
    if heavy:
        again = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_crc32"), F.monotonically_increasing_id()), F.lit(slots)).cast("int")
        rows = rows.withColumn("virtual", F.when(F.col("virtual").isin(heavy), again).otherwise(F.col("virtual")))
    return rows


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each virtual slot; at most as many entries as there are slots."""
    return {r["virtual"]: (r["bytes"], r["n"]) for r in rows.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}


def rebalanced(placed: dict[int, int], loads: dict[int, int], shards: int, into: set[int] | None = None) -> dict[int, int]:
    """The map edited for its slots' loads or for more shards.

    The heaviest shard gives a slot to the lightest (of ``into``, if given) while that
    narrows their gap, the one that comes nearest to half of it; where no slot does,
    the two exchange slots that do (not with ``into``, into which slots only move).
    """
    placed = dict(placed)
    total = dict.fromkeys(range(shards), 0)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in placed.items():
        total[shard] += loads.get(slot, 0)
        held[shard].append((loads.get(slot, 0), slot))
    for slots in held.values():
        slots.sort()

    def move(load: int, slot: int, source: int, target: int) -> None:
        held[source].remove((load, slot))
        insort(held[target], (load, slot))
        total[source] -= load
        total[target] += load
        placed[slot] = target

    while True:
        light = min(into or total, key=lambda s: (total[s], s))
        heavy = max(total, key=lambda s: (total[s], -s))
        gap = total[heavy] - total[light]
        if one := _nearest(held[heavy], 0, gap):
            move(*one, heavy, light)
            continue
        if into:
            return placed
        pairs = [(abs(gap - 2 * (a[0] - b[0])), a, b) for b in held[light] if (a := _nearest(held[heavy], b[0], gap))]
        if not pairs:
            return placed
        _, a, b = min(pairs)
        move(*a, heavy, light)
        move(*b, light, heavy)


def _nearest(slots: list[tuple[int, int]], base: int, gap: int) -> tuple[int, int] | None:
    """Of slots in order of their load, the one whose load is above base by nearest to half the gap, if by more than nothing and less than the gap."""
    at = bisect_left(slots, (base + gap // 2, 0))
    near = [x for x in slots[max(0, at - 1) : at + 1] if 0 < x[0] - base < gap]
    return min(near, key=lambda x: abs(gap - 2 * (x[0] - base)), default=None)


def write_map(spark: SparkSession, path: str, placed: dict[int, int], version: int) -> None:
    """Add a version to the stored map; an existing version is never changed."""
    rows = spark.createDataFrame(sorted(placed.items()), "virtual int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """A version of the stored map: one entry a virtual slot."""
    return {r["virtual"]: r["shard"] for r in spark.read.parquet(f"{path}/version={version}").collect()}


def map_version(spark: SparkSession, path: str) -> int:
    """The number of the stored map's newest version, -1 if there is none."""
    system, at = hadoop(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=-1)


def resized(placed: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map for another number of shards: new ones take slots only into themselves, slots of shards that go are dealt to the lightest, heaviest slot first."""
    before = max(placed.values(), default=-1) + 1
    if before < shards:
        return rebalanced(placed, loads, shards, set(range(before, shards)))
    placed = dict(placed)
    total = {s: sum(loads.get(slot, 0) for slot, shard in placed.items() if shard == s) for s in range(shards)}
    for slot in sorted((s for s, shard in placed.items() if shard >= shards), key=lambda s: (-loads.get(s, 0), s)):
        placed[slot] = min(total, key=lambda s: (total[s], s))
        total[placed[slot]] += loads.get(slot, 0)
    return placed


def even_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """The map of a store that holds nothing yet: slots dealt in turn."""
    return {slot: slot % shards for slot in range(slots)}


def placed_records(rows: DataFrame, placed: dict[int, int], loads: dict[int, tuple[int, int]]) -> DataFrame:
    """rows as of records() -> (doc_id, size, text_crc32, virtual, shard, slot), slot being the place in the shard, gapless from 0.

    A place is the number of rows in the shard's earlier virtual slots plus the rank
    in the own one, so no shard is ever sorted as a whole.
    """
    begin: dict[int, int] = {}
    filled: dict[int, int] = {}
    for slot in sorted(placed):
        shard = placed[slot]
        begin[slot] = filled.get(shard, 0)
        filled[shard] = begin[slot] + loads.get(slot, (0, 0))[1]
    table = rows.sparkSession.createDataFrame([(s, placed[s], begin[s]) for s in sorted(placed)], "virtual int, shard int, begin long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("virtual").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(F.broadcast(table), "virtual").select("doc_id", "size", "text_crc32", "virtual", "shard", (F.col("begin") + F.col("rank") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, *, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> a row a document with its shard and place; sizes of shards are near equal in bytes.

    The map is stored at map_path (by default in the shared folder). Where there is none,
    version 0 is written as that of an empty store. The newest version is read, edited for
    the bytes of the slots and for another number of shards, and written as the next
    version if that changes it; so a later run moves only slots that make shards uneven.
    Two runs that write one version at a time: the second fails. Places follow from the
    version as read back. A map of another number of slots is an error. Null texts have
    size 8 and CRC 0. Rows without doc_id are spread by their CRC, and rows of an id that
    fills a slot are dealt over all slots (see split_slots()); repeated rows are each
    placed. Other columns, those named like the result's too, are ignored; an empty table
    gives none.
    """
    spark = docs.sparkSession
    path = map_path or new_path(spark, "slot-map")
    rows = written(split_slots(records(docs, slots), slots), "records")
    loads = slot_loads(rows)
    version = map_version(spark, path)
    if version < 0:
        version = 0
        write_map(spark, path, even_map(shards, slots), version)
    placed = read_map(spark, path, version)
    if len(placed) != slots:
        raise ValueError(f"the map at {path} has {len(placed)} slots, not {slots}")
    sizes = {s: b for s, (b, _) in loads.items()}
    edited = rebalanced(resized(placed, sizes, shards), sizes, shards)
    if edited != placed:
        version += 1
        write_map(spark, path, edited, version)
    return placed_records(rows, read_map(spark, path, version), loads)
