"""Sharding through fixed virtual slots (operator 3).

Each record hashes by its id and text into one of thousands of virtual slots; bytes are summed by slot; a
versioned map in a stored table says which shard each slot is in. The first map deals slots out by size, largest
first, each to the shard with the fewest bytes. Rebalancing reads the newest version, edits it and adds the next:
slots move, one at a time, from the fullest shards to the emptiest until all are within the tolerance; records of
other slots stay where they are, and earlier versions stay readable. Law `bytes`: the shards' sizes are near equal.

A map has one row for each slot whatever the number of records, so it may live on the driver
(its size is the number of slots). A record's place in its shard is the records of the shard's
earlier slots plus its number within its own slot, so no window spans more than a slot.

Size: UTF-8 bytes of the text (null: none) plus 8; a null text has the checksum of an empty one. Rows with null or
repeated ids spread over the slots by their texts; rows that repeat both share a slot and get places of their own;
an empty table gives an empty result; extra columns are kept unless a result's column has their name.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm._spark import shared_folder

SLOTS = 4096
MAP = "version int, vslot int, shard int"


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def virtual_slot(doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), text), F.lit(slots)).cast("int")


def slot_sizes(docs: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each slot that has records."""
    sums = docs.groupBy(virtual_slot(slots=slots).alias("vslot")).agg(F.sum(size_of()).alias("bytes"), F.count("*").alias("n"))
    return {r["vslot"]: (r["bytes"], r["n"]) for r in sums.collect()}  # one row for each slot


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda x: (-sizes.get(x, 0), x)):
        full, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (full + sizes.get(slot, 0), shard))
    return out


def rebalance(old: dict[int, int], sizes: dict[int, int], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edited map for `shards` shards: few slots move, one at a time from the fullest shard to the emptiest.

    Slots of shards that go are dealt out first. Then shards over their share by more than the tolerance give, and those
    below it take: the largest slot that leaves the one at its share or above and the other at its share or below; if none
    is so small, the smallest slot, if that brings the two nearer to each other. Empty slots stay unless their shard goes.
    """
    out = dict(old)
    full = dict.fromkeys(range(shards), 0)
    for slot, shard in out.items():
        if shard < shards:
            full[shard] += sizes.get(slot, 0)
    heap = [(n, s) for s, n in full.items()]
    heapq.heapify(heap)
    for slot in sorted((x for x, s in out.items() if s >= shards), key=lambda x: (-sizes.get(x, 0), x)):
        n, s = heapq.heappop(heap)
        out[slot], full[s] = s, n + sizes.get(slot, 0)
        heapq.heappush(heap, (full[s], s))
    share = sum(full.values()) / shards
    giving, taking = {s for s in full if full[s] > share * (1 + tolerance)}, {s for s in full if full[s] < share}
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in giving}
    for slot, shard in out.items():
        if shard in giving and sizes.get(slot, 0):
            held[shard].append((sizes[slot], slot))
    for own in held.values():
        own.sort()
    while giving and taking:
        d, r = max(giving, key=lambda s: (full[s], -s)), min(taking, key=lambda s: (full[s], s))
        if full[d] <= share * (1 + tolerance) and full[r] >= share * (1 - tolerance):
            break
        k = max(bisect_right(held[d], (min(full[d] - share, share - full[r]), len(out))) - 1, 0)
        if full[d] <= share or held[d][k][0] >= full[d] - full[r]:
            giving.remove(d)
            continue
        size, slot = held[d].pop(k)
        out[slot], full[d], full[r] = r, full[d] - size, full[r] + size
        if full[r] >= share:
            taking.remove(r)
    return out


def newest(table: DataFrame) -> tuple[int, dict[int, int]]:
    """The newest version of a map: its number, and the shard of each slot."""
    last = table.groupBy("version").agg(F.collect_list(F.struct("vslot", "shard")).alias("m")).orderBy(F.desc("version")).first()  # one row for each slot
    return (last["version"], {r["vslot"]: r["shard"] for r in last["m"]}) if last else (0, {})


def write_map(spark: SparkSession, path: str, version: int, m: dict[int, int]) -> None:
    """Adds a version to a stored map; a version that is there already is an error."""
    rows = [(slot, shard) for slot, shard in sorted(m.items())]
    spark.createDataFrame(rows, "vslot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored map, all versions of it or one."""
    table = spark.read.schema(MAP).parquet(path)
    return table if version is None else table.where(F.col("version") == version)


def rebalance_map(docs: DataFrame, path: str, shards: int, slots: int = SLOTS, tolerance: float = 0.01) -> int:
    """Edits the newest version of the stored map for the bytes that docs now has, stores the next one and returns its number."""
    version, old = newest(read_map(docs.sparkSession, path))
    write_map(docs.sparkSession, path, version + 1, rebalance(old, {k: n for k, (n, _) in slot_sizes(docs, slots).items()}, shards, tolerance))
    return version + 1


def assign(docs: DataFrame, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, grown_shard, vslot and version, by the newest version of a map."""
    version, placed_in = newest(table)
    own = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "version")
    own = own.withColumns({"size": size_of(), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "law": F.lit("bytes"), "vslot": virtual_slot(slots=slots)})
    counts = {k: n for k, (_, n) in slot_sizes(docs, slots).items()}
    before: dict[int, int] = {}
    rows = []
    for slot, shard in sorted(placed_in.items()):
        rows.append((version, slot, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + counts.get(slot, 0)
    placed = own.join(F.broadcast(docs.sparkSession.createDataFrame(rows, MAP + ", _before long")), "vslot")
    number = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("slot", (F.col("_before") + number - 1).cast("long")).withColumn("grown_shard", F.lit(None).cast("int")).drop("_before")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """docs assigned by the map stored at path; one that is not there yet is made over their own bytes, and stored."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"
    try:
        table = read_map(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_map(spark, path, 1, first_map({k: n for k, (n, _) in slot_sizes(docs, slots).items()}, shards, slots))
        table = read_map(spark, path)
    return assign(docs, table, slots)
