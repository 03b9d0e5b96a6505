"""Shards through fixed virtual slots and a versioned slot-to-shard map.

Every record is hashed into one of `slots` virtual slots. Bytes and rows are summed per slot, which leaves one
row per slot whatever the input holds. A map gives each slot its shard; rebalancing reads the stored map, edits its
latest version and appends the result as the next one, so it moves whole slots, never single records, and every
earlier version stays readable. A map that needs no edit gets no new version.

Nulls: a null text has no bytes and the checksum of an empty text; a null id is hashed with its text's checksum
alone. Repeated rows share a slot and get separate positions. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.session import scratch_path

SLOTS = 4096
HEADER_BYTES = 8
MAP_SCHEMA = "version int, vslot int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot): the columns that sharding needs, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + HEADER_BYTES).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("doc_id"))
    return slim.withColumn("vslot", F.pmod(key, F.lit(slots)).cast("int"))


def slot_loads(slim: DataFrame) -> DataFrame:
    return slim.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))


def initial_map(slots: int, shards: int) -> dict[int, int]:
    return {slot: slot % shards for slot in range(slots)}


def rebalance(current: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The next version of the map: heaviest slots of overloaded shards move to the lightest shard, largest first.

    A slot stays where it is while its shard is within its even share, so an already even map is left alone. A
    last pass moves or swaps single slots between the heaviest and the lightest shard while that narrows them.
    """
    share = sum(loads.values()) / shards
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    pool = []
    for slot, shard in current.items():
        (held[shard] if shard < shards else pool).append((loads.get(slot, 0), slot))
    total = {s: sum(b for b, _ in held[s]) for s in held}
    for s in held:
        held[s].sort()
        while held[s] and total[s] > share:
            b, slot = held[s].pop()
            total[s] -= b
            pool.append((b, slot))
    lightest = [(t, s) for s, t in total.items()]
    heapq.heapify(lightest)
    for b, slot in sorted(pool, key=lambda x: (-x[0], x[1])):
        t, s = heapq.heappop(lightest)
        held[s].append((b, slot))
        total[s] = t + b
        heapq.heappush(lightest, (total[s], s))
    for _ in range(64 * shards):
        low, high = min(total, key=lambda s: (total[s], s)), max(total, key=lambda s: (total[s], -s))
        gap = total[high] - total[low]
        best = None
        small = sorted(held[low])
        for b, slot in held[high]:
            # the swap partner that brings the two closest: a slot lighter by half the gap, or none at all
            for c, other in [(0, None), *_near(small, b - gap / 2)]:
                after = abs(gap - 2 * (b - c))
                if after < gap and (best is None or (after, slot) < best[:2]):
                    best = (after, slot, b, c, other)
        if gap <= 1 or best is None:
            break
        _, slot, b, c, other = best
        held[high].remove((b, slot))
        held[low].append((b, slot))
        if other is not None:
            held[low].remove((c, other))
            held[high].append((c, other))
        total[high] += c - b
        total[low] += b - c
    return {slot: s for s, own in held.items() for _, slot in own}


def _near(ordered: list[tuple[int, int]], value: float) -> list[tuple[int, int]]:
    import bisect

    i = bisect.bisect_left(ordered, (value, -1))
    return ordered[max(0, i - 1): i + 1]


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The map at path, None where there is none yet."""
    try:
        return spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_versions(spark: SparkSession, path: str, versions: dict[int, dict[int, int]]) -> DataFrame:
    """Add versions to the table (version, vslot, shard) at path and read all of it."""
    rows = [(v, slot, shard) for v, m in versions.items() for slot, shard in sorted(m.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def plan_map(slim: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """The map at path with a version for these loads; only `slots` rows reach the driver.

    Without a stored map, version 1 deals the slots in turn and version 2 is edited from it.
    """
    spark = slim.sparkSession
    path = path or scratch_path(spark, "slot-map")
    loads = {r.vslot: r.bytes for r in slot_loads(slim).collect()}
    known = stored_map(spark, path)
    latest = known.agg(F.max("version").alias("version")).first().version if known is not None else None
    if latest is None:
        first = initial_map(slots, shards)
        return append_versions(spark, path, {1: first, 2: rebalance(first, loads, shards)})
    current = {r.vslot: r.shard for r in known.filter(F.col("version") == latest).collect()}
    if set(current) != set(range(slots)):
        raise ValueError(f"the map at {path} has {len(current)} virtual slots, not {slots}")
    edited = rebalance(current, loads, shards)
    return known if edited == current else append_versions(spark, path, {latest + 1: edited})


def place(slim: DataFrame, slot_map: DataFrame, version: int | None = None) -> DataFrame:
    """Add shard and `slot`, the record's place in its shard: 0, 1, 2 … without gaps, by virtual slot and id.

    Records are numbered inside their virtual slot and shifted by the rows of the shard's earlier slots, so
    the largest sorted group is one virtual slot of the slim columns.
    """
    latest = F.lit(version) if version else slot_map.agg(F.max("version").alias("version")).first().version
    chosen = slot_map.filter(F.col("version") == latest).select("vslot", "shard")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chosen.join(slot_loads(slim), "vslot", "left").select(
        "vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = slim.withColumn("place", F.row_number().over(inside))
    # the map has one row per virtual slot, a constant number
    return numbered.join(F.broadcast(offsets), "vslot").withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long"))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard of every record by the law `bytes`: total sizes of the shards are near equal."""
    slim = slotted(docs, slots)
    return place(slim, plan_map(slim, shards, slots, map_path))
