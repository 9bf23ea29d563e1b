"""Sharding by longest-processing-time scheduling.

Rows that must stay together (equal texts) form groups. The scheduler sorts units by size and gives each to the
least-loaded shard through a heap. Units are single groups where a group is large (over ``1/light`` of a shard, so there
are at most ``shards * light`` of these), and fixed hash bundles of the small groups, of which there are at most
``bundles``. So what reaches the driver is bounded by these two parameters at every size of input, while every row keeps
its own exact size.

Nulls: a null text weighs only the overhead and groups with the empty text; a null id is placed like any other row.
Repeated rows are rows of their own, in the same shard as their group. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, utf8

#: Rows that one task ranks at a time, roughly; larger units are ranked in blocks.
BLOCK_ROWS = 1000


def schedule(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest processing time first: (unit, size) pairs to a shard for each unit. Ties go to the smaller unit and shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for unit, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, shard = heap[0]
        placed[unit] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def shard_by_size(docs: DataFrame, shards: int, overhead: int = 16, light: int = 256, bundles: int = 65536) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard, slot, unit. Slots are gapless in a shard."""
    spark = docs.sparkSession
    raw = utf8("text")
    rows = materialize(
        docs.select("doc_id", (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("grp")),
        "shard-rows",
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bound = max(1, total // (shards * light))
    # At most shards * light groups are this large, whatever the input.
    groups = groups.select("grp", "size", "n", (F.col("size") > bound).alias("big"), F.pmod(F.xxhash64("grp"), F.lit(bundles)).alias("bundle"))
    heavy = sorted(((r["size"], bytes(r["grp"]), r["n"]) for r in groups.filter("big").collect()), reverse=True)
    small = [(r["bundle"], r["size"], r["n"]) for r in groups.filter("not big").groupBy("bundle").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()]
    units = small + [(bundles + k, size, n) for k, (size, _, n) in enumerate(heavy)]
    placed = schedule([(u, size) for u, size, _ in units], shards)
    # A unit's rows are ranked in blocks, and each block starts where the ones before it end.
    table = spark.createDataFrame([(u, placed[u], max(1, -(-n // BLOCK_ROWS))) for u, _, n in units], "unit long, shard int, blocks long")
    names = spark.createDataFrame([(bytearray(g), bundles + k) for k, (_, g, _) in enumerate(heavy)], "grp binary, heavy long")
    at = (
        rows.join(F.broadcast(names), "grp", "left")
        .withColumn("unit", F.coalesce("heavy", F.pmod(F.xxhash64("grp"), F.lit(bundles))))
        .join(F.broadcast(table), "unit")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")))
        .select("doc_id", "size", "text_crc32", "shard", "unit", "block")
    )
    counts = at.groupBy("shard", "unit", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("unit", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("unit", "block").orderBy("doc_id", "size"))
    return at.withColumn("rank", rank).join(starts, ["unit", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "unit")
