"""Sharding by longest-processing-time scheduling (LPT).

Rows with equal texts form a group that stays together.  Groups are sorted by size and each goes to
the least-loaded shard, kept in a heap.

LPT over all groups would be one sequential pass over the data, so only a bounded number of items is
scheduled: every group of at least 1/``fineness`` of a mean shard is an item of its own (there are at
most ``n_shards * fineness`` of them), and the smaller groups are hashed into ``n_shards * fineness``
bundles, each scheduled as one item.  Both sums are map-side combined aggregates; the heap sees at most
``2 * n_shards * fineness`` (key, size) pairs whatever the input, and its answer is broadcast under the
same bound.  Loads differ by about one bundle (0.1 % of a shard) unless a single group is larger than a
shard, which no law that keeps groups together can even out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import rank_within, save

FINENESS = 1024


def lpt(items: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """Largest item first, each to the least-loaded shard; ties by key and by shard number."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24,
                  overhead: int = 8, fineness: int = FINENESS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per input row.

    ``size`` = UTF-8 bytes + ``overhead``; a null text counts as empty and is grouped with empty ones.
    ``slot`` is gapless from 0 inside a shard.  Repeated rows and null ids are kept as rows of their
    own; other columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("_group")), "shard-rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_load"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_bundles = n_shards * fineness
    large = F.col("_load") * n_bundles >= F.lit(total)
    by_item = (groups.select(F.when(large, F.concat(F.lit("g"), F.hex("_group")))
                             .otherwise(F.concat(F.lit("b"), _bundle(n_bundles))).alias("item"), "_load")
               .groupBy("item").agg(F.sum("_load").cast("long").alias("load")))
    items = [(r["item"], r["load"]) for r in by_item.collect()]     # <= 2 * n_shards * fineness
    placed = spark.createDataFrame(list(lpt(items, n_shards).items()) or [("", 0)], "item string, shard int")
    big = placed.where("item like 'g%'").select(F.unhex(F.expr("substr(item, 2)")).alias("_group"),
                                                F.col("shard").alias("_big"))
    small = placed.where("item like 'b%'").select(F.expr("substr(item, 2)").alias("_b"), F.col("shard").alias("_small"))
    out = (rows.join(F.broadcast(big), "_group", "left")
           .withColumn("_b", _bundle(n_bundles)).join(F.broadcast(small), "_b", "left")
           .select("doc_id", "size", "text_crc32", F.coalesce("_big", "_small").alias("shard")))
    return rank_within(save(out, "shard-assigned"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def _bundle(n: int):
    return F.pmod(F.xxhash64("_group"), F.lit(n)).cast("string")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` (unique ids) as one folder per shard, ordered by slot inside its files."""
    placed = shards.select(F.col("doc_id").alias(id_col), "shard", "slot")
    (docs.join(placed, id_col).repartition("shard", F.pmod("slot", F.lit(8)))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def op6_lpt_shards(spark, sf_dir):
    from seqspark.llm.common import table
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
