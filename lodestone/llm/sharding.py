"""Sharding: longest-processing-time scheduling of groups of equal texts.

Groups that must stay together are sorted by size and each goes to the least-loaded shard through a heap. The heap
sees a bounded number of items at any corpus size: a group holding at least one part in ``shards * fine`` of all
bytes is an item of its own (there are at most ``shards * fine`` of those), and the smaller groups are hashed into
``shards * fine`` buckets, each of which is one item. A bucket holds whole groups, so equal texts stay together.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions


def longest_first(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Place (name, size) items, largest first, each on the least-loaded shard; ties by name and shard number."""
    heap = [(0, k) for k in range(shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        placed[name] = k
        heapq.heappush(heap, (load + size, k))
    return placed


def shard_documents(docs: DataFrame, shards: int = 24, fine: int = 1000) -> DataFrame:
    """Return doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    Null texts have no bytes, a null checksum counts as that of the empty text, and they form one group of their own.
    Repeated rows are rows like any other and share their text's shard. Rows without doc_id come first in their
    shard. ``slot`` is the rank by doc_id inside the shard. An empty table gives an empty result. Only doc_id and
    text are read, so further columns cannot clash.
    """
    spark, n = docs.sparkSession, shards * fine
    text = F.col("text")
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null")).alias("content"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    groups = sized.groupBy("content").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("content"), F.lit(n)).cast("string")
    item = F.when(F.col("bytes") * n >= total, F.col("content")).otherwise(bucket)
    # at most n large groups and n buckets, whatever the corpus holds
    items = [(r["item"], r["bytes"]) for r in groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()]
    placed = spark.createDataFrame(list(longest_first(items, shards).items()) or [("", 0)], "item string, shard int")
    large = F.broadcast(placed.filter(F.length("item") == 32).select(F.col("item").alias("content"), F.col("shard").alias("own")))
    small = F.broadcast(placed.filter(F.length("item") != 32).select(F.col("item").alias("bucket"), "shard"))
    null_group = F.broadcast(placed.filter(F.col("item") == "null").select(F.col("item").alias("content"), F.col("shard").alias("of_null")))
    put = (
        sized.join(large, "content", "left").join(null_group, "content", "left").withColumn("bucket", bucket).join(small, "bucket", "left")
        .select("doc_id", "size", "text_crc32", "row", F.coalesce("own", "of_null", "shard").alias("shard"))
    )
    # slots: ranks inside a range of doc_id, then the ranges' running totals
    dealt = materialise(put.repartitionByRange(partitions(spark), "doc_id", "row").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part", "shard").count().select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "row"))
    return (
        dealt.withColumn("rank", rank).join(offsets, ["part", "shard"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
