"""Sharding by longest-processing-time scheduling.

Rows with equal text form a group that must stay together. Groups are sorted
by size and each goes to the least-loaded shard, found through a heap.

Law ``bytes``: shard sizes come out near equal. What the heap sees is bounded
at any corpus size: a group larger than 1/65,536 of all bytes is an item of
its own (there are fewer than 65,536 such groups); all smaller groups are
gathered by their digest into 65,536 bundles, and each bundle is one item. On
a small corpus nearly every group is an item of its own; on a large one the
smallest bundles even out the loads.

Defined results: a null text counts as empty (same group as the empty text,
size 1, CRC 0); repeated rows and repeated ids are all placed; an empty table
gives no rows; extra columns are ignored whatever their names. Equal sizes are
ordered by digest, so reruns agree.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.llm.common import c, cut, digest

FINE = 65_536
ROWS_PER_BLOCK = 16_384


def longest_first(items: list[tuple[int, object]], shards: int) -> list[tuple[object, int]]:
    """(size, name) items to (name, shard): largest first, least-loaded shard next."""
    heap = [(0, s) for s in range(shards)]
    placed = []
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed.append((name, shard))
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Place every row: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(c(text_col), F.lit(""))
    rows = cut(docs.select(
        c(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest(text).alias("digest"),
    ))
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("group_size")))
    total = int(groups.agg(F.sum("group_size")).first()[0] or 0)
    big = F.col("group_size") > F.lit(total / FINE)

    def bundle(key):
        return F.pmod(F.xxhash64(key), F.lit(FINE)).cast("int")

    # Both lists are shorter than FINE rows: the bound of the collect and of the broadcasts.
    single = [(r.group_size, bytes(r.digest)) for r in groups.where(big).select("digest", "group_size").collect()]
    bundles = [(r.size, r.bundle) for r in groups.where(~big)
               .groupBy(bundle(F.col("digest")).alias("bundle")).agg(F.sum("group_size").alias("size")).collect()]
    items = [(s, (0, d)) for s, d in single] + [(s, (1, b)) for s, b in bundles]
    placed = longest_first(items, shards)
    of_group = spark.createDataFrame([(bytearray(n), s) for (k, n), s in placed if k == 0],
                                     "digest binary, own_shard int")
    of_bundle = spark.createDataFrame([(n, s) for (k, n), s in placed if k == 1],
                                      "bundle int, bundle_shard int")
    dealt = (
        rows.join(F.broadcast(of_group), "digest", "left")
        .withColumn("bundle", bundle(F.col("digest")))
        .join(F.broadcast(of_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
    )
    return number_slots(dealt).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def number_slots(dealt: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, without sorting a whole shard
    in one task: rows are numbered inside (shard, block) and each block starts
    where the blocks before it end. Blocks are dealt by a hash of the row."""
    dealt = cut(dealt)
    blocks = max(1, -(-dealt.count() // ROWS_PER_BLOCK))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "digest")
    return (dealt.withColumn("place", F.row_number().over(inside) - 1)
            .join(starts, ["shard", "block"])
            .withColumn("slot", (F.col("start") + F.col("place")).cast("long")))
