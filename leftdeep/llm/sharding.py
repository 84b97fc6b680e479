"""Shards of nearly equal bytes, by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups go in order of falling size to
the least loaded shard (the first of several), which a heap yields. Groups of one size are
interchangeable, so the driver schedules sizes with their counts: distinct sizes are no
more than the square root of twice all bytes, and usually far fewer. As soon as no load
exceeds another by as much as the size at hand, the heap would deal groups of that size
round by round in the same order; whole rounds are then taken at once. What the driver
returns is how many groups of each size every shard takes; which ones, their rank by hash
among the groups of that size says.

Groups are told apart by a 64-bit hash: texts that collide merely travel together. A null
text counts as empty; a text of any length is measured whole. Ranks and slots come from
the counts of hash buckets, so neither a shard nor the groups of one size are sorted in one
task; rows that are equal in everything share consecutive slots in any order. Ids of any
type are taken, nulls included. Only the two named columns are read, so that no other can
clash. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leftdeep.shared import stored


def quotas(sizes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each (size, count) how many of its groups every shard takes, largest size first."""
    out: list[list[int]] = [[]] * len(sizes)
    heap = [(0, s) for s in range(shards)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i][0]):
        size, left = sizes[i]
        took = [0] * shards
        while left:
            if left >= shards and max(heap)[0] - heap[0][0] < size:
                rounds, left = divmod(left, shards)
                heap = [(load + rounds * size, s) for load, s in heap]  # still in order
                took = [n + rounds for n in took]
                continue
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            took[s] += 1
            left -= 1
        out[i] = took
    return out


def _rank(df: DataFrame, of: list[str], bucket: str, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``, each row's number from 0 on among those equal in ``of``: those of
    lower ``bucket`` come first."""
    before = Window.partitionBy(*of).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*of, bucket).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*of, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*of, bucket).orderBy(*order))
    return df.withColumn("_own", own).join(starts, [*of, bucket]).withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_own", "_start")


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 12) -> DataFrame:
    """Returns id, size (UTF-8 bytes + 1), text_crc32, shard and slot for each row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = stored(
        df.select(
            F.col(f"`{id_col}`").alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("_group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_bytes"))
    groups = stored(groups.withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(buckets)).cast("int")), "shard-groups")
    tally = [(r["_bytes"], r["n"]) for r in groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    ends = [(size, [sum(q[: s + 1]) for s in range(shards)]) for (size, _), q in zip(tally, quotas(tally, shards), strict=True)]
    dealt = spark.createDataFrame(ends, "_bytes long, _ends array<long>")
    ranked = _rank(groups, ["_bytes"], "_bucket", ["_group"], "_rank").join(dealt, "_bytes")
    placed = ranked.select("_group", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard"))
    placed = rows.join(placed, "_group").withColumn("_bucket", F.pmod(F.xxhash64("_id", F.lit("slot")), F.lit(buckets)).cast("int"))
    out = _rank(stored(placed, "sharded"), ["shard"], "_bucket", ["_id", "text_crc32", "size", "_group"], "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")
