"""Shards by minimax contiguous partition, with DataFrame functions only.

Documents of equal text form one atomic group. The groups stand in a fixed order, and a shard is a run of
neighbouring groups. The smallest capacity that a greedy walk fills in at most the given number of shards is
searched for: each round tries several capacities at once, and each walk asks the table of running sizes for the
last group that still fits. The driver holds one number per capacity and one per order bucket, never a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.scratch import discard, stash

SHARDS = 8
ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 4096
PROBES = 24


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) per row: UTF-8 bytes plus 1, CRC-32 and a digest of the text. Null counts as empty."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"), F.sha2(data, 256).alias("key"))


def _ordered_groups(rows: DataFrame) -> tuple[DataFrame, list[int], int, int]:
    """Groups with `until`, the running size up to their end in the order of (smallest doc_id, key); into how many
    parts each order bucket is dealt for numbering; all groups' size and the largest one's."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    n = rows.count()
    most = max(ROWS_PER_BUCKET, -(-n // MAX_BUCKETS))
    buckets = min(MAX_BUCKETS, 4 * -(-max(n, 1) // most))
    ranged = groups.repartitionByRange(buckets, F.col("first_id").asc_nulls_last(), "key").withColumn("bucket", F.spark_partition_id())
    ranged = stash(ranged, "groups")
    sums = {r.bucket: (r.size, r.n) for r in ranged.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()}
    before, parts, running = [], [], 0
    for b in range(max(sums, default=-1) + 1):
        size, rows_in = sums.get(b, (0, 0))
        before.append(running)
        parts.append(max(1, -(-rows_in // most)))
        running += size
    in_bucket = Window.partitionBy("bucket").orderBy(F.col("first_id").asc_nulls_last(), "key").rowsBetween(Window.unboundedPreceding, 0)
    until = (F.sum("size").over(in_bucket) + F.get(F.lit(before or [0]).cast("array<bigint>"), F.col("bucket"))).alias("until")
    placed = stash(ranged.select("key", "size", "bucket", until), "ordered")
    discard(ranged)
    largest = placed.agg(F.max("size")).first()[0] or 0
    return placed, parts or [1], running, largest


def _walks(placed: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity, where a greedy walk ends its first `shards` shards."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        limits = [e[-1] + c for e, c in zip(ends, capacities)]
        reached = placed.agg(*[F.max(F.when(F.col("until") <= limit, F.col("until"))).alias(f"c{i}") for i, limit in enumerate(limits)]).first()
        for i, e in enumerate(ends):
            e.append(max(e[-1], reached[i] or 0))
    return [e[1:] for e in ends]


def smallest_cuts(placed: DataFrame, total: int, largest: int, shards: int = SHARDS) -> list[int]:
    """Ends of the shards, as running sizes, under the smallest capacity that suffices."""
    low = max(largest, -(-total // shards))
    high = low + largest  # a greedy walk with this much leaves every shard but the last over total / shards
    cuts: list[int] | None = None
    while cuts is None or low < high:
        step = max(1, -(-(high - low + 1) // PROBES))
        tried = sorted({*range(low, high + 1, step), high})
        for capacity, ends in zip(tried, _walks(placed, tried, shards)):
            if ends[-1] >= total:
                high, cuts = capacity, ends
                break
            low = capacity + 1
    return even_cuts(placed, total, high, shards) or cuts


def even_cuts(placed: DataFrame, total: int, capacity: int, shards: int) -> list[int] | None:
    """Cuts under the same capacity that share evenly what is left; None if the last shard would exceed it."""
    ends = [0]
    for left in range(shards, 1, -1):
        start, aim = ends[-1], -(-(total - ends[-1]) // left)
        reached = placed.agg(F.min(F.when(F.col("until") >= start + aim, F.col("until"))), F.max(F.when(F.col("until") <= start + capacity, F.col("until")))).first()
        ends.append(max(start, min(reached[0] if reached[0] is not None else total, reached[1] or 0)))
    return [*ends[1:], total] if total - ends[-1] <= capacity else None


def _shard_of(until: Column, cuts: list[int]) -> Column:
    shard = F.lit(0)
    for end in cuts[:-1]:
        shard = shard + (until > end).cast("int")
    return shard


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot) per row of `docs` (doc_id, text).

    No shard is larger than the smallest capacity at which contiguous groups fit; rows of equal text share a
    shard, even if together they exceed an even share. Null texts count as empty ones; null doc_ids come last in
    the order; repeated rows each get a slot of their own. An empty table gives an empty table.
    """
    rows = stash(described(docs), "described")
    placed, parts, total, largest = _ordered_groups(rows)
    cuts = smallest_cuts(placed, total, largest, shards)
    of_group = placed.select("key", "bucket", _shard_of(F.col("until"), cuts).alias("shard"))
    salt = F.pmod(F.xxhash64("doc_id"), F.get(F.lit(parts).cast("array<bigint>"), F.col("bucket"))).cast("int")
    dealt = stash(rows.join(of_group, "key").withColumn("salt", salt), "dealt")
    counts = dealt.groupBy("shard", "bucket", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket", "salt").orderBy(F.col("doc_id").asc_nulls_last(), "key")
    numbered = dealt.withColumn("nth", F.row_number().over(within) - 1)
    # At most 2 * MAX_BUCKETS parts and a few more for the buckets that a cut divides: a bounded table.
    return numbered.join(F.broadcast(offsets), ["shard", "bucket", "salt"]).select("doc_id", "size", "text_crc32", "key", "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"))
