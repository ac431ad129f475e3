"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sizes are counted in words. A target per source (weights reshared until none exceeds `MAX_PASSES` times what the
source has) is met with blocks of equal length: blocks go to the source with the highest quotient
target / (2 * seats + 1), the last block of a source may be short, so that no source misses its target by a block.
What a source gets goes to its shards in the same way by their sizes, word by word, which gives an integer quota per
shard whose sum is exact. In a shard the documents stand in a seeded order, the end joined to the beginning; its
quota is read as one run of consecutive blocks from a seeded start, so that a text is repeated only when the source
is short and never more than MAX_PASSES times, and few documents are cut. The driver holds a few numbers per source;
shards are apportioned by the executors.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.scratch import stash

WORD = r"[^\x20\x09-\x0D]+"
MAX_PASSES = 3
BLOCK_WORDS = 16
ROWS_PER_SHARD = 20_000
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MAX_PASSES) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above `most` times its own size; what a full source leaves is reshared."""
    out, open_, left = [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], Fraction(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def apportion(votes: list[Fraction], limits: list[int], seats: int) -> list[int]:
    """Sainte-Laguë seats with a limit for each party: the highest quotients votes / (2 * won + 1) win, ties to the first."""
    seats = min(seats, sum(limit for v, limit in zip(votes, limits) if v > 0))
    total, won = sum(votes), [0] * len(votes)
    if not total or not seats:
        return won
    # Rounding costs the divisor half a seat per party at most, so these seats are sure; the rest is dealt one by one.
    unit = max(Fraction(0), seats - Fraction(len(votes), 2)) / total
    for i, v in enumerate(votes):
        won[i] = max(0, min(limits[i], int(v * unit - Fraction(1, 2))))
    quotients = [(-v / (2 * won[i] + 1), i) for i, v in enumerate(votes) if v > 0 and won[i] < limits[i]]
    heapq.heapify(quotients)
    left = seats - sum(won)
    while left:
        _, i = heapq.heappop(quotients)
        won[i] += 1
        left -= 1
        if won[i] < limits[i]:
            heapq.heappush(quotients, (-votes[i] / (2 * won[i] + 1), i))
    return won


def _in_code_point_order(names: list[str | None]) -> list[str | None]:
    return sorted(names, key=lambda s: (s is None, s or ""))


def plan(sizes: dict[str | None, int], weights: tuple[int, ...], block: int, most: int) -> dict[str | None, tuple[float, int]]:
    """(target, words to take) by source. A source's last block is cut, or a part of one more added, where that meets the target to the word."""
    names = _in_code_point_order(list(sizes))
    wanted = targets([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], most)
    seats = apportion(wanted, [-(-most * sizes[s] // block) for s in names], round(sum(wanted) / block))
    takes = [max((won - 1) * block, min(round(w), (won + 1) * block)) for w, won in zip(wanted, seats)]
    return {s: (float(w), max(0, min(take, most * sizes[s]))) for s, w, take in zip(names, wanted, takes)}


def quotas(cells: DataFrame) -> DataFrame:
    """`cells` (source, _shard, words, source_size, take) with quota: `take` words by highest quotients words / (2 * quota + 1), ties to the first shard.

    Rounding down at half a word per shard less than due gives words that are sure; a shard can win at most
    words * shards / source_size + 2 more, and the highest of these quotients win what is left.
    """
    shards, exact = F.col("shards").cast("decimal(38,0)"), lambda c: F.col(c).cast("decimal(38,0)")
    of_source = Window.partitionBy("source")
    counted = cells.where("words > 0").withColumn("shards", F.count("*").over(of_source))
    due = (exact("words") * (2 * F.col("take") - F.col("shards")).cast("decimal(20,0)") - exact("source_size")) / (2 * exact("source_size"))
    sure = counted.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(due).cast("long")))
    left = sure.withColumn("left", F.col("take") - F.sum("sure").over(of_source))
    more = F.floor(exact("words") * shards / exact("source_size")).cast("int") + 2
    each = left.select("source", "_shard", "words", "sure", "left", F.explode(F.sequence(F.lit(0), more - 1)).alias("nth"))
    quotient = F.col("words") / (2 * (F.col("sure") + F.col("nth")) + 1)
    best = Window.partitionBy("source").orderBy(F.desc("quotient"), "_shard", "nth")
    won = each.withColumn("quotient", quotient).withColumn("place", F.row_number().over(best))
    return won.groupBy("source", "_shard").agg((F.first("sure") + F.count(F.when(F.col("place") <= F.col("left"), 1))).alias("quota"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK_WORDS, most: int = MAX_PASSES, seed: int = SEED, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Every row of `docs` (doc_id, text, source) as `row`, with size, source_size, target, taken, and what is taken.

    `passes` whole readings of a document are taken and, beyond them, the words from `head_from` up to `head_until`
    and from `tail_from` up to `tail_until` (counted from 0, either may be empty). Sources stand in code point order,
    null last, and weigh `weights`, repeating. Null and empty texts have size 0 and nothing is taken of them. Rows
    that repeat a doc_id are rows of their own. Ties in the seeded order fall to doc_id and a hash of the text. An
    empty table gives an empty table. What a source gets differs from its target by less than a block, however its
    documents lie in shards.
    """
    known = [F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")]
    rows = docs.select(*known, word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
    n = rows.count()
    shards = max(1, -(-n // rows_per_shard))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "_tie"), F.lit(shards)).cast("int")
    kept = rows.select("*", shard.alias("_shard"), F.xxhash64(F.lit(seed), "doc_id").alias("_order"))
    cells = stash(kept.groupBy("source", "_shard").agg(F.sum("size").alias("words")), "cells")
    sums = cells.groupBy("source").agg(F.sum("words").alias("words")).toArrow()  # a row per source
    sizes = dict(zip(sums.column("source").to_pylist(), sums.column("words").to_pylist()))
    table = [(s, sizes[s], target, take) for s, (target, take) in plan(sizes, weights, block, most).items()]
    of_source = docs.sparkSession.createDataFrame(table, "_name string, source_size long, target double, take long")
    told = cells.join(of_source, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    won = quotas(told).select(F.col("source").alias("_source"), F.col("_shard").alias("_part"), "quota")
    same_cell = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_part"))
    full = told.join(won, same_cell, "left").select(F.col("source").alias("_name"), F.col("_shard").alias("_part"), "source_size", "target", F.col("words").alias("_cell"), F.coalesce("quota", F.lit(0).cast("long")).alias("_quota"))
    # A written table, whose size Spark knows: it is broadcast where that is small, else joined by its key.
    joined = kept.join(stash(full, "quotas"), F.col("source").eqNullSafe(F.col("_name")) & (F.col("_shard") == F.col("_part")))
    in_cell = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.withColumn("_until", F.sum("size").over(in_cell))
    return _taken(placed, seed)


def _taken(placed: DataFrame, seed: int) -> DataFrame:
    """Which words the run of quota words from a seeded start takes of each document of a circular shard."""
    size, cell, until = (F.col(c) for c in ("size", "_cell", "_until"))
    begin = until - size
    start = F.when(cell > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "_shard"), F.when(cell > 0, cell))).otherwise(0)
    passes = F.when(cell > 0, F.expr("_quota div nullif(_cell, 0)")).otherwise(0).cast("long")
    walked = placed.withColumn("_start", start).withColumn("_passes", passes).withColumn("_rest", F.col("_quota") - F.col("_passes") * cell)
    start, end = F.col("_start"), F.col("_start") + F.col("_rest")

    def clip(at: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size, at - begin)).cast("long")

    out = walked.select(
        "row",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.col("_passes").alias("passes"),
        F.lit(0).cast("long").alias("head_from"),
        clip(end - cell).alias("head_until"),
        clip(start).alias("tail_from"),
        clip(end).alias("tail_until"),
    )
    taken = F.col("passes") * F.col("size") + F.col("head_until") + (F.col("tail_until") - F.col("tail_from"))
    return out.withColumn("taken", taken.cast("long"))


def written_out(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as documents: a row for each whole reading and one for a part, whose words are joined by one space."""
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    part_of = lambda a, b: F.slice(words, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    part = F.array_join(F.concat(part_of("head_from", "head_until"), part_of("tail_from", "tail_until")), " ")
    some = F.col("taken") > F.col("passes") * F.col("size")
    texts = F.concat(F.array_repeat(F.col("row.text"), F.col("passes").cast("int")), F.when(some, F.array(part)).otherwise(F.array().cast("array<string>")))
    rows = mix.where("taken > 0").select("row", F.explode(texts).alias("_part"))
    own = {"text": F.col("_part"), "n_chars": F.length("_part").cast("long")}
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
