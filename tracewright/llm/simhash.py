"""SimHash near-duplicates, found by meeting at the anchors of a covering code.

Two 64-bit fingerprints that differ in at most t bits differ in at most t // b bits of one of b blocks. The
anchors of a block are the words of a perfect Hamming code over its low 2^r - 1 bits, times all values of the
remaining bits: every value lies within the covering radius 1 of an anchor. A fingerprint is at home at its
nearest anchor of each block and is replicated to every anchor within 1 + t // b. If x and y agree that closely
on a block, then y has been replicated to x's home there, so comparing each anchor's visitors with those at home
finds the pair. Fewer and wider blocks have more anchors but send a fingerprint to more of them, so that the number
of blocks goes by the number of fingerprints; every number finds the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.components import connected_components
from tracewright.scratch import fresh, stash

SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = (3, 2)
COMPARISONS_A_ROW = 50  # about what sending a fingerprint to one more anchor costs
SEED = 42
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is set if over half the shingle hashes have it; no word gives 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(tokens))
    cuts = map(slice, starts[: len(tokens) - span + 1].tolist(), ends[span - 1 :].tolist())
    n = len(tokens) - span + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        bits = np.unpackbits(hashes[at : at + ROWS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, one row per row of `docs`. A null text has fingerprint 0."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch, "doc_id long, fp long")


def block_layout(blocks: int) -> list[tuple[int, int, int]]:
    """(shift, width, Hamming bits) of each block of a 64-bit fingerprint."""
    out, shift = [], 0
    for i in range(blocks):
        width = 64 // blocks + (i < 64 % blocks)
        out.append((shift, width, (1 << (width + 1).bit_length() - 1) - 1))
        shift += width
    return out


def flips(width: int, hamming: int, most: int) -> list[list[int]]:
    """By syndrome: every mask of at most `most` bits of a block that turns a value of that syndrome into an anchor."""
    out: list[list[int]] = [[] for _ in range(hamming + 1)]
    for weight in range(most + 1):
        for bits in combinations(range(width), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < hamming else 0
            out[syndrome].append(sum(1 << b for b in bits))
    return out


def blocks_for(prints: int, most: int = MAX_BITS) -> int:
    """The number of blocks, of BLOCKS, with the least work a fingerprint: rows sent, and those at home where it is sent."""

    def work(blocks: int) -> float:
        out = 0.0
        for _, width, hamming in block_layout(blocks):
            visits = sum(comb(width, k) for k in range(2 + most // blocks)) / (hamming + 1)
            out += visits * (COMPARISONS_A_ROW + prints * (hamming + 1) / (1 << width))
        return out

    return min(BLOCKS, key=work)


def _syndrome(value: Column, hamming: int) -> Column:
    total = F.lit(0)
    for bit in range(hamming.bit_length()):
        mask = sum(1 << i for i in range(hamming) if (i + 1) >> bit & 1)
        total = total + F.bit_count(value.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)) * (1 << bit)
    return total


def _meetings(distinct: DataFrame, blocks: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, fp) of those at home and of all who are replicated there. The block's number is part of the anchor."""
    home, visit = [], []
    for number, (shift, width, hamming) in enumerate(block_layout(blocks)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        base = F.lit(number << width).cast("long")
        valued = distinct.select("fp", value.alias("value")).withColumn("syndrome", _syndrome(F.col("value"), hamming))
        nearest = F.when(F.col("syndrome") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, syndrome - 1)"))
        home.append(valued.select(F.col("value").bitwiseXOR(nearest).bitwiseOR(base).alias("anchor"), "fp"))
        table = F.lit(flips(width, hamming, 1 + most // blocks)).cast("array<array<bigint>>")
        reached = valued.select("fp", "value", F.explode(F.get(table, F.col("syndrome"))).alias("flip"))
        visit.append(reached.select(F.col("value").bitwiseXOR(F.col("flip")).bitwiseOR(base).alias("anchor"), "fp"))
    for parts in (home, visit):
        while len(parts) > 1:
            parts.append(parts.pop(0).unionByName(parts.pop(0)))
    return home[0], visit[0]


def links(distinct: DataFrame, most: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """(src, dst) for every two fingerprints of `distinct` (fp, a written table) at most `most` bits apart."""
    blocks = blocks or blocks_for(distinct.count(), most)
    home, visit = _meetings(distinct, blocks, most)
    met = home.alias("h").join(visit.alias("v"), (F.col("h.anchor") == F.col("v.anchor")) & (F.col("h.fp") < F.col("v.fp")) & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("v.fp"))) <= most))
    return met.select(F.col("h.fp").alias("src"), F.col("v.fp").alias("dst"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs` (doc_id, text); component_id is the smallest doc_id reachable.

    Equal fingerprints are one node, so a group of copies costs one row however large it is. Null and empty texts
    have fingerprint 0 and are linked with each other. Rows that repeat a doc_id each get a row; a null doc_id is
    never a component's smallest unless the component has no other. An empty table gives an empty table.
    """
    marked = stash(fingerprints(docs, words), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(links(stash(classes.select("fp"), "distinct"), most, blocks))
    labelled = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = labelled.join(smallest, "component").select("fp", "component_id")
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, most: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """`docs` with one row of each near-duplicate group, every column as it is.

    The row with the smallest doc_id stays, of several such rows one with the smallest fingerprint, a null doc_id only
    where the group has no other. Rows are told apart by a number of their own, so that repeated doc_ids and repeated
    rows, null doc_ids included, are decided one by one.
    """
    number, print_, at = fresh(docs, "row_number", "fingerprint", "text")
    names = [*docs.columns, print_]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], names)

    marked = docs.select("*", F.col("text").alias(at)).mapInArrow(per_batch, StructType([*docs.schema.fields, StructField(print_, LongType())]))
    kept = stash(marked.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = kept.select(F.col(number).alias("n"), F.col("doc_id").cast("long").alias("doc_id"), F.col(print_).alias("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n")).alias("first")
    classes = stash(rows.groupBy("fp").agg(first, F.count("*").alias("many")), "classes")
    parts = connected_components(links(classes.select("fp"), most, blocks))
    labelled = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first", "many", F.coalesce("component", "fp").alias("component"))
    keepers = labelled.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("many").alias("many")).where("many > 1")
    grouped = labelled.select("fp", "component").join(keepers, "component").select("fp", F.col("keeper.n").alias("keeper"))
    gone = rows.join(grouped, "fp").where("n != keeper").select(F.col("n").alias("_n"))
    return kept.join(gone, F.col(number) == F.col("_n"), "left_anti").select(*docs.columns)
