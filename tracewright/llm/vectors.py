"""Which vectors take part, helpers on Arrow columns of vectors, and queries that stream past sharded indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


QUERIES_PER_BLOCK = 500_000
LEAST_QUERIES = 20_000
LEAST_TASKS = 64


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number, some component not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cleaned(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of every row; a vector that takes no part is null: unusable ones and those of another length than most.

    Of equally common lengths the smallest counts.
    """
    vector = F.col("embedding").cast("array<float>")
    told = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(vector), vector).alias("embedding"))
    sizes = told.where("embedding is not null").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return told
    return told.withColumn("embedding", F.when(F.size("embedding") == sizes.dims, F.col("embedding")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix of 32-bit floats."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.float32)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def normalized(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    scaled = vectors.astype(np.float64) / np.abs(vectors).max(axis=1, keepdims=True).astype(np.float64)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Shard(Protocol):
    """What one task holds of a shard while queries stream past."""

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]: ...

    def done(self) -> Iterator[pa.RecordBatch]: ...


def past_shards(held: DataFrame, asked: DataFrame, shards: int, n_asked: int, begin: Callable[[list[bytes]], Shard], schema: str) -> DataFrame:
    """What the shards of `held` (shard, parts: one row each) answer to every query of `asked` (id, vector).

    A task reads a shard's index first and then the queries batch by batch, so it never holds more of them than a
    batch. Indexes are copied for each QUERIES_PER_BLOCK queries, or, where there are few shards, to give LEAST_TASKS.
    """
    blocks = max(1, -(-n_asked // QUERIES_PER_BLOCK), min(-(-n_asked // LEAST_QUERIES), -(-LEAST_TASKS // shards)))
    block = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(blocks)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    indexes = held.select("shard", numbers(blocks).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<float>").alias("vector"), "parts")
    queries = asked.select("id", "vector", block.alias("block"), numbers(shards).alias("shard")).select("shard", "block", F.lit(1).alias("kind"), "id", "vector", F.lit(None).cast("array<binary>").alias("parts"))

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if start == end:
                    continue
                key, part = (int(keys[start, 0]), int(keys[start, 1])), batch.slice(start, end - start)
                if key != at:
                    if shard is not None:
                        yield from shard.done()
                    shard, at = None, key
                if keys[start, 2] == 0:
                    shard = begin(part.column(5)[0].as_py())
                elif shard is not None:
                    yield from shard.ask(part.column(3).to_numpy(), matrix(part.column(4)))
        if shard is not None:
            yield from shard.done()

    dealt = indexes.unionByName(queries).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "id")
    return dealt.mapInArrow(per_partition, schema)
