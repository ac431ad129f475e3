"""Nearest neighbours by multi-index hashing.

Vectors get binary codes from a learned rotation (principal directions of a bounded sample, turned so that signs lose
little). A code is split into substrings of about as many values as a shard has rows, each indexed by its value. Two
codes within Hamming radius r agree to within r // m bits on one of m substrings, so probing all values that close
retrieves every code within the radius. Indexes are written once, and the queries stream past them. Those are reranked by the inner product of the original vectors. The radius is the smallest at which
audit queries, answered by brute force over all rows, reach the target recall. Queries that find fewer than k rows
within it are asked again with twice the radius, up to all bits, which leaves no candidate out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.vectors import cleaned, matrix, past_shards
from tracewright.scratch import stash

MAX_SUBSTRING_BITS = 16
LEAST_SUBSTRING_BITS = 6
MAX_BITS = 64
SAMPLE = 20_000
AUDIT = 128
TARGET_RECALL = 0.95
TURNS = 30
VECTORS_PER_SHARD = 50_000
LEAST_SHARDS = 8
EVERY = 20
NEAREST = 20


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that makes all lengths alike, so that the order by angle to a query is that by inner product."""
    v = vectors.astype(np.float64) / longest
    return np.concatenate((v, np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1, keepdims=True)))), axis=1)


def learn(sample: np.ndarray, seed: int = 7) -> np.ndarray:
    """A matrix whose products' signs are the bits of a code: principal directions times a rotation."""
    _, _, directions = np.linalg.svd(sample.T @ sample)
    bits = min(MAX_BITS, sample.shape[1])
    base = directions[:bits].T
    projected = sample @ base
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(TURNS):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(signs.T @ projected)
        turn = (u @ w).T
    return base @ turn


def substring_bits(rows: float) -> int:
    """Bits of a substring for an index of so many rows: about as many values as rows."""
    return int(np.clip(np.ceil(np.log2(max(rows, 2))), LEAST_SUBSTRING_BITS, MAX_SUBSTRING_BITS))


def codes(vectors: np.ndarray, longest: float, projection: np.ndarray, width: int = 8) -> np.ndarray:
    """One row of substrings of at most `width` bits per vector, as 16-bit numbers."""
    bits = lifted(vectors, longest) @ projection >= 0
    parts = np.array_split(np.arange(bits.shape[1]), -(-bits.shape[1] // width))
    return np.stack([bits[:, p] @ (1 << np.arange(len(p))) for p in parts], axis=1).astype(np.uint16)


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    return np.cumsum(vectors.astype(np.float64) * query.astype(np.float64), axis=1)[:, -1]


class SubstringIndex:
    """Positions by the value of each substring of their codes."""

    def __init__(self, code: np.ndarray, order: np.ndarray | None = None):
        self.code = code
        self.order = np.argsort(code, axis=0, kind="stable").astype(np.int32).T if order is None else order
        self.values, self.start = [], []
        for j, positions in enumerate(self.order):
            held = code[positions, j]
            first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, np.int64)
            self.values.append(held[first])
            self.start.append(np.append(first, len(held)))
        self.probed = 0

    def probe(self, j: int, value: int, radius: int) -> np.ndarray:
        """Positions whose substring j is within `radius` bits of `value`: near values are enumerated while they are fewer than those held."""
        values, start = self.values[j], self.start[j]
        if sum(comb(MAX_SUBSTRING_BITS, i) for i in range(radius + 1)) < len(values):
            wanted = _MASKS[: _MASKS_UP_TO[radius]] ^ np.uint16(value)
            at = np.searchsorted(values, wanted)
            at = at[values[np.minimum(at, len(values) - 1)] == wanted]
        else:
            at = np.flatnonzero(np.bitwise_count(values ^ np.uint16(value)) <= radius)
        sizes = start[at + 1] - start[at]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.order[j][np.repeat(start[at], sizes) + within]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every position whose code is at most `radius` bits from `code`.

        With radius = m * a + b over m substrings, a code that is further than a bits off in each of the first b + 1
        substrings and further than a - 1 in all others is more than radius off.
        """
        seen = np.zeros(len(self.code), bool)
        base, more = divmod(radius, len(code))
        for j, value in enumerate(code.tolist()):
            reach = base if j <= more else base - 1
            if reach >= 0:
                seen[self.probe(j, value, min(reach, MAX_SUBSTRING_BITS))] = True
        found = np.flatnonzero(seen)
        self.probed += len(found)
        return found[np.bitwise_count(self.code[found] ^ code).sum(axis=1) <= radius]


#: All substrings by the number of their bits, and how many have at most so many.
_MASKS = np.arange(1 << MAX_SUBSTRING_BITS, dtype=np.uint16)
_MASKS = _MASKS[np.argsort(np.bitwise_count(_MASKS), kind="stable")]
_MASKS_UP_TO = np.cumsum([comb(MAX_SUBSTRING_BITS, i) for i in range(MAX_SUBSTRING_BITS + 1)])


def best(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best, ties to the smaller id; the query's own id is left out. An id with several vectors counts with its best."""
    rough = vectors @ query.astype(np.float64)
    rough[ids == query_id] = -np.inf
    names, which = np.unique(ids, return_inverse=True)
    top = rough
    if len(names) < len(ids):
        top = np.full(len(names), -np.inf)
        np.maximum.at(top, which, rough)
    if len(top) > 2 * k:
        least = np.partition(top, len(top) - k)[len(top) - k]
        near = np.flatnonzero(rough >= least - 1e-9 * max(1.0, abs(least)))
    else:
        near = np.flatnonzero(rough > -np.inf)
    near = near[ids[near] != query_id]
    exact = scores(vectors[near], query)
    order = np.lexsort((ids[near], -exact))
    if len(names) < len(ids):
        _, first = np.unique(ids[near][order], return_index=True)
        order = order[np.sort(first)]
    return ids[near][order[:k]], exact[order[:k]]


class _Answers:
    """One shard's nearest rows to each query that streams past."""

    def __init__(self, parts: list[bytes], radius: int | None, longest: float, projection: np.ndarray, width: int, k: int):
        self.ids = np.frombuffer(parts[0], np.int64)
        self.vectors = np.frombuffer(parts[1], np.float32).reshape(len(self.ids), -1).astype(np.float64)
        code = np.frombuffer(parts[2], np.uint16).reshape(len(self.ids), -1)
        self.index = SubstringIndex(code, np.frombuffer(parts[3], np.int32).reshape(-1, len(self.ids)))
        self.radius, self.longest, self.projection, self.width, self.k = radius, longest, projection, width, k

    def ask(self, query_ids: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = codes(queries / np.linalg.norm(queries.astype(np.float64), axis=1, keepdims=True), 1.0, self.projection, self.width)
        out: list[tuple[np.ndarray, ...]] = []
        for query_id, query, bits in zip(query_ids.tolist(), queries, own):
            at = np.arange(len(self.ids)) if self.radius is None else self.index.within(bits, self.radius)
            found, score = best(self.ids[at], self.vectors[at], query_id, query, self.k)
            distance = np.zeros(len(found), np.int64)
            if self.radius is None and len(found):  # an audit asks how far the codes of the true neighbours are
                far = np.bitwise_count(self.index.code ^ bits).sum(axis=1)
                distance = np.array([far[self.ids == f].min() for f in found], np.int64)
            out.append((np.full(len(found), query_id), found, score, distance))
        columns = [np.concatenate(c) for c in zip(*out)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", "vec_id", "score", "distance"])

    def done(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def indexed(candidates: DataFrame, shards: int, longest: float, projection: np.ndarray, width: int) -> DataFrame:
    """(shard, parts): a row per shard with its ids, vectors, codes and the order of its positions by each substring."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = matrix(table.column("embedding"))
        index = SubstringIndex(codes(vectors, longest, projection, width))
        parts = [table.column("vec_id").to_numpy().astype(np.int64).tobytes(), vectors.tobytes(), index.code.tobytes(), np.ascontiguousarray(index.order).tobytes()]
        return pa.table({"shard": table.column("shard").slice(0, 1), "parts": pa.array([parts], pa.list_(pa.binary()))})

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    return candidates.select("vec_id", "embedding", shard.alias("shard")).groupBy("shard").applyInArrow(build, "shard int, parts array<binary>")


@dataclass(frozen=True)
class Indexes:
    """The written indexes of all shards and what their codes were made with."""

    table: DataFrame
    shards: int
    longest: float
    projection: np.ndarray
    width: int


def search(indexes: Indexes, queries: DataFrame, radius: int | None, k: int) -> DataFrame:
    """(query_id, vec_id, score, distance) of the k best of each shard for each query; all candidates count where radius is None."""
    longest, projection, width = indexes.longest, indexes.projection, indexes.width
    asked = queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return past_shards(indexes.table, asked, indexes.shards, queries.count(), lambda parts: _Answers(parts, radius, longest, projection, width, k), "query_id long, vec_id long, score double, distance long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; where one query or candidate has several vectors, the best of them counts."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("distance").alias("distance"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def widened(indexes: Indexes, queries: DataFrame, radius: int, k: int, least: int) -> DataFrame:
    """The k best of each query within `radius`; those that hold fewer than `least` are asked again with twice the radius, up to all bits."""
    bits, done = indexes.projection.shape[1], []
    while True:
        found = stash(ranked(search(indexes, queries, radius, k), k), "found")
        whole = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
        short = stash(queries.join(whole, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
        if radius >= bits or short.isEmpty():
            return reduce(DataFrame.unionByName, done, found)
        done.append(found.join(whole, "query_id", "left_semi"))
        queries, radius = short, min(bits, 2 * max(radius, 1))


def nearest(rows: DataFrame, every: int = EVERY, k: int = NEAREST, target: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by inner product of each row whose vec_id `every` divides.

    Null, zero, non-finite and odd-length vectors and rows without vec_id take no part. Rows that repeat vec_id and
    vector count once; where a vec_id has several vectors, all of them ask and answer and the largest product counts.
    Ties go to the smaller vec_id. A query with fewer candidates than k gets all of them. An empty table gives an empty
    table.
    """
    vectors = stash(cleaned(rows).where("vec_id is not null and embedding is not null").distinct(), "vectors")
    queries = vectors.where(F.col("vec_id") % every == 0)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    n, n_ids, n_queries, longest = vectors.agg(F.count("*"), F.count_distinct("vec_id"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(norm)).first()
    if not n_queries or n_ids < 2:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest *= 1 + 1e-9
    drawn = lambda share: F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < max(1, round(min(1.0, share) * (1 << 30)))
    sample = matrix(vectors.where(drawn(SAMPLE / n)).orderBy("vec_id", "embedding").select("embedding").toArrow().column(0))
    if not len(sample):
        sample = matrix(vectors.orderBy("vec_id", "embedding").limit(SAMPLE).select("embedding").toArrow().column(0))
    projection, shards = learn(lifted(sample, longest)), max(LEAST_SHARDS, -(-n // VECTORS_PER_SHARD))
    width = substring_bits(n / shards)
    indexes = Indexes(stash(indexed(vectors, shards, longest, projection, width), "indexes"), shards, longest, projection, width)
    audit = stash(queries.orderBy(F.xxhash64(F.lit(5), "vec_id"), "embedding").limit(AUDIT), "audit")
    true = ranked(search(indexes, audit, None, k), k).select("distance").toArrow().column(0).to_numpy()  # AUDIT * k rows
    radius = int(np.sort(true)[min(len(true) - 1, int(np.ceil(target * len(true))) - 1)])
    return widened(indexes, queries, radius, k, min(k, n_ids - 1)).select("query_id", "rank", "vec_id", "score")
