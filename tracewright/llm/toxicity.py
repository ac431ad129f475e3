"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters, hashed. Each feature's value is the
log ratio of its smoothed document rates among toxic and other labelled texts; logistic regression weighs the
scaled features. Features whose rates do not differ beyond chance are left out, so that long clean texts do not
gather noise. Training takes a bounded sample of labelled rows, drawn by a hash of the row's id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracewright.scratch import fresh, stash

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
MAX_TRAINING_ROWS = 20_000
LEAST_Z = 5.0
SMOOTHING = 4.0
RIDGE = 2.0
HITS_AT_ONCE = 1 << 20
TEXTS_AT_ONCE = 256
THRESHOLD = 0.3


def gram_buckets(text: str) -> np.ndarray:
    """The bucket of every n-gram of a text, repeats included. A text shorter than an n-gram has none of that size."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.concatenate([_hashed(points, n) for n in SIZES])


def _hashed(points: np.ndarray, n: int) -> np.ndarray:
    if len(points) < n:
        return np.zeros(0, np.uint32)
    size = len(points) - n + 1
    mix = np.full(size, n, np.uint64)
    for i in range(n):
        mix *= np.uint64(0x9E3779B97F4A7C15)
        mix += points[i : i + size]
    mix *= np.uint64(0xD6E8FEB86659FD93)
    return (mix >> np.uint64(44)).astype(np.uint32)


assert BUCKETS == 1 << 64 - 44


@dataclass
class Model:
    place: np.ndarray  # feature number of each bucket, -1 for none
    weights: np.ndarray  # of each feature, its ratio included
    bias: float


def _found(texts: list[str | None], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each text."""
    each = [np.zeros(0, place.dtype)]
    for text in texts:
        numbers = place[gram_buckets(text or "")]
        each.append(np.unique(numbers[numbers >= 0]))
    return np.repeat(np.arange(-1, len(texts)), [len(e) for e in each]), np.concatenate(each).astype(np.int64)


def _few(column: pa.Array) -> Iterator[list[str | None]]:
    """A column's texts, TEXTS_AT_ONCE at a time: the features of a whole batch would be many times its size."""
    for start in range(0, len(column), TEXTS_AT_ONCE):
        yield column.slice(start, TEXTS_AT_ONCE).to_pylist()


def probabilities(texts: list[str | None], model: Model) -> np.ndarray:
    """Of label 1; empty texts get the bias alone."""
    rows, features = _found(texts, model.place)
    margin = model.bias + np.bincount(rows, model.weights[features], len(texts)) if len(rows) else np.full(len(texts), model.bias)
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _document_counts(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, other): how many texts of either label hold an n-gram of the bucket."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, order = np.zeros((2, BUCKETS), np.int32), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets = gram_buckets(text or "")
                seen[buckets] = stamps = np.arange(order, order + len(buckets))
                counts[toxic, buckets[seen[buckets] == stamps]] += 1
                order += len(buckets)
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[1, some].astype(np.int64)), pa.array(counts[0, some].astype(np.int64))], ["bucket", "toxic", "other"])

    counted = sample.select("text", "toxic").mapInArrow(per_partition, "bucket long, toxic long, other long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _choose(counts: pa.Table, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, ratios): the features whose rates differ beyond chance, and their log-count ratios.

    The difference is taken in units of its standard error, whose largest value is the root of the number of rows; with
    few rows half of that is asked for.
    """
    bucket, toxic, other = (counts.column(c).to_numpy() for c in ("bucket", "toxic", "other"))
    pooled = (toxic + other) / max(n_toxic + n_other, 1)
    spread = np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / max(n_toxic, 1) + 1 / max(n_other, 1)), 1e-12))
    z = np.abs(toxic / max(n_toxic, 1) - other / max(n_other, 1)) / spread
    ratio = np.log((toxic + SMOOTHING * n_toxic / max(n_other, 1)) / max(n_toxic, 1)) - np.log((other + SMOOTHING) / max(n_other, 1)) if n_toxic and n_other else np.zeros(len(bucket))
    order = np.lexsort((bucket, -z))
    order = order[z[order] >= min(LEAST_Z, np.sqrt(n_toxic + n_other) / 2)]
    place = np.full(BUCKETS, -1, np.int32)
    place[bucket[order]] = np.arange(len(order))
    return place, ratio[order]


def _fit(starts: np.ndarray, features: np.ndarray, labels: np.ndarray, ratios: np.ndarray, ridge: float = RIDGE, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presences by accelerated gradient steps; (weights with ratios, bias).

    Row i has the features from starts[i] up to starts[i + 1]. Rows are taken in blocks, so that beside the features
    themselves only a block's worth of numbers is held.
    """
    n, k = len(labels), len(ratios)
    if not n:
        return np.zeros(k), -2.0
    base = (labels.sum() + 1) / (n + 2)
    weights, bias = np.zeros(k), float(np.log(base / (1 - base)))
    if not len(features):
        return weights, bias
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], HITS_AT_ONCE), side="left").clip(0, n), [0, n]))

    def sums(w: np.ndarray) -> np.ndarray:
        scaled, out = w * ratios, np.zeros(n)
        for a, b in zip(cuts[:-1], cuts[1:]):
            of_row = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
            out[a:b] = np.bincount(of_row, scaled[features[starts[a] : starts[b]]], b - a)
        return out

    def back(error: np.ndarray) -> np.ndarray:
        out = np.zeros(k)
        for a, b in zip(cuts[:-1], cuts[1:]):
            out += np.bincount(features[starts[a] : starts[b]], np.repeat(error[a:b], np.diff(starts[a : b + 1])), k)
        return out * ratios

    # A bound of the largest eigenvalue of X'X, by a few power steps.
    v = np.ones(k) / np.sqrt(max(k, 1))
    for _ in range(12):
        v = back(sums(v))
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    rate = 1 / (0.25 * (1.2 * norm + n) + ridge)
    ahead_w, ahead_b, t = weights.copy(), bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(ahead_b + sums(ahead_w), -40, 40))) - labels
        new_w = ahead_w - rate * (back(error) + ridge * ahead_w)
        new_b = ahead_b - rate * error.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / after * (new_w - weights), new_b + (t - 1) / after * (new_b - bias)
        weights, bias, t = new_w, float(new_b), after
    return weights * ratios, bias


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, features) of a column of 32-bit feature lists; the numbers are copied once, chunk by chunk."""
    sizes = np.concatenate([np.zeros(1, np.int64), *[pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) // 4 for c in column.chunks]])
    starts = np.cumsum(sizes)
    features, at = np.empty(starts[-1], np.int32), 0
    for chunk in column.chunks:
        for value in chunk:
            own = np.frombuffer(value.as_buffer(), np.int32)
            features[at : at + len(own)] = own
            at += len(own)
    return starts, features


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on at most about `most` labelled rows of `docs` (doc_id, text) whose doc_id meets `usable`.

    `labels` (doc_id, toxic): rows with null doc_id or label teach nothing; a doc_id with several labels is toxic if
    any says so. Without labelled rows the model scores every text alike.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    share = min(1.0, most / max(known.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < round(share * (1 << 30))
    taken = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & usable & drawn).join(known.where(drawn), "doc_id").select("text", "toxic")
    sample = stash(taken.repartition(max(4, min(64, -(-min(most, 10_000_000) // 5000)))), "sample")
    n_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    place, ratios = _choose(_document_counts(sample).toArrow(), n_toxic, n - n_toxic)
    shared = docs.sparkSession.sparkContext.broadcast(place)  # BUCKETS numbers, whatever the input

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for texts in _few(batch.column(0)):
                rows, features = _found(texts, shared.value)
                each += [e.tobytes() for e in np.split(features.astype(np.int32), np.searchsorted(rows, np.arange(1, len(texts))))]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.binary()), batch.column(1)], ["features", "toxic"])

    held = sample.select("text", "toxic").mapInArrow(per_batch, "features binary, toxic int").orderBy("toxic", "features").toArrow()
    starts, features = _joined(held.column("features"))
    toxic = held.column("toxic").to_numpy().astype(float)
    del held
    weights, bias = _fit(starts, features, toxic, ratios)
    return Model(place, weights, bias)


def scored(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """`columns` of `docs` and `name`, a number from 0 to 1 for each whole text. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS numbers
    kept = docs.select(*columns, F.col("text").alias(fresh(docs, "scored")[0]))
    schema = StructType([*docs.select(*columns).schema.fields, StructField(name, DoubleType())])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(probabilities(texts, shared.value) for texts in _few(batch.column(batch.num_columns - 1)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*columns, name])

    return kept.mapInArrow(per_batch, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`; repeated rows score alike, a null doc_id is not held out."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
