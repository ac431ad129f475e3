"""URL filters by a Bloom filter cascade.

Each url names a few keys: a host suffix and a path prefix, in the lengths that the rules have. All keys of all
urls are the universe. Level 0 of a cascade is a Bloom filter of the listed keys, level 1 one of the universe's keys
that level 0 takes for listed, level 2 one of the listed keys that level 1 holds, and so on until a level errs on
nothing. For every key of the universe the first level that lacks it then tells whether it is listed, without error
and without a join of the urls with the list. Levels are bitmaps of bounded size that are broadcast; a long list is
dealt into parts by a hash of the key, each with a cascade of its own.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.scratch import stash

#: Bits of all levels of one part of the keys; more keys make more parts, each with a cascade of its own.
PART_BITS = 1 << 26


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        """Labels of the host, characters of the path."""
        return self.host.count(".") + 1, len(self.path)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host from after the first :// up to /, ?, # or the end, path from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def slot_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The url's key of each shape, null where its host has too few labels or its path is too short."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    keys = []
    for labels, size in shapes:
        fits = (dots >= labels - 1) & (F.length(path) >= size)
        keys.append(F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size))))
    return F.array(*keys)


def key_hashes(key: Column) -> Column:
    """Two independent hashes of a key, from which all levels draw their positions; null for a null key."""
    return F.when(key.isNotNull(), F.array(F.xxhash64(F.lit(0), key), F.xxhash64(F.lit(1), key)))


def _mixed(values: np.ndarray, number: int) -> np.ndarray:
    """Other numbers for each level, so that keys that collide in one do not in the next."""
    out = values + np.uint64((0x9E3779B97F4A7C15 * (number + 1)) & (1 << 64) - 1)
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


def positions(hashes: np.ndarray, number: int, bits: int, count: int) -> np.ndarray:
    """The bits of a level that each key (a row of two hashes) sets."""
    first, second = (_mixed(hashes[:, i].view(np.uint64), number) % np.uint64(bits) for i in (0, 1))
    return ((first[:, None] + second[:, None] * np.arange(count, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def holds(level: Level, number: int, hashes: np.ndarray) -> np.ndarray:
    at = positions(hashes, number, level.bits, level.hashes)
    return ((level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def member(levels: list[Level], hashes: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the number of the first level without it is odd."""
    out = np.full(len(hashes), len(levels) % 2 == 1)
    left = np.arange(len(hashes))
    for number, level in enumerate(levels):
        inside = holds(level, number, hashes[left])
        out[left[~inside]] = number % 2 == 1
        left = left[inside]
    return out


def _pairs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, 2)


def _filter_of(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A Bloom filter of `n` keys (hashes) with the given rate of false positives; executors set the bits word by word."""
    hashes = max(1, math.ceil(-math.log2(rate)))
    bits = 64 * math.ceil(max(n * hashes / math.log(2), 64) / 64)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(_pairs(batch.column(0)), number, bits, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            held = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(held.view(np.int64))], ["word", "bits"])

    set_ = keys.select("hashes").mapInArrow(per_batch, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most the level's words
    words = np.zeros(bits // 64, np.uint64)
    words[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def _held_by(keys: DataFrame, level: Level, number: int) -> DataFrame:
    known = keys.sparkSession.sparkContext.broadcast(level)  # at most PART_BITS and a few

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(known.value, number, _pairs(batch.column(0)))))

    return keys.select("hashes").mapInArrow(per_batch, "hashes array<long>")


def _first_rate(n_in: int, n_out: int) -> float:
    """The rate at which level 0 errs on about as many keys as it holds."""
    return max(min(0.5, n_in / math.sqrt(2) / max(n_out, 1)) if n_in else 0.5, 1e-9)


def _bits(n_in: int, n_out: int) -> int:
    """About what all levels together take: the first one, and a few bits a key for those after it."""
    return math.ceil(n_in * (math.ceil(-math.log2(_first_rate(n_in, n_out))) + 4) / math.log(2))


def build_cascade(inside: DataFrame, outside: DataFrame) -> list[Level]:
    """Levels over the distinct keys (hashes) of two disjoint tables such that `member` is exact for every one of them.

    Each level errs on at most about half of the keys that the one before erred on, so their number grows with the
    logarithm of the keys; two keys with equal pairs of 64-bit hashes would never part, and are refused.
    """
    levels: list[Level] = []
    n_in, n_out = inside.count(), outside.count()
    encoded, other, n, rate = inside, outside, n_in, _first_rate(n_in, n_out)
    most = 16 + 4 * (n_in + n_out + 1).bit_length()
    while n:
        if len(levels) == most:
            raise RuntimeError("two keys have the same 128-bit hash")
        number = len(levels)
        levels.append(_filter_of(encoded, n, number, rate))
        mistaken = stash(_held_by(other, levels[-1], number), "mistaken")
        encoded, other, n, rate = mistaken, encoded, mistaken.count(), 0.5
    return levels


def marked(keyed: DataFrame, listed: DataFrame, universe: DataFrame, part_bits: int) -> DataFrame:
    """`keyed` with its column `marks` (one number per key) set to each listed key's number.

    `listed` (key, mark) and `universe` (key) are distinct keys. A cascade for each mark and part of the keys, by a hash
    of the key, marks the rows; a part's levels fit `part_bits`, so what is broadcast at once is bounded however long
    the list is, and longer lists take more passes over the urls.
    """
    hashed = stash(universe.join(listed, "key", "left").select(key_hashes(F.col("key")).alias("hashes"), "mark"), "hashed")
    counts = {r.mark: r.n for r in hashed.groupBy("mark").agg(F.count("*").alias("n")).collect()}  # a row per verdict
    total = sum(counts.values())
    for mark in sorted(m for m in counts if m is not None):
        parts = max(1, -(-_bits(counts[mark], total - counts[mark]) // part_bits))
        for part in range(parts):
            mine = hashed.where(F.pmod(F.col("hashes")[0], F.lit(parts)) == part) if parts > 1 else hashed
            inside, outside = (stash(mine.where(is_in).select("hashes"), "keys") for is_in in (F.coalesce(F.col("mark") == mark, F.lit(False)), ~F.coalesce(F.col("mark") == mark, F.lit(False))))
            keyed = stash(_marked_by(keyed, build_cascade(inside, outside), mark, parts, part), "marked") if parts > 1 else _marked_by(keyed, build_cascade(inside, outside), mark, 1, 0)
    return keyed


def _marked_by(keyed: DataFrame, levels: list[Level], mark: int, parts: int, part: int) -> DataFrame:
    known = keyed.sparkSession.sparkContext.broadcast(levels)  # at most about PART_BITS

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, marks = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            flat = slots.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            hashes = _pairs(flat.drop_null())
            out = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            at = np.flatnonzero(there)
            mine = hashes[:, 0] % parts == part
            at = at[mine]
            out[at[member(known.value, hashes[mine])]] = mark
            sizes = np.append(0, np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(out, pa.int32()))], batch.schema.names)

    return keyed.mapInArrow(per_batch, keyed.schema)


def judged(pages: DataFrame, rules: list[Rule], default: str = "allow", part_bits: int = PART_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of `pages` (page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides, of
    equally long ones that with more labels. Where none fits no key of the url is in a cascade and the verdict is
    `default`. A null url, or one without ://, has empty host and path. Null page_ids and repeated rows are kept. With
    no rules every verdict is the default; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    shapes = sorted({r.shape for r in rules}, key=lambda s: (s[0] + s[1], s))
    parts = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parts.select("page_id", "host", "path", slot_keys(F.col("host"), F.col("path"), shapes).alias("keys"))
    verdicts = sorted({r.verdict for r in rules})
    universe = keyed.select(F.explode("keys").alias("key")).where("key is not null").distinct()
    listed = spark.createDataFrame([(r.key, verdicts.index(r.verdict)) for r in {r.key: r for r in rules}.values()], "key string, mark int")
    slots = keyed.select("page_id", "host", "path", "keys", F.transform("keys", key_hashes).alias("hashes"), F.transform("keys", lambda k: F.lit(-1)).alias("marks"))
    found, labels = marked(slots, listed, stash(universe, "universe"), part_bits), F.lit([n for n, _ in shapes])
    # Of the keys with a mark the longest, of equally long ones that with more labels.
    each = F.zip_with("keys", "marks", lambda k, m: F.when(m >= 0, F.struct(F.length(k).alias("size"), k.alias("rule"), m.alias("mark"))))
    ordered = F.transform(each, lambda e, i: F.when(e.isNotNull(), F.struct(e["size"].alias("size"), F.get(labels, i).alias("labels"), e["rule"].alias("rule"), e["mark"].alias("mark"))))
    best = found.withColumn("best", F.array_max(F.array_compact(ordered)))
    verdict = F.coalesce(F.get(F.lit(verdicts), F.col("best.mark")), F.lit(default))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
