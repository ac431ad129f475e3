"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every WINDOW - GRAM + 1 consecutive word GRAM-grams the one with the smallest hash is
kept, so that two documents which share WINDOW consecutive words keep the same anchor within them. Documents are
joined on their anchors: every occurrence meets its anchor's leader, the first occurrence in the smallest document,
so that a passage which very many documents share costs a row for each of them, not one for each pair. From the
anchor the match with the leader is extended word by word both ways, as far as the windows reach whose smallest gram
the anchor is (equal windows have the same), and a maximal match of WINDOW words or more is repeated. Where a match ends before that, another document may share
more than the leader does: the windows beyond the maximal match meet those of the other occurrences of the anchor by
a 128-bit hash, reduced to their smallest document. What is cut is the union of all repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.scratch import discard, stash

WINDOW = 50
GRAM = 10
NO_ID = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_LARGEST = np.uint64((1 << 64) - 1)
_NONE = np.zeros(0, np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, span: int, which: int = 0) -> np.ndarray:
    """A hash of each run of `span` words, by differences of running sums."""
    if len(words) < span:
        return np.zeros(0, np.uint64)
    powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(words) - 1, _BASES[which]))))
    sums = np.concatenate(([np.uint64(0)], np.add.accumulate(words * powers)))
    undo = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(words) - span, _INVERSES[which]))))
    out = (sums[span:] - sums[:-span]) * undo
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ out >> np.uint64(29)


def _sliding(values: np.ndarray, span: int, pick: np.ufunc) -> np.ndarray:
    size = 1
    while size * 2 <= span:
        values, size = pick(values[:-size], values[size:]), size * 2
    return pick(values[: len(values) - (span - size)], values[span - size :]) if span > size else values


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are smallest in some window; all of them where several tie."""
    grams = run_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(grams, span, np.minimum)
    around = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    chosen = np.flatnonzero(grams == _sliding(around, span, np.maximum))
    return chosen, grams[chosen]


def covered(first: np.ndarray, until: np.ndarray, n: int) -> np.ndarray:
    """Which of `n` words lie in one of the runs from `first` up to `until`."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, until, -1)
    return np.cumsum(edges[:-1]) > 0


def _identified(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` and text with `ord`, the doc_id or the largest number for none, and `digest`; both tell a row from all that differ."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("_text"))


def _surveyed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, shas, hashes, places = [], [], [], []
            for text in batch.column(3):
                words = words_of(text.as_py())
                at, values = anchors(word_hashes(words), window, gram)
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                hashes.append(values.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(shas), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "ord", "digest", "n_words", "full_sha256", "anchors", "places"])

    return _identified(docs, "doc_id").mapInArrow(per_batch, "doc_id long, ord long, digest binary, n_words long, full_sha256 string, anchors array<long>, places array<int>")


def owned(grams: np.ndarray, places: np.ndarray, span: int, n_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the windows of `span` grams whose leftmost smallest gram stands at each of `places`; first > last for none.

    Equal windows have it at the same place within them, so that each window need be looked at from that anchor alone.
    """
    padded = np.concatenate((np.full(span - 1, _LARGEST), grams, np.full(span - 1, _LARGEST)))
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * span - 1)[places]
    own, steps = grams[places][:, None], np.arange(1, span)
    held = (around[:, : span - 1][:, ::-1] <= own) & (steps <= places[:, None])
    smaller = around[:, span:] < own
    before = np.where(held.any(axis=1), held.argmax(axis=1), span - 1)  # grams before it that may be in the window
    after = np.where(smaller.any(axis=1), smaller.argmax(axis=1), span - 1)
    return np.maximum(places - before, 0), np.minimum(np.minimum(places, places + after - span + 1), n_windows - 1)


def _occurrences(seeded: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, ord, digest, back, words, places): the hashed words of all windows that an anchor stands for, `back` of
    them before it, and the places where a document has these words around the anchor."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ord_, digest, text, anchors_, places in zip(*batch.columns):  # one row's values at a time become Python's
                ord_, digest, anchors_, places = ord_.as_py(), digest.as_py(), anchors_.as_py(), places.as_py()
                hashes, at = word_hashes(words_of(text.as_py())), np.array(places, np.int64)
                first, last = owned(run_hashes(hashes, gram), at, window - gram + 1, len(hashes) - window + 1)
                rows: dict[tuple, list[int]] = {}
                for anchor, place, low, high in zip(anchors_, places, first.tolist(), last.tolist()):
                    if low <= high:
                        rows.setdefault((anchor, place - low, hashes[low : high + window].tobytes()), []).append(place)
                if rows:
                    anchor, back, words = zip(*rows)
                    n = len(rows)
                    columns = [pa.array(anchor, pa.int64()), pa.array(np.full(n, ord_, np.int64)), pa.array([digest] * n, pa.binary()), pa.array(back, pa.int32()), pa.array(words, pa.binary()), pa.array(list(rows.values()), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "ord", "digest", "back", "words", "places"])

    return seeded.select("ord", "digest", "_text", "anchors", "places").mapInArrow(per_batch, "anchor long, ord long, digest binary, back int, words binary, places array<int>")


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two runs share from their start on."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def _extended(met: DataFrame, window: int) -> DataFrame:
    """(ord, digest, places, first, until, h1, h2, starts), all relative to the anchor's places: the maximal match with the
    leader, null where it is shorter than a window or of the leader's own document; and the windows beyond it."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, until, hashes, starts = [], [], ([], []), []
            for ord_, back, words, lead_ord, lead_back, lead_words in zip(*(batch.column(i).to_pylist() for i in (0, 3)), batch.column(4), *(batch.column(i).to_pylist() for i in (5, 6)), batch.column(7)):
                own, lead = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(lead_words.as_buffer(), np.uint64)
                left, right = agreeing(own[:back][::-1], lead[:lead_back][::-1]), agreeing(own[back:], lead[lead_back:])
                whole = left + right >= window
                tells = whole and ord_ > lead_ord
                first.append(-left if tells else None)
                until.append(right if tells else None)
                beyond = np.ones(len(own) - window + 1, bool)
                if whole:  # windows within the match are settled
                    beyond[back - left : back + right - window + 1] = False
                at = np.flatnonzero(beyond)
                for which in (0, 1):
                    hashes[which].append(run_hashes(own, window, which)[at].view(np.int64) if len(at) else _NONE)
                starts.append((at - back).astype(np.int32))
            listed = [pa.array(h, pa.list_(pa.int64())) for h in hashes]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first, pa.int32()), pa.array(until, pa.int32()), *listed, pa.array(starts, pa.list_(pa.int32()))], ["ord", "digest", "places", "first", "until", "h1", "h2", "starts"])

    columns = ("ord", "digest", "places", "back", "words", "lead_ord", "lead_back", "lead_words")
    return met.select(*columns).mapInArrow(per_batch, "ord long, digest binary, places array<int>, first int, until int, h1 array<long>, h2 array<long>, starts array<int>")


def _cut(affected: DataFrame, with_text: bool) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, first, until in zip(*(batch.column(i) for i in (2, 3, 4))):
                words = words_of(text.as_py())
                gone = covered(np.array(first.as_py(), np.int64), np.array(until.as_py(), np.int64), len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts, pa.string())], ["ord", "digest", "cut", "cut_sha256", "cut_text"])

    return affected.select("ord", "digest", "_text", "first", "until").mapInArrow(per_batch, "ord long, digest binary, cut long, cut_sha256 string, cut_text string")


def _found(docs: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """(doc_id, ord, digest, n_words, n_removed, kept_sha256, kept_text) per row; kept_text is null unless asked for and something is cut."""
    survey = stash(_surveyed(docs, window, gram), "survey")
    # A copy of a text with a smaller doc_id holds nothing new: it is cut whole, and its anchors are not needed.
    first = survey.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("ord").alias("first_ord"))
    copies = stash(survey.where(F.col("n_words") >= window).select("ord", "digest").join(first, "digest").where("ord > first_ord").select("ord", "digest").distinct(), "copies")
    grams = survey.where(F.size("anchors") > 0).join(copies, ["ord", "digest"], "left_anti").select("ord", "digest", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("ord", "digest", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    # Written out, so that in the join below both sides are plain exchanges, which Spark splits where a key is hot.
    shared = stash(grams.groupBy("anchor").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high").select("anchor"), "shared")
    seeds = grams.join(shared, "anchor").groupBy("ord", "digest").agg(F.collect_set(F.struct("anchor", "place")).alias("seeds"))
    seeded = _identified(docs).join(seeds, ["ord", "digest"]).select("ord", "digest", "_text", F.col("seeds.anchor").alias("anchors"), F.col("seeds.place").alias("places"))
    occurring = stash(_occurrences(seeded, window, gram), "occurrences")
    leader = F.min(F.struct("ord", "digest", "back", "words")).alias("lead")
    leaders = stash(occurring.groupBy("anchor").agg(leader).select("anchor", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("ord", "digest", "back", "words")]), "leaders")
    met = occurring.join(leaders, "anchor").where("ord != lead_ord or digest != lead_digest or back != lead_back or words != lead_words")
    extended = stash(_extended(met, window), "extended")
    discard(occurring)
    discard(leaders)
    repeated = extended.where("first is not null").select("ord", "digest", F.explode("places").alias("place"), "first", "until")
    beyond = extended.where(F.size("starts") > 0).select("ord", "digest", "places", F.explode(F.arrays_zip("h1", "h2", "starts")).alias("w"))
    beyond = beyond.select("ord", "digest", "places", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), F.col("w.starts").alias("start"))
    earliest = stash(beyond.groupBy("h1", "h2").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high").select("h1", "h2", "low"), "earliest")
    others = beyond.join(earliest, ["h1", "h2"]).where("ord > low").select("ord", "digest", F.explode("places").alias("place"), F.col("start").alias("first"), (F.col("start") + window).alias("until"))
    runs = repeated.unionByName(others).groupBy("ord", "digest").agg(F.collect_set(F.struct((F.col("place") + F.col("first")).alias("first"), (F.col("place") + F.col("until")).alias("until"))).alias("runs"))
    affected = _identified(docs).join(runs, ["ord", "digest"]).select("ord", "digest", "_text", F.col("runs.first").alias("first"), F.col("runs.until").alias("until"))
    cut = _cut(affected, with_text).dropDuplicates(["ord", "digest"])
    told = survey.select("doc_id", "ord", "digest", "n_words", "full_sha256")
    joined = told.join(cut, ["ord", "digest"], "left").join(copies.withColumn("copy", F.lit(True)), ["ord", "digest"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return joined.select(
        "doc_id",
        "ord",
        "digest",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha256", "full_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"),
    )


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of `docs` (doc_id, text).

    A word goes if it lies in `window` consecutive words that also occur in a row with a smaller doc_id, as the input
    stands. Null and empty texts have no words. A null doc_id counts as larger than any other; rows with the same
    doc_id cut nothing from each other, and repeated rows are cut alike. An empty table gives an empty table.
    """
    return _found(docs, window, gram, False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` with repeated words cut, the kept ones joined by one space; untouched texts stay as they are and rows of which nothing is left go."""
    found = _found(docs, window, gram, True).where("n_removed > 0").select("ord", "digest", "kept_text").dropDuplicates(["ord", "digest"])
    whole = _identified(docs, F.struct(*docs.columns).alias("_row")).drop("_text").join(found, ["ord", "digest"], "left")
    kept = whole.where(F.coalesce(F.col("kept_text") != "", F.lit(True)))
    changed = F.col("kept_text").isNotNull()
    columns = []
    for c in docs.columns:
        new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}.get(c)
        columns.append((F.col(f"_row.`{c}`") if new is None else F.when(changed, new).otherwise(F.col(f"_row.`{c}`"))).alias(c))
    return kept.select(*columns)
