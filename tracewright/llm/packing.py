"""Lexical retrieval packing into windows of fixed length.

Texts become token ids, closed by id 0. Terms of the BM25 index are the ids themselves, so that document
frequencies, counted over all documents, are one bounded array. Documents are dealt into shards by a lexical key
computed with these frequencies: their strongest terms, so that documents which share what tells them from others
meet in one shard wherever they stand in the table. A term that very many documents hold is salted. Each shard has
an inverted index of its own, bounded in tokens and in rows. A window starts with a seed document; the seed's
strongest terms fetch its unused neighbours in the shard, which fill the window in the order of their scores. A
document that does not fit is cut, and its rest is the next seed. What is left at the end of a partition is cut into
windows of powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.scratch import stash

WINDOW = 1024
CLOSING_ID = 0
SHARD_TOKENS = 2_000_000
SHARD_ROWS = 8192
QUERY_TERMS = 12
NEIGHBOURS = 24
K1, B = 1.2, 0.75
TOKENIZER = "byte_bpe_50k.json"
#: Tokenizers whose ranks a second library reads; it gives the same ids several times faster on plain texts.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
LONG_TEXT = 50_000
MEETING = 16
BLOCK_BYTES = 1 << 21


@cache
def tokenizer(name: str = TOKENIZER):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def vocabulary(name: str = TOKENIZER) -> int:
    return tokenizer(name).get_vocab_size(with_added_tokens=True)


def id_type(name: str = TOKENIZER) -> str:
    return "<u2" if vocabulary(name) <= 1 << 16 else "<u4"


@cache
def settled_characters() -> str:
    """A character class: what the oldest Unicode tables at hand and today's put into the same category, below U+10000.

    Two libraries that carry tables of different years split texts of these characters alike.
    """
    old, out, start = unicodedata.ucd_3_2_0, [], None
    for c in range(0x10001):
        same = c < 0x10000 and (kind := old.category(chr(c))) != "Cn" and kind[0] not in "C" and kind == unicodedata.category(chr(c)) or c in (9, 10, 11, 12, 13)
        if same and start is None:
            start = c
        elif not same and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


@cache
def encoder(name: str = TOKENIZER) -> Callable[[str], list[int]]:
    """Text to the ids that `tokenizers` gives, without special tokens added.

    Where the vocabulary's ranks are at hand, `tiktoken` encodes the texts on which the two cannot differ: no string
    of a special token in them, settled characters only, no very long run without a break (on which it may fail).
    """
    import public_tokenizers

    exact = tokenizer(name)
    if name not in RANKS:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(public_tokenizers.path(RANKS[name]), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = re.compile("|".join(re.escape(t.content) for t in exact.get_added_tokens_decoder().values()) or r"(?!)")
    unsettled = re.compile(f"[^{settled_characters()}]")
    unbroken = re.compile(r"\s{2000}|\S{2000}")

    def encode(text: str) -> list[int]:
        if special.search(text) or not text.isascii() and unsettled.search(text) or len(text) > LONG_TEXT and unbroken.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def tokenized(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) per row, ids as little-endian unsigned numbers of `id_type`; a null text has the closing id alone."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(name), id_type(name)
        for batch in batches:
            ids = [np.array([*encode(text or ""), CLOSING_ID], kind).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch, "doc_id long, ids binary")


def document_frequencies(tokens: DataFrame, name: str = TOKENIZER) -> tuple[np.ndarray, int, float]:
    """(documents that hold each id, documents, mean length) over all of `tokens`."""
    size, kind = vocabulary(name), id_type(name)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        order = 0
        for batch in batches:
            for ids in batch.column(0):
                found = np.frombuffer(ids.as_buffer(), kind)
                stamps = np.arange(order + 1, order + 1 + len(found))
                last[found] = stamps  # of equal ids the last one stays
                counts[found[last[found] == stamps]] += 1
                order += len(found)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["id", "n"])

    found = tokens.select("ids").mapInArrow(per_partition, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("id").to_numpy()] = found.column("n").to_numpy()
    n, total = tokens.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()
    return counts, n, total / np.dtype(kind).itemsize / max(n, 1)


def inverse_frequencies(frequencies: np.ndarray, n: int) -> np.ndarray:
    """BM25's weight of each id; the closing id, which all documents hold, weighs nothing."""
    idf = np.log1p((n - frequencies + 0.5) / (frequencies + 0.5)).astype(np.float32)
    idf[CLOSING_ID] = 0
    return idf


def ranks_of_terms(frequencies: np.ndarray) -> np.ndarray:
    """How well a term serves as a meeting point: the rarer the better, those of fewer than MEETING documents after all others, 0 for none.

    A term that one document alone holds, and the closing id, lead nowhere.
    """
    rank = np.zeros(len(frequencies), np.int64)
    useful = np.flatnonzero((frequencies > 1) & (np.arange(len(frequencies)) != CLOSING_ID))
    count = frequencies[useful]
    order = np.lexsort((useful, np.where(count >= MEETING, -count, count), count >= MEETING))
    rank[useful[order]] = np.arange(1, len(useful) + 1)
    return rank


def strongest_terms(ids: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second term by rank of each document; documents stand one after the other and end before `ends`. The closing id for none."""
    by_rank = np.full(rank.max(initial=0) + 1, CLOSING_ID, np.int64)
    by_rank[rank[rank > 0]] = np.flatnonzero(rank > 0)
    starts, found = np.concatenate(([0], ends[:-1])), rank[ids]
    first = np.maximum.reduceat(found, starts)
    found[found == np.repeat(first, ends - starts)] = 0
    return by_rank[first], by_rank[np.maximum.reduceat(found, starts)]


def in_blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose values in a binary column have about `most` bytes together, one row at least."""
    block = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        if start < end:
            yield batch.slice(start, end - start)


def keyed(tokens: DataFrame, frequencies: np.ndarray, mean: float, shard_tokens: int, shard_rows: int, name: str) -> DataFrame:
    """`tokens` with term, next_term and salt. A term has as many salts as the documents that hold it could fill shards."""
    kind = id_type(name)
    salts = np.maximum(1, np.ceil(frequencies * max(mean / shard_tokens, 1 / shard_rows))).astype(np.int64)
    known = tokens.sparkSession.sparkContext.broadcast((ranks_of_terms(frequencies), salts))  # as long as the vocabulary

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, many = known.value
        for batch in batches:
            for part in in_blocks(batch, 1):  # the numbers of a whole batch would be many times its size
                each = [np.frombuffer(ids.as_buffer(), kind) for ids in part.column(1)]
                first, second = strongest_terms(np.concatenate(each), np.cumsum([len(e) for e in each]), rank)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first), pa.array(second), pa.array(many[first])], ["doc_id", "ids", "term", "next_term", "salts"])

    found = tokens.mapInArrow(per_batch, "doc_id long, ids binary, term long, next_term long, salts long")
    # A salt goes by the second term where there is one, so that near copies stay close, and by the row where there is none.
    row = F.xxhash64("doc_id", "ids")
    finer = F.when(F.col("next_term") != CLOSING_ID, F.xxhash64("next_term", F.pmod(row, F.lit(4)))).otherwise(row)
    return found.withColumn("salt", F.pmod(finer, F.col("salts"))).drop("salts")


class Index:
    """BM25 postings of one shard's unused documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        pairs = [np.unique(d, return_counts=True) for d in docs]
        terms = np.concatenate([t for t, _ in pairs])
        tf = np.concatenate([c for _, c in pairs]).astype(np.float32)
        sizes = np.array([len(t) for t, _ in pairs])
        norm = np.repeat(np.array([K1 * (1 - B + B * len(d) / max(mean, 1)) for d in docs], np.float32), sizes)
        weight = idf[terms] * tf * np.float32(K1 + 1) / (tf + norm)
        self.cuts = np.concatenate(([0], np.cumsum(sizes)))
        self.terms, self.weight = terms, weight
        self.size = len(idf)
        self.unused = np.ones(len(docs), bool)
        self.scores = np.zeros(len(docs), np.float32)
        order = np.argsort(terms, kind="stable")
        self._post(np.repeat(np.arange(len(docs), dtype=np.int32), sizes)[order], weight[order], terms[order])

    def _post(self, docs: np.ndarray, weights: np.ndarray, terms: np.ndarray) -> None:
        self.posted, self.posted_weight, self.posted_terms = docs, weights, terms
        self.starts = np.searchsorted(terms, np.arange(self.size + 1))
        self.left, self.used = max(int(self.unused.sum()), 1), 0

    def use(self, doc: int) -> None:
        """Take a document out; once half of the posted ones are out, their postings go."""
        self.unused[doc] = False
        self.used += 1
        if 2 * self.used > self.left > 64:
            kept = self.unused[self.posted]
            self._post(self.posted[kept], self.posted_weight[kept], self.posted_terms[kept])

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents that share the seed's strongest terms, best first, ties in shard order."""
        a, b = self.cuts[seed], self.cuts[seed + 1]
        weight, terms = self.weight[a:b], self.terms[a:b]
        strong = np.argpartition(-weight, QUERY_TERMS)[:QUERY_TERMS] if b - a > QUERY_TERMS else np.arange(b - a)
        strong = strong[weight[strong] > 0]
        if not len(strong):
            return []
        self.scores[:] = 0
        for t in terms[strong].tolist():
            at = slice(self.starts[t], self.starts[t + 1])
            self.scores[self.posted[at]] += self.posted_weight[at]
        self.scores[~self.unused] = 0
        best = np.argpartition(-self.scores, NEIGHBOURS)[:NEIGHBOURS] if len(self.scores) > NEIGHBOURS else np.arange(len(self.scores))
        best = best[self.scores[best] > 0]
        return best[np.lexsort((best, -self.scores[best]))].tolist()


class Packer:
    """Fills windows in turn; a piece is (doc_id, doc_tokens, start, length, sequence, offset, ids)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.filled = window, first_sequence, 0
        self.pieces: list[tuple] = []
        self.open: list[tuple] = []  # pieces of the window that is not full

    def room(self) -> int:
        return self.window - self.filled

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            length = min(self.room(), len(ids) - start)
            self.open.append((doc_id, len(ids), start, length, ids[start : start + length]))
            self.filled += length
            start += length
            if self.filled == self.window:
                self.close()

    def close(self) -> None:
        offset = 0
        for doc_id, total, start, length, ids in self.open:
            self.pieces.append((doc_id, total, start, length, self.sequence, offset, ids))
            offset += length
        if self.open:
            self.sequence += 1
        self.open, self.filled = [], 0

    def finish(self) -> None:
        """Close what is left as windows of powers of two."""
        rest, left = self.open[::-1], self.filled
        self.open, self.filled = [], 0
        while left:
            size = 1 << left.bit_length() - 1
            left -= size
            while size:
                doc_id, total, start, length, ids = rest.pop()
                took = min(size, length)
                self.open.append((doc_id, total, start, took, ids[:took]))
                size -= took
                if took < length:
                    rest.append((doc_id, total, start + took, length - took, ids[took:]))
            self.close()


def pack_shard(packer: Packer, doc_ids: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
    index, cursor = Index(docs, idf, mean), 0
    while True:
        while cursor < len(docs) and not index.unused[cursor]:
            cursor += 1
        if cursor == len(docs):
            return
        seed = cursor
        index.use(seed)
        packer.put(doc_ids[seed], docs[seed])
        while packer.filled:
            sequence, last = packer.sequence, seed
            found = index.neighbours(seed)
            for other in found:
                index.use(other)
                packer.put(doc_ids[other], docs[other])
                last = other
                if packer.sequence != sequence:
                    break
            if packer.sequence != sequence:
                seed = last  # the document that was cut starts the next window
            elif not found:
                break  # no neighbour is left for this window: the next unused document goes on


def packed(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, name: str = TOKENIZER) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows of `docs` (doc_id, text).

    Every id of every row is in exactly one piece; ids are little-endian unsigned 32-bit numbers. Null and empty
    texts are one closing id. Repeated rows and null doc_ids are packed like others. Sequences are full but for a few
    at the end of each partition, whose lengths are powers of two. An empty table gives an empty table. Within a
    partition rows stand in one order, whatever order they came in, so that a task that runs again does the same.
    """
    tokens = stash(tokenized(docs, name), "tokens")
    frequencies, n, mean = document_frequencies(tokens, name)
    shared = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(frequencies, n))  # as long as the vocabulary
    dealt = keyed(tokens, frequencies, mean, shard_tokens, shard_rows, name).repartition("term", "salt").sortWithinPartitions("term", "salt", "next_term", "doc_id", "ids")
    kind = id_type(name)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        doc_ids, arrays, tokens = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                arrays.append(np.frombuffer(ids, kind))
                tokens += len(arrays[-1])
                if tokens >= shard_tokens or len(arrays) >= shard_rows:
                    pack_shard(packer, doc_ids, arrays, shared.value, mean)
                    yield _rows(packer)
                    doc_ids, arrays, tokens = [], [], 0
        if arrays:
            pack_shard(packer, doc_ids, arrays, shared.value, mean)
        packer.finish()
        yield _rows(packer)

    return dealt.select("doc_id", "ids").mapInArrow(per_partition, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def _rows(packer: Packer) -> pa.RecordBatch:
    pieces, packer.pieces = packer.pieces, []
    doc_id, total, start, length, sequence, offset, ids = zip(*pieces) if pieces else [()] * 7
    whole = [pa.array(c, pa.int64()) for c in (doc_id, start, length, total, sequence, offset)]
    return pa.RecordBatch.from_arrays([*whole, pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
