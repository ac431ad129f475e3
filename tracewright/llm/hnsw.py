"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Equal vectors are one class. Classes are dealt into shards, each with a graph of its own, and every class queries
every shard. Queries walk a graph side by side, each with a beam of the best nodes seen. The beam is widened until an
audit passes: classes drawn by a hash, until LEAST_LINKED of them have links or none is left, are answered by brute
force, and at least TARGET of those with links must have found all of them. Where no beam passes, or all classes were
drawn, every class is answered by brute force. A query whose whole beam is linked has more links than its beam holds; it is answered by an exact
scan of the shard in blocks. Links are verified by cosine in double precision. Graphs are written once; a task loads
its shard's graph and the queries stream past it. Each task hands on a spanning forest of its links, not the links,
and the forests are united into components. A link counts on both sides, whichever side found it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.components import connected_components
from tracewright.llm.vectors import cleaned, matrix, normalized, past_shards
from tracewright.scratch import stash

LEAST_COSINE = 0.95
DEGREE = 12
BUILD_BEAM = 48
BEAMS = (32, 64, 128, 256, 512)
TARGET = 0.995
AUDIT = 1024
LEAST_LINKED = 200
DRAWS = 1 << 30
LEAST_SHARDS = 4
VECTORS_PER_SHARD = 100_000
SIDE_BY_SIDE = 256
VISIT_BYTES = 1 << 25
SLACK = 1e-5
_NONE = -1


class Graph:
    """Layered neighbour lists over unit vectors; node i has layers 0 to level[i]."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 9):
        self.vectors, self.degree = np.ascontiguousarray(vectors, np.float32), degree
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.level = np.minimum(np.floor(-np.log(np.maximum(draws, 1e-12)) / math.log(degree)), 12).astype(np.int64)
        top = int(self.level.max(initial=0))
        self.links = [np.full((n, 2 * degree if layer == 0 else degree), _NONE, np.int32) for layer in range(top + 1)]
        order = np.argsort(-self.level, kind="stable")  # upper layers first, so that each batch finds entries
        self.entry = int(order[0]) if n else _NONE
        done = min(n, 1)
        while done < n:
            batch = order[done : done + min(SIDE_BY_SIDE * 2, max(1, done))]
            self._insert(batch, beam)
            done += len(batch)

    def _insert(self, batch: np.ndarray, beam: int) -> None:
        queries = self.vectors[batch]
        entries = np.full(len(batch), self.entry, np.int32)
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        for layer in range(len(self.links) - 1, -1, -1):
            here = self.level[batch] >= layer
            ids, sims = self.search(queries, entries, layer, beam if here.any() else 1)
            entries = np.where(ids[:, 0] >= 0, ids[:, 0], entries).astype(np.int32)
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            near = np.argsort(-among[np.ix_(rows, rows)], axis=1)[:, : min(beam // 2, len(rows) - 1)]
            mates, mate_sims = batch[rows][near].astype(np.int32), np.take_along_axis(among[np.ix_(rows, rows)], near, axis=1)
            all_ids, all_sims = np.concatenate((ids[rows], mates), axis=1), np.concatenate((sims[rows], mate_sims.astype(np.float32)), axis=1)
            chosen = self._diverse(all_ids, all_sims, self.links[layer].shape[1])
            self.links[layer][batch[rows]] = chosen
            self._link_back(batch[rows], chosen, layer)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, best first, those that are nearer to the row than to any chosen one; then the best of the rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        rows = np.arange(len(ids))
        chosen, count = np.full((len(ids), most), _NONE, np.int32), np.zeros(len(ids), np.int64)
        nearest = np.full(ids.shape, -np.inf, np.float32)  # of each candidate to the chosen ones
        vectors = self.vectors[np.maximum(ids, 0)]
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            good = (ids[:, c] >= 0) & (count < most) & (sims[:, c] > nearest[:, c])
            if good.any():
                at = rows[good]
                chosen[at, count[at]] = ids[at, c]
                count[at] += 1
                taken[at, c] = True
                nearest[at] = np.maximum(nearest[at], np.einsum("rcd,rd->rc", vectors[at], vectors[at, c]))
        for c in range(ids.shape[1]):
            more = (ids[:, c] >= 0) & ~taken[:, c] & (count < most)
            at = rows[more]
            chosen[at, count[at]] = ids[at, c]
            count[at] += 1
        return chosen

    def _link_back(self, sources: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        to, by = chosen.ravel(), np.repeat(sources, chosen.shape[1]).astype(np.int32)
        to, by = to[to >= 0], by[to >= 0]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, first, many = np.unique(to, return_index=True, return_counts=True)
        usual = many <= 4 * self.links[layer].shape[1]
        self._take_in(nodes[usual], first[usual], many[usual], by, layer)
        for hub in np.flatnonzero(~usual).tolist():  # named by very many at once: alone, so that the others need not be as wide
            self._take_in(nodes[hub : hub + 1], first[hub : hub + 1], many[hub : hub + 1], by, layer)

    def _take_in(self, nodes: np.ndarray, first: np.ndarray, many: np.ndarray, by: np.ndarray, layer: int) -> None:
        """Each of `nodes` weighs those who link to it, by[first] to by[first + many], with its own links."""
        if not len(nodes):
            return
        links, width = self.links[layer], int(many.max())
        at = first[:, None] + np.arange(width)
        incoming = np.where(np.arange(width) < many[:, None], by[np.minimum(at, len(by) - 1)], _NONE).astype(np.int32)
        held = links[nodes]
        free = (held < 0).sum(axis=1)
        known = (incoming[:, :, None] == held[:, None, :]).any(axis=2) & (incoming >= 0)
        incoming[known] = _NONE
        needs = (incoming >= 0).sum(axis=1)
        both = np.concatenate((held, incoming), axis=1)
        easy = needs <= free
        packed = np.take_along_axis(both[easy], np.argsort(both[easy] < 0, axis=1, kind="stable"), axis=1)
        links[nodes[easy]] = packed[:, : links.shape[1]]
        hard = np.flatnonzero(~easy)
        if len(hard):
            ids = both[hard]
            sims = np.einsum("rcd,rd->rc", self.vectors[np.maximum(ids, 0)], self.vectors[nodes[hard]])
            links[nodes[hard]] = self._diverse(ids, sims, links.shape[1])

    def search(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of each query's beam in one layer, best first; -1 where fewer nodes were reached."""
        q, links = len(queries), self.links[layer]
        rows = np.arange(q)
        ids, sims = np.full((q, beam), _NONE, np.int32), np.full((q, beam), -np.inf, np.float32)
        fresh = np.zeros((q, beam), bool)
        ids[:, 0], sims[:, 0], fresh[:, 0] = entries, np.einsum("qd,qd->q", self.vectors[entries], queries), True
        seen = np.zeros((q, len(self.vectors)), bool)
        seen[rows, entries] = True
        live = rows
        while len(live):
            open_ = np.where(fresh[live], sims[live], -np.inf)
            at = open_.argmax(axis=1)
            some = fresh[live, at]
            live, at = live[some], at[some]
            if not len(live):
                break
            fresh[live, at] = False
            near = links[ids[live, at]]
            good = near >= 0
            good &= ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(good)
            seen[live[r], near[r, c]] = True
            gained = np.full(near.shape, -np.inf, np.float32)
            gained[r, c] = np.einsum("kd,kd->k", self.vectors[near[r, c]], queries[live[r]])
            better = (gained > sims[live].min(axis=1)[:, None]).any(axis=1)
            if not better.any():
                continue
            move = live[better]
            all_sims = np.concatenate((sims[move], gained[better]), axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[move] = np.take_along_axis(all_sims, keep, axis=1)
            ids[move] = np.where(np.isfinite(sims[move]), np.take_along_axis(np.concatenate((ids[move], near[better]), axis=1), keep, axis=1), _NONE)
            fresh[move] = np.take_along_axis(np.concatenate((fresh[move], np.isfinite(gained[better])), axis=1), keep, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def nearest(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.full(len(queries), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            ids, _ = self.search(queries, entries, layer, 1)
            entries = ids[:, 0]
        return self.search(queries, entries, 0, min(beam, len(self.vectors)))

    def linked(self, queries: np.ndarray, beam: int, least: float) -> list[np.ndarray]:
        """For each unit query the nodes whose similarity is at least `least`, but for what the beam misses."""
        out: list[np.ndarray] = []
        step = max(1, min(SIDE_BY_SIDE, VISIT_BYTES // max(len(self.vectors), 1)))
        for at in range(0, len(queries), step):
            block = queries[at : at + step].astype(np.float32)
            ids, sims = self.nearest(block, beam)
            full = (sims[:, -1] >= least) & (ids.shape[1] < len(self.vectors))
            rows = [i[s >= least] for i, s in zip(ids, sims)]
            whole = np.flatnonzero(full)
            for some in np.array_split(whole, -(-len(whole) // 32) or 1):
                near = block[some] @ self.vectors.T >= least
                for r, hits in zip(some.tolist(), near):
                    rows[r] = np.flatnonzero(hits)
            out += rows
        return out


def _frozen(graph: Graph) -> list[bytes]:
    return [np.int64([len(graph.vectors), graph.vectors.shape[1], graph.degree, graph.entry, len(graph.links)]).tobytes(), *[part.tobytes() for part in graph.links]]


def _thawed(parts: list[bytes], vectors: np.ndarray) -> Graph:
    graph = Graph.__new__(Graph)
    n, _, graph.degree, graph.entry, layers = np.frombuffer(parts[0], np.int64).tolist()
    graph.vectors = np.ascontiguousarray(vectors, np.float32)
    graph.links = [np.frombuffer(p, np.int32).reshape(n, -1) for p in parts[1 : 1 + layers]]
    return graph


def _graphs(members: DataFrame) -> DataFrame:
    """(shard, parts): a row per shard with its members' numbers, copies and vectors and its graph."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        vectors = matrix(table.column("embedding"))
        held = [table.column("rep").to_numpy().astype(np.int64).tobytes(), table.column("copies").to_numpy().astype(np.int64).tobytes(), vectors.tobytes()]
        parts = [*held, *_frozen(Graph(normalized(vectors)))]
        return pa.table({"shard": table.column("shard").slice(0, 1), "parts": pa.array([parts], pa.list_(pa.binary()))})

    return members.select("shard", "rep", "copies", "embedding").groupBy("shard").applyInArrow(build, "shard int, parts array<binary>")


def _pair_mark(a: int, others: np.ndarray) -> np.ndarray:
    """A number for each unordered pair, so that the links named from either side can be told apart by their xor."""
    low, high = np.minimum(others, a).astype(np.uint64), np.maximum(others, a).astype(np.uint64)
    mark = (low * np.uint64(0x9E3779B97F4A7C15) + high + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mark ^= mark >> np.uint64(32)
    mark *= np.uint64(0xFF51AFD7ED558CCD)
    return (mark ^ mark >> np.uint64(29)).view(np.int64)


class _Links:
    """One shard's answers: counts of linked copies and a spanning forest, or the links themselves."""

    def __init__(self, parts: list[bytes], beam: int | None, least: float, pairs: bool):
        self.beam, self.least, self.pairs = beam, least, pairs
        self.reps, self.copies = (np.frombuffer(p, np.int64) for p in parts[:2])
        self.own = normalized(np.frombuffer(parts[2], np.float32).reshape(len(self.reps), -1))
        self.graph = None if beam is None else _thawed(parts[3:], self.own)
        self.parent: dict[int, int] = {}
        self.counts: dict[int, int] = {}
        self.named: dict[int, int] = {}  # xor of the marks of links that a class found
        self.told: dict[int, int] = {}  # the same of links that others found to it

    def root(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit, least = normalized(vectors), self.least
        if self.graph is None:
            found = (np.flatnonzero(s >= least - SLACK) for at in range(0, len(unit), 64) for s in unit[at : at + 64] @ self.own.T)
        else:
            found = iter(self.graph.linked(unit, self.beam, least - SLACK))
        for rep, vector, nodes in zip(ids.tolist(), unit, found):
            nodes = nodes[self.reps[nodes] != rep]
            nodes = nodes[self.own[nodes] @ vector >= least - 1e-12]
            nodes = nodes[np.einsum("kd,d->k", self.own[nodes], vector) >= least]
            if not len(nodes):
                continue
            others = self.reps[nodes]
            if self.pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), rep, np.int64)), pa.array(others), pa.array(self.copies[nodes])], ["rep", "other", "copies"])
                continue
            self.counts[rep] = int(self.copies[nodes].sum())
            marks = _pair_mark(rep, others)
            self.named[rep] = int(np.bitwise_xor.reduce(marks))
            for other, mark in zip(others.tolist(), marks.tolist()):
                self.told[other] = self.told.get(other, 0) ^ mark
                a, b = self.root(rep), self.root(other)
                self.parent[max(a, b)] = min(a, b)

    def done(self) -> Iterator[pa.RecordBatch]:
        if not self.pairs:
            touched = sorted(self.parent)
            columns = [touched, [self.counts.get(x) for x in touched], [self.root(x) for x in touched], [self.named.get(x, 0) for x in touched], [self.told.get(x, 0) for x in touched]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "linked", "root", "named", "told"])


def _answers(graphs: DataFrame, queries: DataFrame, shards: int, n_queries: int, beam: int | None, least: float, pairs: bool = False) -> DataFrame:
    """(rep, linked, root, named, told) of every class touched in each task: copies in linked classes, its root in the
    task's forest, and marks of the links that it found and that others found to it; or the links (rep, other, copies).

    `beam` None answers by brute force. A row with linked null only tells a member's root and marks.
    """
    asked = queries.select(F.col("rep").alias("id"), F.col("embedding").alias("vector"))
    schema = "rep long, other long, copies long" if pairs else "rep long, linked long, root long, named long, told long"
    return past_shards(graphs, asked, shards, n_queries, lambda parts: _Links(parts, beam, least, pairs), schema)


def _recall(found: DataFrame, true: DataFrame) -> float:
    """Of the audited classes that have links, the share all of whose links were found."""
    count = lambda df: df.where("linked is not null").groupBy("rep").agg(F.sum("linked").alias("n"))
    both = count(true).join(count(found).withColumnRenamed("n", "got"), "rep", "left")
    some, whole = both.agg(F.count("*"), F.count(F.when(F.col("got") == F.col("n"), 1))).first()
    return whole / some if some else 1.0


def _audited(graphs: DataFrame, members: DataFrame, shards: int, n: int, least: float) -> tuple[DataFrame, DataFrame, int]:
    """(classes drawn by a hash, their answers by brute force, how many were expected).

    Four times as many are drawn in turn, each answered once, until LEAST_LINKED have links or all are drawn.
    """
    draw = F.pmod(F.xxhash64(F.lit(4), "rep"), F.lit(DRAWS))
    drawn, true, low, size = [], [], 0, AUDIT
    while True:
        high = DRAWS if size >= n else size * DRAWS // n
        part = stash(members.where((draw >= low) & (draw < high)), "audit")
        drawn.append(part)
        true.append(stash(_answers(graphs, part, shards, min(size, n), None, least), "true"))
        whole = reduce(DataFrame.unionByName, true)
        linked = whole.where("linked is not null").select("rep").distinct().count()
        if linked >= LEAST_LINKED or high == DRAWS:
            return reduce(DataFrame.unionByName, drawn), whole, min(size, n)
        low, size = high, 4 * size


def _counts(found: DataFrame, graphs: DataFrame, members: DataFrame, shards: int, n: int, beam: int | None, least: float) -> DataFrame:
    """(rep, others): copies in the classes linked with each class, from whichever side a link was found.

    Classes for which the links that they found and those that others found to them differ ask again, and their links
    are counted from both sides.
    """
    told = found.groupBy("rep").agg(F.sum("linked").alias("others"), F.bit_xor("named").alias("named"), F.bit_xor("told").alias("told"))
    if beam is None:
        return told.where("others is not null").select("rep", "others")
    uneven = stash(told.where("named != told").select("rep"), "uneven")
    if uneven.isEmpty():
        return told.where("others is not null").select("rep", "others")
    again = members.join(uneven, "rep", "left_semi")
    links = stash(_answers(graphs, again, shards, n, beam, least, True).select("rep", "other", "copies").join(members.select("rep", F.col("copies").alias("own")), "rep"), "links")
    both = links.select("rep", "other", "copies").unionByName(links.select(F.col("other").alias("rep"), F.col("rep").alias("other"), F.col("own").alias("copies"))).join(uneven, "rep", "left_semi")
    mended = both.dropDuplicates(["rep", "other"]).groupBy("rep").agg(F.sum("copies").alias("others"))
    return told.where("others is not null").join(uneven, "rep", "left_anti").select("rep", "others").unionByName(mended)


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `rows` (vec_id, embedding).

    Vectors that are null, zero, not finite or of another length than most link with nothing and are kept. Every row is
    a vector of its own, also where several have one vec_id; a component's id is the smallest vec_id of its rows, null
    where none has one, and then all of them are kept. An empty table gives an empty table.
    """
    vectors = stash(cleaned(rows), "vectors")
    classes = vectors.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    shards = max(LEAST_SHARDS, -(-n // VECTORS_PER_SHARD))
    members = classes.select("rep", "embedding", "copies", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    graphs = stash(_graphs(members), "graphs")
    audit, true, drawn = _audited(graphs, members, shards, n, least)
    beam = None
    if drawn == n:
        found = true
    else:
        passing = (b for b in BEAMS if _recall(_answers(graphs, audit, shards, drawn, b, least), true) >= TARGET)
        beam = next(passing, None)
        found = stash(_answers(graphs, members, shards, n, beam, least), "found")
    counts = _counts(found, graphs, members, shards, n, beam, least)
    parts = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    labelled = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select("rep", "embedding", "first_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = labelled.join(smallest, "component").select("embedding", "n", "component_id")
    every = vectors.join(told, "embedding", "left")
    alone = F.col("embedding").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return every.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))
