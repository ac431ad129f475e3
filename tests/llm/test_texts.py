"""Packing, toxicity, substring dedup, sharding, mixing and chat formatting against brute force, with hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, mixing, packing, sharding, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n ", "one", "<|endoftext|> a <|endoftext|>", "naïve 日本語 \x85\x1c \U0001f600  x", "a" * 5000, "x " * 3000, "'S'LL don't\r\n\r\n  b", "same text", "same text"]


def table(spark, texts, sources=None):
    rows = [(i, t, None, (sources or ["s"])[i % len(sources or ["s"])], None, 5, "k", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=300):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


# packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_every_id_is_packed_once_and_windows_are_full(spark):
    rng = random.Random(3)
    texts = EDGES + [prose(rng, rng.choice([1, 5, 80, 400, 3000])) for _ in range(60)]
    pieces = packing.packed(table(spark, texts), shard_tokens=4000).withColumn("crc", F.crc32("ids")).collect()
    want = reference_ids(texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert np.frombuffer(bytes(p.ids), "<u4").tolist() == ids
        assert p.crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert p.doc_tokens == len(want[p.doc_id])
    for doc_id, ids in enumerate(want):
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or (at < 1024 and at.bit_count() == 1)


def test_neighbours_share_terms():
    docs = [np.array(d, np.uint16) for d in ([1, 2, 3, 0], [9, 8, 7, 0], [1, 2, 5, 0], [1, 6, 6, 0])]
    index = packing.Index(docs, np.ones(16, np.float32) - np.eye(1, 16, 0, dtype=np.float32)[0], 4.0)
    index.use(0)
    assert index.neighbours(0) == [2, 3]
    index.use(2)
    assert index.neighbours(0) == [3]


def brute_scores(docs, used, seed, idf, mean):
    out = {}
    weight = lambda d, t: idf[t] * (tf := d.count(t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    strong = sorted(set(docs[seed]) - {0}, key=lambda t: -weight(docs[seed], t))[: packing.QUERY_TERMS]
    for i, d in enumerate(docs):
        if i not in used:
            out[i] = sum(weight(d, t) for t in strong if t in d)
    return {i: s for i, s in out.items() if s > 0}


def test_scores_against_plain_bm25_while_documents_are_used():
    rng = random.Random(12)
    docs = [[rng.randrange(1, 40) for _ in range(rng.randrange(1, 11))] + [0] for _ in range(300)]
    counts = np.array([sum(t in d for d in docs) for t in range(40)])
    idf, mean = packing.inverse_frequencies(counts, len(docs)), sum(map(len, docs)) / len(docs)
    index, used = packing.Index([np.array(d, np.uint16) for d in docs], idf, mean), set()
    for seed in rng.sample(range(300), 250):
        index.use(seed)
        used.add(seed)
        want = brute_scores(docs, used, seed, idf, mean)
        got = index.neighbours(seed)
        assert len(got) == min(len(want), packing.NEIGHBOURS) and not used & set(got)
        least = sorted(want.values(), reverse=True)[: len(got)]
        assert [want[g] for g in got] == pytest.approx(least, rel=1e-4)


def test_ids_are_those_of_the_tokenizer():
    settled = re.compile(f"[{packing.settled_characters()}]")
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    held = "".join(f"a{c} {c}{c}1{c}\n" for c in chars if settled.match(c))
    texts = EDGES + ["".join(f"x{c}y {c}" for c in chars), "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "a" * 1_000_000, "!?" * 500_000, "\u0378\u1c80 \U0001f9ff"]
    texts += [held[i : i + 20_000] for i in range(0, len(held), 20_000)]
    encode = packing.encoder()
    for text, want in zip(texts, reference_ids(texts)):
        assert [*encode(text or ""), 0] == want


def test_lexical_neighbours_meet_across_the_table(spark):
    rng = random.Random(21)
    topics = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)] for _ in range(30)]
    texts = [" ".join(rng.choices(topics[i % 30], k=60)) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    tokens = packing.tokenized(docs)
    counts, n, mean = packing.document_frequencies(tokens)
    assert n == 600 and counts[0] == 600
    together = {}
    for p in packing.packed(docs, shard_tokens=20_000).collect():
        together.setdefault(p.sequence_id, []).append(p.doc_id % 30)
    shares = [max(Counter(t).values()) / len(t) for t in together.values() if len(t) > 2]
    assert np.mean(shares) > 0.6


def test_many_empty_rows_are_packed(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "if(id % 3 = 0, null, '') as text")
    pieces = packing.packed(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(p.n for p in pieces) == 60_000 and all(p.n == 1024 or p.n.bit_count() == 1 for p in pieces)


def test_packing_nothing(spark):
    assert packing.packed(table(spark, [])).count() == 0


# toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.judged(docs, labels.select("doc_id", "toxic")).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50
    assert (got.predicted == got.toxic).mean() > 0.9
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_grams_are_the_same_wherever_they_stand():
    a, b = toxicity.gram_buckets("xx idiot yy"), toxicity.gram_buckets("IDIOT idiot")
    assert set(toxicity.gram_buckets("idiot").tolist()) <= set(b.tolist())
    assert len(set(a.tolist()) & set(b.tolist())) >= 3 + 2 + 1


def test_ratios_and_fit_against_a_plain_computation(spark):
    rng = random.Random(17)
    texts = [(prose(rng, 12, 40) + (" vile brute" if i % 5 == 0 else " kind words" if i % 3 else ""), int(i % 5 == 0)) for i in range(80)]
    sample = spark.createDataFrame(texts, "text string, toxic int")
    counts = toxicity._document_counts(sample).toArrow()
    held = [set(toxicity.gram_buckets(t).tolist()) for t, _ in texts]
    plain = {b: (sum(b in h for h, (_, y) in zip(held, texts) if y), sum(b in h for h, (_, y) in zip(held, texts) if not y)) for b in set().union(*held)}
    assert {r["bucket"]: (r["toxic"], r["other"]) for r in counts.to_pylist()} == plain
    n1, n0 = sum(y for _, y in texts), sum(1 - y for _, y in texts)
    place, ratios = toxicity._choose(counts, n1, n0)
    assert len(ratios) > 5
    for bucket in np.flatnonzero(place >= 0).tolist():
        c1, c0 = plain[bucket]
        s1, s0 = toxicity.SMOOTHING * n1 / n0, toxicity.SMOOTHING
        assert ratios[place[bucket]] == pytest.approx(np.log((c1 + s1) / n1) - np.log((c0 + s0) / n0))
    rows, features = toxicity._found([t for t, _ in texts], place)
    y = np.array([y for _, y in texts], float)
    weights, bias = toxicity._fit(np.searchsorted(rows, np.arange(len(y) + 1)), features, y, ratios, steps=20_000)
    scaled = np.zeros((len(texts), len(ratios)))
    scaled[rows, features] = ratios[features]
    error = 1 / (1 + np.exp(-(scaled @ (weights / ratios) + bias))) - y
    gradient = np.append(scaled.T @ error + toxicity.RIDGE * weights / ratios, error.sum())
    assert np.abs(gradient).max() < 1e-3  # the only minimum of a convex loss


def test_few_labelled_rows_still_teach(spark):
    rows = [(i, "what a vile brute" if i % 2 else "a kind word for all") for i in range(16)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.judged(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all((got[i] > got[i + 1]) == bool(i % 2) for i in range(15))


def test_toxicity_of_hard_rows(spark):
    docs = table(spark, EDGES)
    labels = spark.createDataFrame([(3, None), (None, 1), (4, 1), (4, 0), (6, 0), (7, 0), (9, 0)], "doc_id long, toxic int")
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert toxicity.judged(table(spark, []), labels.limit(0)).count() == 0


# substring dedup


def brute_repeats(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    low = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    passage, tail = prose(rng, 60, 10**6), prose(rng, 30, 10**6)
    texts = EDGES + ["a b " * 100, "a b " * 60]
    for i in range(40):
        body = prose(rng, rng.choice([10, 49, 50, 200]), 10**6)
        texts.append(rng.choice([body, f"{body} {passage} {prose(rng, 20)}", f"{passage} {tail}", f"{body} {passage} {tail} {body}", " ".join(passage.split()[:49])]))
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in substring.repeats(table(spark, texts)).collect())
    want = brute_repeats(rows)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 10
    cut = {r.doc_id: r.text for r in substring.without_repeats(table(spark, texts)).collect()}
    for doc_id, n, gone, sha in want:
        if gone == 0:
            assert cut[doc_id] == texts[doc_id]
        elif gone == n:
            assert doc_id not in cut
        else:
            assert hashlib.sha256(cut[doc_id].encode()).hexdigest() == sha


def test_matches_with_others_than_the_leader(spark):
    """Documents that share more with each other than with the smallest one, and anchors that stand twice in a document."""
    rng = random.Random(41)
    core, more = prose(rng, 55, 10**6), prose(rng, 70, 10**6)
    texts = [f"{prose(rng, 9)} {core} {prose(rng, 60, 10**6)}", f"{core} {more}", f"x {core} {more}", f"{core} q {core} {more} {core}", f"{more} {core}", f"{more} {core} {more[:200]}"]
    head, tail = core.split()[:30], core.split()[30:]
    for _ in range(12):
        left, right = prose(rng, 25, 3), prose(rng, 25, 3)
        texts.append(" ".join([left, *head, *tail, right]))
        texts.append(" ".join([left, *head, "gap", *tail, right] if rng.random() < 0.4 else [right, *core.split(), left]))
    rng.shuffle(texts)
    got = sorted(tuple(r) for r in substring.repeats(table(spark, texts)).collect())
    assert got == brute_repeats(list(enumerate(texts)))
    assert sum(r[2] > 0 for r in got) > 10


def test_words_that_two_runs_share():
    a = np.arange(9, dtype=np.uint64)
    assert substring.agreeing(a, a) == 9 and substring.agreeing(a, a[:3]) == 3 and substring.agreeing(a, a[:0]) == 0
    b = np.array([0, 1, 7, 3], np.uint64)
    assert substring.agreeing(a, b) == substring.agreeing(b, a) == 2 and substring.agreeing(a[1:], a) == 0


def test_every_window_belongs_to_its_leftmost_smallest_gram():
    rng = np.random.default_rng(19)
    for top in (3, 1000, 2**63):
        words = rng.integers(0, top, 150).astype(np.uint64)
        places, _ = substring.anchors(words, 20, 5)
        grams = substring.run_hashes(words, 5)
        first, last = substring.owned(grams, places, 16, 131)
        got = {s: int(p) for p, a, b in zip(places, first, last) for s in range(a, b + 1)}
        assert got == {s: s + int(grams[s : s + 16].argmin()) for s in range(131)}
        assert sum(max(0, int(b) - int(a) + 1) for a, b in zip(first, last)) == 131


def test_repeats_with_null_and_repeated_ids(spark):
    text = prose(random.Random(2), 80, 10**6)
    rows = [(None, text), (5, text), (5, text), (9, "z " + text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 0), ("5", 0), ("9", 80), ("None", 80)]
    assert substring.repeats(table(spark, [])).count() == 0


def test_equal_windows_keep_an_equal_anchor():
    rng = np.random.default_rng(1)
    for _ in range(20):
        shared = rng.integers(0, 2**63, 50).astype(np.uint64)
        a, b = (np.concatenate((rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64), shared, rng.integers(0, 2**63, 30).astype(np.uint64))) for _ in range(2))
        assert set(substring.anchors(a)[1].tolist()) & set(substring.anchors(b)[1].tolist())


# sharding


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for s in sizes:
            used, filled = (used, filled + s) if filled + s <= middle else (used + 1, s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 40])
def test_sharding_is_minimax_and_keeps_groups(spark, hot):
    rng = random.Random(4)
    texts = EDGES + [prose(rng, rng.randrange(1, 200)) for _ in range(90)] + ["hot text " * 50] * hot
    rows = sharding.sharded(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    of_text, filled, slots = {}, Counter(), defaultdict(list)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert of_text.setdefault(text, r.shard) == r.shard
        filled[r.shard] += r.size
        slots[r.shard].append(r.slot)
    groups = {}
    for t in texts:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 1
    assert max(filled.values()) == smallest_capacity(list(groups.values()), 8) or max(filled.values()) <= smallest_capacity(list(groups.values()), 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(filled) <= set(range(8))


def test_sharding_nothing_and_null_ids(spark):
    assert sharding.sharded(table(spark, [])).count() == 0
    rows = sharding.sharded(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4


# mixing


def brute_targets(sizes, weights):
    open_, left, out = {i for i, s in enumerate(sizes) if s}, Fraction(sum(sizes)), [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > 3 * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(3 * sizes[i]) if full else weights[i] * unit
        left -= sum(out[i] for i in full)
        open_ = open_ - full if full else set()
    return out


def test_sainte_lague_seats():
    rng = random.Random(6)
    for _ in range(50):
        votes = [Fraction(rng.randrange(1, 1000)) for _ in range(rng.randrange(1, 9))]
        seats, limits = rng.randrange(0, 200), [rng.randrange(0, 60) for _ in votes]
        won = [0] * len(votes)
        for _ in range(min(seats, sum(limits))):
            best = max((v / (2 * w + 1), -i) for i, (v, w) in enumerate(zip(votes, won)) if w < limits[i])
            won[-best[1]] += 1
        assert mixing.apportion(votes, limits, seats) == won


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    sources = ["b", "a", None, "é", "Z"]
    texts = [prose(rng, rng.choice([1, 30, 300])) for _ in range(200)] + EDGES
    docs = table(spark, texts, sources + ["a"] * 5)
    rows = mixing.mixed(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(r.row.text or "")) and 0 <= r.taken <= 3 * r.size
        assert r.taken == r.passes * r["size"] + r.head_until - r.head_from + r.tail_until - r.tail_from
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = ["Z", "a", "b", "é", None]
    want = brute_targets([sizes[s] for s in names], [1, 2, 3, 1, 2])
    for s, w in zip(names, want):
        assert target[s] == pytest.approx(float(w))
        assert abs(taken[s] - w) <= mixing.BLOCK_WORDS
    again = {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    written = mixing.written_out(mixing.mixed(docs), docs.columns)
    assert written.columns == docs.columns
    words = Counter()
    for r in written.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({r.doc_id: r.taken for r in rows if r.taken})


def test_sparse_shards_and_small_sources_meet_their_targets(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 10), "b ten words in each shard") for i in range(50)]
    rows += [(100 + i, prose(rng, 1), "c five words") for i in range(5)] + [(200, prose(rng, 1500), "d one text"), (300, prose(rng, 7), None)]
    rows += [(1000 + i, prose(rng, rng.choice([3, 40, 200])), "a large one") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for per_shard in (30, 100_000):
        got = mixing.mixed(docs, rows_per_shard=per_shard).collect()
        taken, target = Counter(), {r.source: r.target for r in got}
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
        assert all(abs(taken[s] - t) < mixing.BLOCK_WORDS for s, t in target.items())
        assert taken["c five words"] == 15 and taken["b ten words in each shard"] == 1500


def test_very_many_sources(spark):
    docs = spark.range(100_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", "concat('s', id) as source").union(spark.createDataFrame([(10**6, "v " * 5000, "big")], "doc_id long, text string, source string"))
    got = mixing.mixed(docs).agg(F.count("*"), F.max(F.abs(F.col("taken") - F.col("target"))), F.max(F.col("taken") - 3 * F.col("size"))).first()
    assert got[0] == 100_001 and got[1] < mixing.BLOCK_WORDS and got[2] <= 0


def test_shards_win_words_by_sainte_lague(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(40):
        words = [rng.choice([0, 1, 2, 50, rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 30))]
        if not sum(words):
            continue
        take = rng.choice([0, 1, sum(words), 3 * sum(words), rng.randrange(0, 3 * sum(words) + 1)])
        rows += [(f"s{s}", k, w, sum(words), take) for k, w in enumerate(words)]
        held = [(k, w) for k, w in enumerate(words) if w]
        for (k, _), q in zip(held, mixing.apportion([Fraction(w) for _, w in held], [3 * w for _, w in held], take)):
            want[f"s{s}", k] = q
    got = {(r.source, r._shard): r.quota for r in mixing.quotas(spark.createDataFrame(rows, "source string, _shard int, words long, source_size long, take long")).collect()}
    assert got == want


def test_mix_of_nothing(spark):
    assert mixing.mixed(table(spark, [])).count() == 0
    rows = mixing.mixed(spark.createDataFrame([(1, None, None), (1, "", "a"), (None, "", "b")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 3


# chat


def test_conversations_survive_the_round_trip(spark):
    hard = ["<|im_end|>", "<|im_start|>", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "<", "|", "<|", "a\n\nb", "", None, "<\\", "ends with <", "<\\n", "x<|im_end|>\n"]
    roles = ["user", "assistant", "ass\nistant", "<|im_start|>", "<\\n", None, "assistant", "tool<|"]
    rows, n = [], 0
    for i, text in enumerate(hard):
        for j, role in enumerate(roles):
            rows += [(n, 1, role, text, "x"), (n, 0, roles[(j + 1) % len(roles)], hard[(i + 1) % len(hard)], "y"), (n, None, "assistant", "first", "z")]
            n += 1
    rows += [(None, 0, "user", "no id", "")] * 2
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    told = defaultdict(list)
    for c, t, role, text, _ in rows:
        told[c].append((t is not None, t or 0, role or "", text or ""))
    read = {r.conv_id: r for r in chat.read_back(done).collect()}
    for r in done.collect():
        turns = [(role, text) for _, _, role, text in sorted(told[r.conv_id])]
        assert "".join(s.text for s in r.segments) == r.formatted
        marks = len(re.findall(r"<\|im_start\|>", r.formatted)), len(re.findall(r"<\|im_end\|>", r.formatted))
        assert marks == (len(turns), len(turns))
        got = read[r.conv_id]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got.formatted_chars == len(r.formatted)
        assert r.escaped == any("<|im_start|>" in x or "<|im_end|>" in x or re.search(r"<\\+\|", x) for t in turns for x in t) or "\n" in "".join(a for a, _ in turns) or any(re.search(r"<\\+n", a) for a, _ in turns)


def test_no_conversation(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
