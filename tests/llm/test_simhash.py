import random
from collections import defaultdict

import xxhash

from tracewright.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    for text in [None, "", "  \n", "One", "a b c d", "Ä b\x0bC d e é x y", "x " * 500, "w%d " * 7 % tuple(range(7))]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_same_xxh64(spark):
    row = spark.sql("select xxhash64('the quick brown fox') h").first()
    assert row.h % 2**64 == xxhash.xxh64(b"the quick brown fox", seed=42).intdigest()


def test_every_close_pair_is_linked(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for k in (1, 3, 4, 5, 6):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    for blocks in (None, 2, 3, 4):
        got = {frozenset((r.src, r.dst)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, blocks).collect()}
        want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
        assert got == want


def test_blocks_widen_with_the_table():
    assert [simhash.blocks_for(n) for n in (0, 1, 10**6, 10**7, 10**8, 10**9, 10**11)] == [3, 3, 3, 3, 2, 2, 2]


def test_covering_radius_is_one():
    for _, width, hamming in [b for n in simhash.BLOCKS for b in simhash.block_layout(n)]:
        assert all(any(m.bit_count() <= 1 for m in masks) for masks in simhash.flips(width, hamming, 1))


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["w%d" % i for i in range(400)]
    texts = [None, "", " ", "short", "short", "Short"]
    for _ in range(25):
        words = rng.choices(vocab, k=300)
        texts.append(" ".join(words))
        for edits in (0, 1, 2, 40):
            copy = list(words)
            for at in rng.sample(range(300), edits):
                copy[at] = "edit%d" % at
            texts.append(" ".join(copy))
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = [3 * c for c in brute_components([brute_fingerprint(t) for t in texts])]
    assert {r.doc_id: r.component_id for r in got} == {3 * i: c for i, c in enumerate(want)}
    sizes = defaultdict(int)
    for c in want:
        sizes[c] += 1
    assert max(sizes.values()) > 2


def test_empty_table_repeats_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e", "x"), (7, "a b c d e", "y"), (7, "quite another text with words of its own", "z"), (None, "a b c d e", "n"), (None, "only here and without any id at all", "p"), (None, "only here and without any id at all", "p"), (8, None, "e"), (9, "", "f"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fingerprint string")
    got = sorted((str(r.doc_id), r.text or "", r._fingerprint) for r in simhash.one_of_each(docs).collect())
    assert got == sorted([("3", "a b c d e", "x"), ("7", rows[2][1], "z"), ("None", rows[4][1], "p"), ("8", "", "e")])
    assert simhash.one_of_each(docs.limit(0)).count() == 0
