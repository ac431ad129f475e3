"""Vector and url operators and the pipeline against brute force, with hard rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import ann, components, hnsw, url_filter
from tracewright.llm.catalog import URL_RULES

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [0.0] * 8, [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 7]


def rows_of(vectors, first=0):
    return [(first + i, None if v is None else [None if x is None else float(x) for x in v], 1, "c") for i, v in enumerate(vectors)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")


def clustered(rng, n, dims, groups):
    vectors = [rng.standard_normal(dims) for _ in range(n)]
    for size, noise in groups:
        center = rng.standard_normal(dims)
        vectors += [center + noise * rng.standard_normal(dims) for _ in range(size)]
    return [v.astype(np.float32).tolist() for v in vectors]


# components


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (7, 7), (None, 3), (-4, 900)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges + edges[:20], "src long, dst long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {x: 5 for x in [5, *range(200, 260)]} | {300: 300, 301: 300, 302: 300, -4: -4, 900: -4}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# embedding near-dedup


def brute_links(rows, least=0.95):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in good}
    parent = {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for a in unit:
        for b in unit:
            if a < b and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i, *_ in rows}


def test_links_and_components_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 150, 8, [(2, 0.01), (60, 0.02), (12, 0.15)]) + ODD
    vectors += [vectors[3], vectors[3], [x * 1000 for x in vectors[3]]]
    rows = rows_of(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


@pytest.mark.parametrize("pairs", [150, 6])
def test_links_are_whole_where_no_beam_passes_or_links_are_rare(spark, monkeypatch, pairs):
    rng = np.random.default_rng(11)
    rows = rows_of(clustered(rng, 400, 8, [(2, 0.01)] * pairs))
    monkeypatch.setattr(hnsw, "AUDIT", 8)
    monkeypatch.setattr(hnsw, "LEAST_LINKED", 20, raising=False)
    answers = hnsw._answers
    monkeypatch.setattr(hnsw, "_answers", lambda graphs, queries, shards, n, beam, least, pairs=False: answers(graphs, queries, shards, n, beam, least, pairs).where(F.lit(beam is None)))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_graph_finds_planted_neighbours():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    near = base[:300] + 0.15 * rng.standard_normal((300, 64)) * np.linalg.norm(base[:300], axis=1, keepdims=True) / 8
    vectors = np.concatenate((base, near))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(vectors)
    found = graph.linked(vectors, 64, 0.95)
    true = [np.flatnonzero(s >= 0.95) for s in vectors @ vectors.T]
    assert sum(len(np.intersect1d(f, t)) for f, t in zip(found, true)) >= 0.99 * sum(map(len, true))


def test_a_link_counts_on_both_sides_whichever_found_it(spark, monkeypatch):
    mark = lambda a, b: int(hnsw._pair_mark(a, np.array([b]))[0])
    assert mark(1, 2) == mark(2, 1) != mark(1, 3)
    # 1 found 2 and 3, 2 found nothing, 3 found 1; 4 and 5 found each other.
    found = [(1, 5, 1, mark(1, 2) ^ mark(1, 3), mark(1, 3)), (2, None, 1, 0, mark(1, 2)), (3, 1, 1, mark(1, 3), mark(1, 3)), (4, 7, 4, mark(4, 5), mark(4, 5)), (5, 6, 4, mark(4, 5), mark(4, 5))]
    members = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 6), (5, 7)], "rep long, copies long")
    asked = []

    def answers(graphs, queries, shards, n, beam, least, pairs):
        asked.extend(r.rep for r in queries.collect())
        return spark.createDataFrame([(1, 2, 2), (1, 3, 3)], "rep long, other long, copies long")

    monkeypatch.setattr(hnsw, "_answers", answers)
    told = hnsw._counts(spark.createDataFrame(found, "rep long, linked long, root long, named long, told long"), None, members, 4, 5, 32, 0.95)
    assert {r.rep: r.others for r in told.collect()} == {1: 5, 2: 1, 3: 1, 4: 7, 5: 6}
    assert sorted(asked) == [1, 2]


def test_several_vectors_under_one_id(spark):
    a, b, c = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6, [0.0, 0.0, 1.0] + [0.0] * 5
    rows = [(5, a, 1, "c"), (5, b, 1, "c"), (7, a, 1, "c"), (9, b, 1, "c"), (11, c, 1, "c")]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 5, False), (11, 0, 11, True)]
    rows = [(0, a, 1, "c"), (0, [0.0, 2.0] + [0.0] * 6, 1, "c"), (7, a, 1, "c"), (7, b, 1, "c"), (9, c, 1, "c"), (9, c, 1, "c")]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 2.0), (0, 2, 9, 0.0)]


def test_vectors_without_id_and_none_at_all(spark):
    rows = [(None, [1.0] * 8, 1, "c"), (4, [1.0] * 8, 1, "c"), (4, [1.0] * 8, 1, "c"), (9, [1.0] * 8, 1, "c")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in hnsw.near_duplicates(frame(spark, rows)).collect())
    assert got == [("4", 3, "4", True), ("4", 3, "4", True), ("9", 3, "4", False), ("None", 3, "4", False)]
    assert hnsw.near_duplicates(frame(spark, [])).count() == 0


# nearest neighbours


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 900, 16, [(30, 0.3)])
    vectors = [[x * (1 + i % 3) for x in v] for i, v in enumerate(vectors)]
    rows = rows_of(vectors)
    got = ann.nearest(frame(spark, rows)).collect()
    matrix = np.array(vectors, np.float32).astype(np.float64)
    hit = 0
    for q in range(0, len(rows), 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        scores = matrix @ matrix[q]
        assert all(r.score == pytest.approx(scores[r.vec_id], rel=1e-12) and r.vec_id != q for r in mine)
        scores[q] = -np.inf
        hit += len({r.vec_id for r in mine} & set(np.argsort(-scores)[:20].tolist()))
    assert hit >= 0.9 * 20 * len(range(0, len(rows), 20))


def test_ties_odd_vectors_and_few_candidates(spark):
    rows = rows_of([[1.0] * 8, [2.0] * 8, [2.0] * 8, [-1.0] * 8] + ODD) + [(20, [1.0] * 8, 1, "c"), (20, [1.0] * 8, 1, "c"), (None, [1.0] * 8, 1, "c")]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame(spark, rows)).collect())
    assert got == [(0, 1, 1, 16.0), (0, 2, 2, 16.0), (0, 3, 20, 8.0), (0, 4, 3, -8.0), (20, 1, 1, 16.0), (20, 2, 2, 16.0), (20, 3, 0, 8.0), (20, 4, 3, -8.0)]
    assert ann.nearest(frame(spark, [])).count() == 0
    assert ann.nearest(frame(spark, rows_of(ODD))).count() == 0


def test_an_outlier_query_gets_all_its_rows(spark):
    rng = np.random.default_rng(8)
    center = rng.standard_normal(16)
    vectors = [center + 1e-3 * rng.standard_normal(16) for _ in range(1000)]
    vectors[20] = -center  # one query of 50, less than what the audit may miss
    for n in (1000, 15):
        got = ann.nearest(frame(spark, rows_of(vectors[:n]))).collect()
        held = Counter(r.query_id for r in got)
        assert held == {q: min(20, n - 1) for q in range(0, n, 20)}
        assert all(len({r.vec_id for r in got if r.query_id == q}) == held[q] for q in held)


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    for top, parts in ((256, 4), (1 << 16, 4), (64, 3)):
        code = rng.integers(0, top, (500, parts)).astype(np.uint16)
        code[100:140] = code[7] ^ (1 << rng.integers(0, 6, (40, parts))).astype(np.uint16)
        index = ann.SubstringIndex(code)
        for radius in (0, 1, 2, 3, 7, 12, 30, 64):
            true = np.flatnonzero(np.bitwise_count(code ^ code[7]).sum(axis=1) <= radius)
            assert index.within(code[7], radius).tolist() == true.tolist()


def test_probing_reads_a_small_share_where_neighbours_are_close():
    rng = np.random.default_rng(16)
    centers = rng.standard_normal((400, 32))
    vectors = centers[rng.integers(0, 400, 20_000)] + 0.15 * rng.standard_normal((20_000, 32))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    longest = float(np.linalg.norm(vectors.astype(float), axis=1).max()) * (1 + 1e-9)
    projection = ann.learn(ann.lifted(vectors[:5000], longest))
    width = ann.substring_bits(len(vectors))
    index = ann.SubstringIndex(ann.codes(vectors, longest, projection, width))
    queries = vectors[:40]
    own = ann.codes(queries / np.linalg.norm(queries, axis=1, keepdims=True), 1.0, projection, width)
    products = queries.astype(float) @ vectors.T.astype(float)
    true = np.argsort(-products, axis=1)[:, :20]
    far = np.bitwise_count(index.code[None] ^ own[:, None]).sum(axis=2)
    radius = int(np.quantile(np.take_along_axis(far, true, axis=1), 0.95, method="higher"))
    hit = sum(len(np.intersect1d(index.within(bits, radius), t)) for bits, t in zip(own, true))
    assert hit >= 0.95 * true.size and index.probed < 0.3 * len(queries) * len(vectors)


# urls


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in raw)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r.key), r.host.count(".")))
    return host, path, best.key, best.verdict


def test_judgements_against_brute_force(spark):
    urls = [None, "", "no scheme.net/", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "x://example.net/en/1", "x://example.net/en", "x://a.example.net/en/", "x://notexample.net/en/", "x://example.com/de/a", "x://b.example.com/en/", "x://a.org/fr/", "x://org/fr/", "x://.org/fr/", "x://a..net/", "x://net:80/", "x://É.net/é", "x://example.com?/de/", "x://example.com#/de/", "a://b://c.net/", "x://a\n.net/"]
    rng = random.Random(3)
    for _ in range(400):
        urls.append(f"http://{rng.choice(['', 'a.', 'B.c.'])}{rng.choice(['example', 'x'])}.{rng.choice(['net', 'org', 'com', 'de'])}{rng.choice(['', '/', '/en/', '/fr/1', '/de/2', '/DE/'])}{rng.choice(['', '?q', '#f'])}{rng.randrange(50)}")
    rows = [(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, urls[6], "h", "v")]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"), URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(urls[r.page_id if r.page_id is not None else 6], URL_RULES)


def test_a_long_list_is_dealt_into_parts(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.{rng.choice(['net', 'org'])}" for i in range(2500)]
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), h, "/") for h in rng.sample(hosts, 900)] + URL_RULES
    urls = [None, "http://example.net/en/y", *[f"http://{rng.choice(['', 'a.'])}{h}/x" for h in hosts]]
    pages = spark.createDataFrame([*enumerate(urls), (None, urls[1])], "page_id long, url string")
    want = {i: brute_judge(u, rules) for i, u in [*enumerate(urls), (None, urls[1])]}
    got = url_filter.judged(pages, rules, part_bits=2000).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == want and len(got) == len(urls) + 1
    assert url_filter._bits(400, 2500) > 2 * 2000


def test_cascade_is_exact_for_its_universe(spark):
    for n, every in ((3000, 7), (40_000, 2), (50, 50)):
        keys = spark.range(n).select("id", url_filter.key_hashes(F.concat(F.lit("host"), "id", F.lit(".net/"))).alias("hashes"))
        inside, outside = keys.where(f"id % {every} = 0").select("hashes"), keys.where(f"id % {every} != 0").select("hashes")
        levels = url_filter.build_cascade(inside, outside)
        rows = keys.orderBy("id").collect()
        got = url_filter.member(levels, np.array([r.hashes for r in rows], np.int64))
        assert got.tolist() == [r.id % every == 0 for r in rows]
        assert n < 1000 or len(levels) > 2


def test_a_level_of_two_to_the_26_bits_is_used_in_no_time():
    level = url_filter.Level(1 << 26, 4, np.random.default_rng(2).integers(0, 1 << 63, 1 << 20).astype(np.uint64))
    hashes = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, (100_000, 2))
    at = url_filter.positions(hashes, 0, level.bits, 4)
    want = [all(int(level.words[x // 64]) >> (x % 64) & 1 for x in row) for row in at[:500].tolist()]
    assert url_filter.holds(level, 0, hashes)[:500].tolist() == want


def test_no_pages_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judged(one, []).collect()] == [(1, "a.net", "/", None, "allow")]


# pipeline


def test_pipeline_stages_keep_their_promises(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, d)
        after.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            assert len(toxic & ids) <= 0.3 * len(toxic & was) and len(ids) >= 0.8 * len(was - toxic)
        if name == "simhash near-dedup":
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts))
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "substring dedup", "mixing", "packing"]
    assert before.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_whose_names_clash(spark, name):
    d = "/root/testdata/sf0.001"
    clashing = ["_toxicity", "_scored", "_copy", "_row", "row", "ord", "digest", "_row_number", "_fingerprint", "_text", "score", "ids", "n", "fp", "size", "_part", "term"]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60).select("*", *[F.lit(c).alias(c) for c in clashing])
    docs = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    after = dict(corpus_pipeline.STAGES)[name](spark, docs, d)
    if name != "packing":
        assert after.columns == docs.columns
        assert after.where(" and ".join(f"`{c}` = '{c}'" for c in clashing)).count() == after.count() > 0
    else:
        assert after.count() > 0
