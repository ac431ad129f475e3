import random
from pathlib import Path

from tracewright import scratch
from tracewright.llm import components


def smallest_by_walking(edges):
    beside = {}
    for a, b in edges:
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(beside):
        todo = [start] * (start not in out)
        while todo:
            if (node := todo.pop()) not in out:
                out[node] = start
                todo += beside[node]
    return out


def test_few_links_are_settled_without_rounds_and_as_by_rounds(spark, monkeypatch):
    rng = random.Random(3)
    chain = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)]
    edges = list(zip(chain, chain[1:])) + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(9999, x) for x in range(8000, 8100)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    links, want, written = spark.createDataFrame(edges, "src long, dst long"), smallest_by_walking(edges), []
    monkeypatch.setattr(components, "stash", lambda df, label: written.append(label) or scratch.stash(df, label))
    got = components.connected_components(links).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert written == ["links", "components"]
    written.clear()
    got = components.connected_components(links, few=100).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert written.count("stars") > 2


def test_written_tables_have_no_marker_file(spark):
    table = scratch.stash(spark.range(5), "plain")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert {p.name for p in folder.iterdir() if "SUCCESS" in p.name} == set()
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4]
