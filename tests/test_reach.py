"""Many-start reachability against a plain search from every node."""

import random

import pytest

from sitegraph.operators import graph as G
from sitegraph.operators import reach as R
from sitegraph.plans import fixtures as FX


def _plain(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for s in out:
        seen, todo = set(), [s]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    return reach


def _shapes():
    rnd = random.Random(5)
    ring = [(f"r{i}", f"r{(i + 1) % 20}") for i in range(20)]
    bow = ring + [(f"in{i}", f"r{i % 20}") for i in range(70)] + [(f"r{i % 20}", f"out{i}") for i in range(70)] + [("in3", "in4"), ("out1", "out2")]
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(14)] + [("n010", "n008"), ("n005", "n004")]
    layers = [(f"l{k}_{i}", f"l{k + 1}_{rnd.randrange(12)}") for k in range(4) for i in range(12) for _ in range(2)]
    dense = [(f"d{rnd.randrange(40)}", f"d{rnd.randrange(40)}") for _ in range(60)]
    two = [("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("w", "z"), ("q", "q")]
    return {"bow": bow, "chain": chain, "layers": layers, "dense": dense, "two": two}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(c, a, b) for c, pairs in _shapes().items() for a, b in pairs]
    return spark.createDataFrame(rows, "crawl_id string, src string, dst string").repartition(3)


def test_strong_components(spark):
    rnd = random.Random(7)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(8)}
    got = {r.node: r.component for r in R.strong_components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    reach = _plain([(a, b) for a, b in pairs if a != b])
    for a in reach:
        for b in reach:
            if a != b:
                assert (got.get(a, a) == got.get(b, b)) == (b in reach[a] and a in reach[b])


@pytest.mark.parametrize("kw", [{}, {"hubs": 1, "ancestors": 2}], ids=str)
def test_every_pair_of_every_shape(spark, graph, kw):
    want = {(c, s, e) for c, pairs in _shapes().items() for s, r in _plain([p for p in pairs if p[0] != p[1]]).items() for e in r if e != s}
    nodes = G.graph_nodes(graph)
    asked = nodes.withColumnRenamed("url", "start").join(nodes.withColumnRenamed("url", "end"), "crawl_id")
    assert {tuple(r) for r in R.reach_pairs(spark, graph, asked, **kw).collect()} == want


def test_no_edges_and_unknown_nodes(spark, graph):
    asked = spark.createDataFrame([("bow", "in1", "nowhere"), ("none", "a", "b"), ("bow", "in1", "out5"), ("bow", "in1", "out5"), (None, "a", "b")],
                                  "crawl_id string, start string, end string")
    assert [tuple(r) for r in R.reach_pairs(spark, graph, asked).collect()] == [("bow", "in1", "out5")]
    assert R.reach_pairs(spark, graph.where("false"), asked).count() == 0


def test_a_round_of_a_flow_shuffles_only_what_is_sent(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 2), (9, 9)], "a long, b long")
    values = spark.createDataFrame([(i, 10 - i if i else 3) for i in range(10)], "node long, v long")
    rounds, plain = [], type(edges).checkpoint

    def checkpoint(df, *args, **kw):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "SortMergeJoin" in plan or "Join" in plan:
            rounds.append(plan.count("Exchange"))
        return plain(df, *args, **kw)

    monkeypatch.setattr(type(edges), "checkpoint", checkpoint)
    got = {r.node: r.v for r in R._greatest(edges, values).collect()}
    assert got == {0: 3, 1: 9, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9, 7: 3, 8: 2, 9: 1}
    assert len(rounds) > 4 and set(rounds) == {1}
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_closed_site_parses_the_html_once(spark):
    pages = spark.createDataFrame([(i, f"https://h.org/p{i}", '<a href="/a"><a class="x" href="/b">') for i in range(4)],
                                  "page_id long, url string, html string")
    site, edges = FX.closed_site(pages)
    assert not any("regexp_extract_all" in df._jdf.queryExecution().analyzed().toString() for df in (site, edges))
    assert edges.count() == 9 and site.count() == 4


def test_the_questions_are_computed_once(spark, graph):
    nodes = G.graph_nodes(graph)
    rows = nodes.withColumnRenamed("url", "start").join(nodes.where("crawl_id = 'two'").withColumnRenamed("url", "end"), "crawl_id")
    n, read = rows.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = G.has_path(spark, graph, rows.mapInArrow(counted, rows.schema)).collect()
    assert len(got) == n and read.value == n  # three times before, with the shuffles below them


def test_repeated_and_null_questions_all_have_an_answer(spark, graph):
    asked = spark.createDataFrame([("two", "x", "w", 1), ("two", "x", "w", 2), ("two", "w", "x", 3), ("two", None, "x", 4), (None, "x", "w", 5),
                                   ("two", "q", "q", 6), ("two", "no", "no", 7)], "crawl_id string, start string, end string, id int")
    got = {r.id: r.reachable for r in G.has_path(spark, graph, asked).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}
