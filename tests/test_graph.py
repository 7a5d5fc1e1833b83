"""Graph operators; the first five mirror the original DAG's unit tests (slot reuse is storage detail)."""

import random

from pyspark.sql import functions as F

from sitegraph.operators import frontier as W
from sitegraph.operators import graph as G

C = "c0"


def _edges(spark, pairs):
    return spark.createDataFrame([(C, a, b) for a, b in pairs], "crawl_id string, src string, dst string")


def _keys(spark, urls):
    return spark.createDataFrame([(C, u) for u in urls], "crawl_id string, url string")


def _has(spark, edges, start, end):
    q = spark.createDataFrame([(C, start, end)], "crawl_id string, start string, end string")
    return G.has_path(spark, edges, q).first().reachable


def test_claim_blocks_only_while_in_progress(spark):
    batch = _keys(spark, ["a", "a"])
    assert [r.url for r in W.claim_urls(batch, _keys(spark, [])).collect()] == ["a"]
    assert W.claim_urls(batch, _keys(spark, ["a"])).count() == 0
    finished = G.graph_remove(_edges(spark, []), _keys(spark, ["a"]))  # finishing clears it
    assert finished.count() == 0
    assert W.claim_urls(batch, _keys(spark, [])).count() == 1


def test_self_edge_rejected_without_node(spark):
    links = spark.createDataFrame([("a", "a")], "page_url string, url string")
    assert G.link_edges(links).count() == 0
    assert _has(spark, _edges(spark, []), "a", "a") is False


def test_cycle_candidate_rejected_graph_unchanged(spark):
    e = _edges(spark, [("a", "b"), ("b", "c")])
    cand = spark.createDataFrame([(C, "c", "a"), (C, "a", "a"), (C, "a", "c")], "crawl_id string, src string, dst string")
    got = {(r.src, r.dst): r.creates_cycle for r in G.cycle_check(spark, e, cand).collect()}
    assert got == {("c", "a"): True, ("a", "a"): True, ("a", "c"): False}
    assert _has(spark, e, "a", "c") is True and _has(spark, e, "c", "a") is False


def test_missing_nodes_allowed(spark):
    assert _has(spark, _edges(spark, [("a", "b")]), "a", "b") is True


def test_finish_removes_node_and_edges(spark):
    e = G.graph_remove(_edges(spark, [("a", "b")]), _keys(spark, ["a"]))
    assert _has(spark, e, "a", "b") is False
    assert G.graph_nodes(_edges(spark, [("a", "b")]).join(e, "crawl_id", "left_anti")).count() == 2
    assert G.graph_remove(_edges(spark, [("a", "b")]), _keys(spark, ["zz"])).count() == 1  # unknown: no-op


def test_bfs_depths_parents_and_acyclic_rank_rule(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(30)]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)}
    pairs = {(a, b) for a, b in pairs if a != b}
    e = _edges(spark, sorted(pairs))
    starts = spark.createDataFrame([(C, "n0")], "crawl_id string, start string")
    tree = {r.url: (r.depth, r.parent) for r in G.discovery_tree(spark, e, starts).collect()}
    # python BFS
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
    depth, frontier = {"n0": 0}, ["n0"]
    while frontier:
        nxt = set()
        for a in frontier:
            for b in adj.get(a, ()):
                if b not in depth:
                    nxt.add(b)
        for b in nxt:
            depth[b] = depth[frontier[0]] + 1
        frontier = sorted(nxt)
    assert {u: d for u, (d, _) in tree.items()} == depth
    for u, (d, p) in tree.items():
        if d > 0:
            assert p == min(a for a in frontier_at(tree, d - 1) if u in adj.get(a, ()))
    kept = {(r.src, r.dst) for r in G.acyclic_edges(spark, e, starts).collect()}
    assert kept <= pairs and _acyclic(kept)


def frontier_at(tree, d):
    return [u for u, (dd, _) in tree.items() if dd == d]


def _acyclic(edges):
    adj, indeg = {}, {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
        indeg[b] = indeg.get(b, 0) + 1
        indeg.setdefault(a, 0)
    q = [n for n, d in indeg.items() if d == 0]
    seen = 0
    while q:
        n = q.pop()
        seen += 1
        for m in adj.get(n, []):
            indeg[m] -= 1
            if indeg[m] == 0:
                q.append(m)
    return seen == len(indeg)


def test_single_graph_without_crawl_key(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    q = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("zz", "zz")], "start string, end string")
    got = {(r.start, r.end): r.reachable for r in G.has_path(spark, e, q, by=()).collect()}
    assert got == {("a", "d"): True, ("d", "a"): False, ("a", "a"): True, ("zz", "zz"): False}
    tree = {r.url: (r.depth, r.parent) for r in G.discovery_tree(
        spark, e, spark.createDataFrame([("a",)], "start string"), by=()).collect()}
    assert tree == {"a": (0, None), "b": (1, "a"), "c": (2, "b"), "d": (3, "c")}


def test_has_path_of_a_node_without_links(spark):
    edges = spark.createDataFrame([("c", "a", "b")], "crawl_id string, src string, dst string")
    asked = spark.createDataFrame([("c", "z", "z"), ("c", "a", "z"), ("c", "a", "b"), ("c", "b", "b")],
                                  "crawl_id string, start string, end string")
    nodes = spark.createDataFrame([("c", "z")], "crawl_id string, url string")
    def found(**kw):
        return {(r.start, r.end): r.reachable for r in G.has_path(spark, edges, asked, **kw).collect()}
    assert found(nodes=nodes) == {("z", "z"): True, ("a", "z"): False, ("a", "b"): True, ("b", "b"): True}
    assert found()[("z", "z")] is False


def test_has_path_over_many_levels_stops_and_agrees(spark):
    chain = [("c", f"n{i:02}", f"n{i + 1:02}") for i in range(14)] + [("c", "n14", "n03")]
    edges = spark.createDataFrame(chain, "crawl_id string, src string, dst string")
    asked = spark.createDataFrame([("c", "n00", "n02"), ("c", "n00", "n14"), ("c", "n05", "n03"), ("c", "n05", "n01"),
                                   ("c", "n14", "n14")], "crawl_id string, start string, end string")
    got = {(r.start, r.end): r.reachable for r in G.has_path(spark, edges, asked).collect()}
    assert got == {("n00", "n02"): True, ("n00", "n14"): True, ("n05", "n03"): True, ("n05", "n01"): False,
                   ("n14", "n14"): True}


def test_pieces_append_and_merge(spark):
    table = G.Pieces("crawl_id", "url")
    for n in range(6):
        table.add(_keys(spark, [f"u{n}"]))
    assert sorted(r.url for r in table.rows().collect()) == [f"u{n}" for n in range(6)]
    assert [m for m, _ in table.pieces] == [2, 1]  # of 4 and of 2 additions
    missing = table.missing(G.partitioned(_keys(spark, ["u3", "new"]), "crawl_id", "url"))
    assert [r.url for r in missing.collect()] == ["new"]
