"""State, frontier and retry operators."""

from pyspark.sql import functions as F

from sitegraph.operators import frontier as W
from sitegraph.operators import state as S
from sitegraph.plans import fixtures as FX


def test_state_invariants_on_fixture(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    url_state, completed, active = FX.crawl_state(pages)
    pend = S.pending_urls(url_state, completed)
    visited = url_state.select("crawl_id", "url")
    assert pend.unionByName(completed).distinct().exceptAll(visited).count() == 0
    assert visited.exceptAll(pend.unionByName(completed).distinct()).count() == 0
    assert url_state.groupBy("crawl_id", "url").count().where("count > 1").count() == 0
    summ = S.crawl_summary(url_state, completed).collect()
    assert sum(r.visited for r in summ) == url_state.count()
    assert sum(r.pending for r in summ) == pend.count()


def test_upsert_insert_lookup_delete(spark):
    st = spark.createDataFrame([("c", "u1", None), ("c", "u2", "p2")], "crawl_id string, url string, path string")
    done = spark.createDataFrame([("c", "u2")], "crawl_id string, url string")
    saved = spark.createDataFrame([("c", "u1", "p1"), ("c", "u3", "p3")], "crawl_id string, url string, path string")
    st2, done2 = S.upsert_paths(st, done, saved)
    assert sorted(map(tuple, st2.collect())) == [("c", "u1", "p1"), ("c", "u2", "p2"), ("c", "u3", "p3")]
    assert sorted(r.url for r in done2.collect()) == ["u1", "u2", "u3"]
    links = spark.createDataFrame([("c", "u1"), ("c", "u9"), ("c", "u9")], "crawl_id string, url string")
    added, st3 = S.insert_if_absent(st2, links)
    assert [r.url for r in added.collect()] == ["u9"] and st3.count() == 4
    assert sorted((r.url, r.path) for r in S.lookup(st2, links.distinct()).collect()) == [("u1", "p1"), ("u9", None)]
    assert sorted(r.url for r in S.delete(st2, links).collect()) == ["u2", "u3"]


def test_first_seen_and_seeds(spark):
    links = spark.createDataFrame([("c", "u", 2, 0), ("c", "u", 1, 5), ("c", "v", 1, 1)],
                                  "crawl_id string, url string, page_id int, pos int")
    got = sorted(map(tuple, S.first_seen(links).collect()))
    assert got == [("c", "u", 1, 5), ("c", "v", 1, 1)]
    starts = spark.createDataFrame([("c", "https://a/"), ("d", "https://spam/")], "crawl_id string, url string")
    visited = spark.createDataFrame([], "crawl_id string, url string")
    assert [r.url for r in S.crawl_seeds(starts, visited, excluded=["spam"]).collect()] == ["https://a/"]


def test_frontier_rank_equals_window_and_batch(spark):
    rows = [("c1" if i % 3 else "c2", f"u{i:03d}", i % 4, i % 2) for i in range(200)]
    f = spark.createDataFrame(rows, "crawl_id string, url string, priority int, depth int")
    ranked = {(r.crawl_id, r.url): r.rank for r in W.frontier_rank(f).collect()}
    exp = {}
    for c in ("c1", "c2"):
        mine = sorted((p, d, u) for cc, u, p, d in rows if cc == c)
        for i, (_, _, u) in enumerate(mine, 1):
            exp[(c, u)] = i
    assert ranked == exp
    batch = {(r.crawl_id, r.url) for r in W.frontier_batch(f, 7).collect()}
    assert batch == {k for k, v in exp.items() if v <= 7}


def test_fetch_outcome_schedule(spark):
    log = spark.createDataFrame(
        [("ok1", 1, 200, None), ("s", 1, 503, None), ("s", 2, 503, None), ("s", 3, 200, None),
         ("t", 1, None, "timeout"), ("t", 2, 200, None), ("n", 1, 404, None), ("x", 1, None, "other"),
         *[("f5", i, 500, None) for i in range(1, 6)], *[("to5", i, None, "timeout") for i in range(1, 6)],
         *[("mix", i, 503, None) for i in range(1, 5)], ("mix", 5, None, "timeout")],
        "url string, attempt int, status int, error string").withColumn("content_type", F.lit("text/html"))
    got = {r.url: (r.outcome, r.attempts, r.backoff_s) for r in W.fetch_outcome(log).collect()}
    assert got == {"ok1": ("ok", 1, 0), "s": ("ok", 3, 3), "t": ("ok", 2, 1), "n": ("failed", 1, 0),
                   "x": ("failed", 1, 0), "f5": ("failed", 5, 31), "to5": ("failed", 5, 15),
                   "mix": ("failed", 5, 15)}


def test_fetch_outcome_per_crawl(spark):
    log = spark.createDataFrame([("a", "u", 1, 404, None), ("b", "u", 1, 200, None)],
                                "crawl_id string, url string, attempt int, status int, error string") \
        .withColumn("content_type", F.lit("text/html"))
    got = {(r.crawl_id, r.outcome) for r in W.fetch_outcome(log, by=["crawl_id"]).collect()}
    assert got == {("a", "failed"), ("b", "ok")}


def test_fetch_outcome_incomplete_log(spark):
    log = spark.createDataFrame([("u", 1, 503, None), ("u", 2, 503, None)],
                                "url string, attempt int, status int, error string").withColumn("content_type", F.lit("x"))
    r = W.fetch_outcome(log).first()
    assert (r.outcome, r.attempts, r.backoff_s, r.content_type) == ("pending", 2, 3, "x")
