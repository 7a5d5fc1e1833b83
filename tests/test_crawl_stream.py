"""Replay crawl and streaming: fixture counts, batch-size independence, stream equals batch."""

import random
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sitegraph.operators import crawl as C
from sitegraph.operators import frontier as W
from sitegraph.plans import fixtures as FX
from sitegraph.session import checkpoint_dir
from sitegraph.streaming import crawl as SC
from sitegraph.streaming import discovery as SD
from sitegraph.streaming import retry as SR

SF = "/root/testdata/sf0.001"


def _inputs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    site, _ = FX.closed_site(pages)
    return FX.site_pages(pages, site), FX.roots(site).select("crawl_id", "url")


def test_replay_counts_match_fixture(spark):
    sp, starts = _inputs(spark)
    crawl = C.replay_crawl(spark, sp, starts).cache()
    assert crawl.where("fetched").count() == 41
    assert C.dead_links(crawl).count() == 221
    assert crawl.where("fetched").agg(F.max("depth")).first()[0] == 1
    assert crawl.groupBy("crawl_id", "url").count().where("count > 1").count() == 0


def test_batch_size_does_not_change_the_reached_set(spark):
    sp, starts = _inputs(spark)
    full = {(r.crawl_id, r.url) for r in C.replay_crawl(spark, sp, starts).collect()}
    for k in (1, 5):
        got = {(r.crawl_id, r.url) for r in C.replay_crawl(spark, sp, starts, batch_size=k).collect()}
        assert got == full


def test_many_small_rounds_find_the_best_first_order(spark):
    links = {"/": ["b", "a", "blog1"], "/blog1": ["blog2", "c"], "/a": ["d"], "/b": ["d"], "/c": ["e"], "/e": ["f"], "/f": ["g"]}
    html = [("c", f"http://h{u}", "".join(f'<a href="/{x}">' for x in to)) for u, to in links.items()]
    pages = spark.createDataFrame(html, "crawl_id string, url string, html string")
    starts = spark.createDataFrame([("c", "http://h/")], "crawl_id string, url string")
    got = C.replay_crawl(spark, pages, starts, weights=["/blog"], batch_size=1).collect()
    assert {(r.url[8:], r.depth, r.priority, (r.parent or "")[8:]) for r in got} == {
        ("/", 0, 0, ""), ("/a", 1, 1, "/"), ("/b", 1, 1, "/"), ("/blog1", 1, 0, "/"), ("/blog2", 2, 0, "/blog1"),
        ("/c", 2, 1, "/blog1"), ("/d", 2, 1, "/a"), ("/e", 3, 1, "/c"), ("/f", 4, 1, "/e"), ("/g", 5, 1, "/f")}
    assert {r.url[8:] for r in got if r.fetched} == set(links)
    with pytest.raises(ValueError):
        C.replay_crawl(spark, pages, starts, batch_size=1, resume_from=starts)
    with pytest.raises(ValueError):
        C.replay_crawl(spark, pages, starts, state_dir="x")


def test_best_first_stopped_after_any_round_and_continued(spark, tmp_path):
    links = {"/": ["b", "a", "blog1"], "/blog1": ["blog2", "c"], "/a": ["d"], "/b": ["d"], "/c": ["e"], "/e": ["f"]}
    html = [("c", f"http://h{u}", "".join(f'<a href="/{x}">' for x in to)) for u, to in links.items()]
    pages = spark.createDataFrame(html, "crawl_id string, url string, html string")
    starts = spark.createDataFrame([("c", "http://h/")], "crawl_id string, url string")

    def crawl(**kw):
        return C.replay_crawl(spark, pages, starts, weights=["/blog"], batch_size=2, **kw)

    full = sorted(map(tuple, crawl().collect()), key=repr)
    for stop in (0, 1, 3):
        state = str(tmp_path / f"state{stop}")
        part = crawl(max_rounds=stop, state_dir=state).collect()
        assert any(r.open for r in part) and len(part) < len(full)
        assert all(not r.open or r.url not in {q.parent for q in part} for r in part)
        # a round that broke off without its mark
        spark.createDataFrame([("c", "http://h/junk", 0, 0, None)], "crawl_id string, url string, priority int, depth int, parent string") \
            .write.parquet(f"{state}/found/round={stop + 1}")
        assert sorted(map(tuple, crawl(state_dir=state).collect()), key=repr) == full
        assert sorted(map(tuple, crawl(state_dir=state).collect()), key=repr) == full  # a finished crawl stays as it is
    stopped = crawl(max_rounds=1)
    assert not {r.url for r in C.dead_links(stopped).collect()} & {r.url for r in stopped.where("open").collect()}


def test_stream_crawl_restarted_after_a_failed_level(spark, tmp_path):
    sp, starts = _inputs(spark)
    links = C.page_links(sp, starts).cache()
    want = C.replay_crawl(spark, sp, starts).select("crawl_id", "url", "depth", "parent", "priority")
    found, ckpt = str(tmp_path / "found"), str(tmp_path / "checkpoint")
    SC.start_crawl(spark, links, starts, found, ckpt, available_now=True).awaitTermination()
    assert {r.level for r in SC.found(spark, found).select("level").distinct().collect()} == {-1, 0}
    broken = spark.createDataFrame([("c", "http://h/junk", 9, None, 0)], SC.FOUND)
    query = SC.start_crawl(spark, links, starts, found, ckpt)
    query.processAllAvailable()
    query.stop()
    got = SC.found(spark, found).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    last = SC.found(spark, found).agg(F.max("level")).first()[0]
    again, ckpt2 = str(tmp_path / "again"), str(tmp_path / "checkpoint2")
    SC.start_crawl(spark, links, starts, again, ckpt2, available_now=True).awaitTermination()
    broken.write.parquet(f"{again}/level=1")  # a first attempt at level 1 that never committed
    query = SC.start_crawl(spark, links, starts, again, ckpt2)
    query.processAllAvailable()
    query.stop()
    assert last >= 1 and SC.found(spark, again).where("url = 'http://h/junk'").count() == 0
    assert SC.found(spark, again).select(*want.columns).exceptAll(want).count() == 0


def test_failed_fetches_are_not_expanded_and_parents_follow_priority(spark):
    links = {"/": ["a", "z-blog", "x"], "/a": ["t"], "/z-blog": ["t"], "/x": ["y"]}
    html = [("c", f"http://h{u}", "".join(f'<a href="/{x}">' for x in to)) for u, to in links.items()]
    pages = spark.createDataFrame(html, "crawl_id string, url string, html string")
    starts = spark.createDataFrame([("c", "http://h/")], "crawl_id string, url string")
    outcomes = spark.createDataFrame([("http://h/x", "failed"), ("http://h/a", "ok")], "url string, outcome string")
    got = {r.url[8:]: ((r.parent or "")[8:], r.fetched)
           for r in C.replay_crawl(spark, pages, starts, weights=["blog"], outcomes=outcomes).collect()}
    assert got == {"/": ("", True), "/a": ("/", True), "/z-blog": ("/", True), "/x": ("/", False), "/t": ("/z-blog", False)}


def test_excluded_start_is_not_crawled(spark):
    sp, starts = _inputs(spark)
    one = starts.orderBy("url").limit(1).first().url
    out = C.replay_crawl(spark, sp, starts, excluded=[one])
    assert out.where(F.col("url") == one).count() == 0


def test_stream_discovery_equals_batch_and_survives_restart(spark):
    from sitegraph.plans.catalog import QUERIES

    streamed = QUERIES["stream_discovery"](spark, SF)
    batch = SD.discovered_links(spark.read.parquet(f"{SF}/pages.parquet")).select("crawl_id", "url")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_stream_discovery_streams_pages_of_any_id(spark, tmp_path):
    from sitegraph.plans.catalog import QUERIES

    ids = [0, 1, 2, 3, -1, -2, -3, -4, None]
    pages = [(i, f"https://h.org/p{k}", f'<a href="/l{k}">x</a>') for k, i in enumerate(ids)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.url for r in QUERIES["stream_discovery"](spark, str(tmp_path)).collect()}
    assert got == {f"https://h.org/l{k}" for k in range(len(ids))}


def test_stream_retry_equals_batch(spark):
    base = f"{checkpoint_dir(spark)}/t-retry-{uuid.uuid4().hex[:8]}"
    log = FX.fetch_log(spark.read.parquet(f"{SF}/pages.parquet"))
    for n in (3, 1, 5, 2, 4):  # attempts arrive out of order across micro-batches
        log.where(F.col("attempt") == n).write.mode("append").parquet(f"{base}/log")
    SR.start_retry_stream(spark, f"{base}/log", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1).awaitTermination()
    streamed = spark.read.schema(SR.OUT_SCHEMA).parquet(f"{base}/out")
    batch = W.fetch_outcome(log)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_interrupted_then_resumed_equals_uninterrupted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    site, _ = FX.closed_site(pages)
    sp, starts = FX.site_pages(pages, site), FX.roots(site).select("crawl_id", "url")
    full = C.replay_crawl(spark, sp, starts)
    part = C.replay_crawl(spark, sp, starts, max_rounds=2)
    assert part.agg(F.max("depth")).first()[0] == 2
    resumed = C.replay_crawl(spark, sp, starts, resume_from=part)
    cols = ["crawl_id", "url", "depth", "parent", "fetched"]
    assert full.select(cols).exceptAll(resumed.select(cols)).count() == 0
    assert resumed.select(cols).exceptAll(full.select(cols)).count() == 0


def test_stream_retry_per_crawl(spark):
    base = f"{checkpoint_dir(spark)}/t-retry-by-{uuid.uuid4().hex[:8]}"
    log = spark.createDataFrame([("a", "u", 1, 404, None, "x"), ("b", "u", 1, 503, None, "x"), ("b", "u", 2, 200, None, "x")],
                                "crawl_id string, url string, attempt int, status int, error string, content_type string")
    log.write.parquet(f"{base}/log")
    SR.start_retry_stream(spark, f"{base}/log", f"{base}/out", f"{base}/ckpt", by=["crawl_id"]).awaitTermination()
    got = {(r.crawl_id, r.outcome, r.attempts, r.backoff_s) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("a", "failed", 1, 0), ("b", "ok", 2, 1)}


def test_stream_discovery_into_state(spark):
    base = f"{checkpoint_dir(spark)}/t-state-{uuid.uuid4().hex[:8]}"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for part in range(2):
        pages.where(F.col("page_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{base}/pages")
        SD.start_discovery(spark, f"{base}/pages", "", f"{base}/ckpt", state_dir=f"{base}/state").awaitTermination()
    st = spark.read.parquet(f"{base}/state/url_state").select("crawl_id", "url", "path")
    batch = SD.discovered_links(pages).select("crawl_id", "url")
    assert st.where(F.col("path").isNotNull()).count() == 0
    assert st.select("crawl_id", "url").exceptAll(batch).count() == 0 and batch.exceptAll(st.select("crawl_id", "url")).count() == 0


LOG = "crawl_id string, url string, attempt int, status int, error string, content_type string"


def _retry_steps(spark, base, batches, **options):
    """One file a micro-batch; the stream is stopped and started again in between."""
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")
        SR.start_retry_stream(spark, f"{base}/log", f"{base}/out", f"{base}/ckpt", by=["crawl_id"], **options).awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{base}/out").select("crawl_id", "url", "outcome", "attempts", "backoff_s", "content_type").collect()]


def test_stream_retry_over_restarts_with_early_repeated_and_late_attempts(spark, tmp_path):
    batches = [
        [("a", "u", 3, 200, None, "x"), ("a", "u", 3, 503, None, "y"), ("a", "v", 5, None, "timeout", None),
         ("a", "v", 4, None, "payload", None), (None, "w", 1, 200, None, "n"), ("a", None, 1, 404, None, "m")],
        [("a", "u", 2, 500, None, "p"), ("a", "v", 1, 503, None, None), ("a", "v", 0, 200, None, "?"), ("a", "v", None, 200, None, "?")],
        [("a", "u", 1, 500, None, "q"), ("a", "v", 2, None, "timeout", None), ("a", "z", 1, None, "dns", None)],
        [("a", "u", 1, 200, None, "late"), ("a", "v", 3, 599, None, "r"), ("a", "v", 6, 200, None, "?"), ("b", "u", 2, 200, None, "early")],
        [("a", "u", 4, 200, None, "late"), ("a", "v", 5, 200, None, "repeated")],
    ]
    got = _retry_steps(spark, str(tmp_path), batches)
    # of the two third attempts at u in one micro-batch the smaller (kind, content type) counts: "ok" before "retry_server"
    assert sorted(got, key=repr) == sorted([
        ("a", "u", "ok", 3, 3, "x"), ("a", "v", "failed", 5, 15, None), (None, "w", "ok", 1, 0, "n"),
        ("a", None, "failed", 1, 0, "m"), ("a", "z", "failed", 1, 0, None)], key=repr)


def test_stream_retry_frees_the_state_of_finished_urls(spark, tmp_path):
    early = [("a", f"u{i}", n, 503, None, "x") for i in range(40) for n in (2, 3)]
    ends = [("a", f"u{i}", 1, 503, None, "x") for i in range(40)] + [("a", f"u{i}", 4, 200, None, "x") for i in range(30)]

    def state(name):
        frames = spark.read.format("statestore").option("path", f"{tmp_path}/ckpt").option("stateVarName", name)
        return frames.load().count()

    _retry_steps(spark, str(tmp_path), [early])
    assert (state("progress"), state("done")) == (40, 0)
    got = _retry_steps(spark, str(tmp_path), [ends])
    assert len(got) == 30 and {r[2:] for r in got} == {("ok", 4, 7, "x")}
    assert (state("progress"), state("done")) == (10, 30)  # the open URLs have used all early attempts
    assert state("early") == 0


def test_stream_retry_times(spark, tmp_path):
    with pytest.raises(ValueError):
        SR.start_retry_stream(spark, "x", "y", "z", stalled_after_s=1)
    import time

    spark.createDataFrame([("a", "stalls", 1, 503, None, "x"), ("a", "ends", 1, 200, None, "x")], LOG).write.parquet(f"{tmp_path}/log")
    query = SR.start_retry_stream(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/ckpt", available_now=False,
                                  by=["crawl_id"], stalled_after_s=2)
    want = {("ends", "ok", 1, 0), ("stalls", "pending", 1, 1)}
    try:
        for _ in range(60):
            time.sleep(1)
            if query.exception():
                raise query.exception()
            got = {(r.url, r.outcome, r.attempts, r.backoff_s) for r in
                   spark.read.schema(SR._with_keys(SR.OUT_SCHEMA, ["crawl_id"])).parquet(f"{tmp_path}/out").collect()} \
                if (tmp_path / "out" / "_spark_metadata").exists() else set()
            if got == want:
                break
    finally:
        query.stop()
    assert got == want


def _queue(links, start, priority, k):
    """The bounded queue itself: found URLs with depth, priority and parent, and the number of rounds."""
    found, popped, n = {start: (0, 0, None)}, set(), 0
    while batch := sorted((p, d, u) for u, (d, p, _) in found.items() if u not in popped)[:k]:
        n += 1
        popped.update(u for *_, u in batch)
        new = {}
        for p, d, u in batch:
            for v in links.get(u, ()):
                if v not in found:
                    new[v] = min(new.get(v, (d, p, u)), (d, p, u))
        found.update({v: (d + 1, priority(v), u) for v, (d, _, u) in new.items()})
    return found, n


def test_steps_of_many_rounds_equal_the_queue_round_by_round(spark, monkeypatch):
    rnd = random.Random(5)
    names = [f"http://h/{rnd.choice(['', '', 'blog', 'top'])}{i}" for i in range(110)]
    links = {u: rnd.sample(names, rnd.choice([1, 2, 3, 9])) for u in rnd.sample(names, 90)}
    links[names[0]] = rnd.sample(names, 12)
    pages = spark.createDataFrame([(c, u, "".join(f'<a href="{v}">' for v in to)) for c in ("c", "d") for u, to in links.items()],
                                  "crawl_id string, url string, html string")
    starts = [("c", names[0]), ("d", next(u for u in links if u != names[0]))]
    priority = lambda u: 0 if "top" in u else 1 if "blog" in u else 2
    edges = C.page_links(pages, spark.createDataFrame(starts, "crawl_id string, url string"), ["top", "blog"]).cache()
    seeds = spark.createDataFrame(starts, "crawl_id string, url string")
    jobs = []
    for k, size in ((3, {}), (12, {"entries": 14, "links_most": 20})):
        steps = []
        monkeypatch.setattr(C, "_pop_rounds", lambda *a, pop=C._pop_rounds, steps=steps: steps.append(a) or pop(*a))
        got, open_ = C._best_first(spark, edges, seeds, k, **size)
        monkeypatch.undo()
        rounds = 0
        for crawl, start in starts:
            want, n = _queue(links, start, priority, k)
            rounds = max(rounds, n)
            rows = {r.url: (r.depth, r.priority, r.parent) for r in got.where(F.col("crawl_id") == crawl).collect()}
            assert rows == want
        assert open_.count() == 0
        jobs.append((rounds, len(steps)))
    assert jobs[0][0] > 25 and jobs[0][1] < 8 and all(steps <= rounds for rounds, steps in jobs)


def test_stream_discovery_micro_batches_do_not_follow_the_number_of_files(spark, tmp_path, monkeypatch):
    from sitegraph.plans.catalog import QUERIES

    pages = [(i, f"https://h.org/p{i}", f'<a href="/l{i % 30}">x</a>') for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    started = []
    monkeypatch.setattr(SD, "start_discovery", lambda *a, start=SD.start_discovery, **kw: started.append(start(*a, **kw)) or started[-1])
    got = sorted(r.url for r in QUERIES["stream_discovery"](spark, str(tmp_path)).collect())
    assert got == sorted(f"https://h.org/l{i}" for i in range(30))
    read = [p.batchId for q in started for p in q.recentProgress if p.numInputRows]
    assert len(started) > 1 and sorted(set(read)) == [0, 1, 2, 3]


def test_stream_retry_micro_batches_do_not_follow_the_number_of_files(spark, tmp_path, monkeypatch):
    from sitegraph.plans.catalog import QUERIES

    pages = [(i, f"https://h.org/p{i}", "") for i in range(48)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    started = []
    monkeypatch.setattr(SR, "start_retry_stream", lambda *a, start=SR.start_retry_stream, **kw: started.append(start(*a, **kw)) or started[-1])
    got = QUERIES["stream_retry"](spark, str(tmp_path))
    want = QUERIES["fetch_outcome"](spark, str(tmp_path))
    assert want.count() == 48 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    read = [(p.batchId, p.numInputRows) for q in started for p in q.recentProgress if p.numInputRows]
    assert read == [(n, 48) for n in range(5)]  # the five attempt numbers, one after the other


def test_stream_retry_keeps_many_urls_of_a_bucket_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SR, "BUCKETS", 1)
    ended = [("a", f"u{i}", 1, 200, None, "x") for i in range(60)] + [("b", f"u{i}", n, 503, None, "x") for i in range(60) for n in (2, 4)]
    # few rows against a bucket that holds many: late, early, next and new
    few = [("a", "u1", 1, 404, None, "late"), ("b", "u1", 1, 503, None, "y"), ("b", "u2", 3, 200, None, "z"), ("c", "u1", 1, 404, None, "x")]
    rest = [("b", f"u{i}", n, 503 if n == 1 else 200, None, "y") for i in range(60) for n in (1, 3)]
    got = _retry_steps(spark, str(tmp_path), [ended, few, rest])
    assert sorted(got) == sorted([("a", f"u{i}", "ok", 1, 0, "x") for i in range(60)] + [("c", "u1", "failed", 1, 0, "x")]
                                 + [("b", f"u{i}", "ok", 3, 3, "z" if i == 2 else "y") for i in range(60)])


class _State:
    """The state of one bucket, as a processor's handle gives it; it counts the calls."""

    def __init__(self):
        self.maps, self.calls, self.timers = {}, 0, set()

    def getMapState(self, name, *schemas):
        return self.getValueState(name)

    def getValueState(self, name, *schema):
        held = self.maps.setdefault(name, {})

        def counted(f):
            def call(*a):
                self.calls += 1
                return f(*a)
            return staticmethod(call)

        class Variable:
            get = counted(lambda: held.get(None))
            update = counted(lambda v: held.update({None: v}))
            getValue = counted(held.__getitem__)
            containsKey = counted(held.__contains__)
            updateValue = counted(lambda k, v: held.update({k: v}))
            removeKey = counted(held.__delitem__)
            iterator = counted(lambda: iter([*held.items()]))
            keys = counted(lambda: iter([*held]))
        return Variable

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def _loop(**options):
    loop, state = SR.RetryLoop(["url"], **options), _State()
    loop.init(state)
    return loop, state


def _tries(*rows):
    return iter([Row(url=u, attempt=n, kind=kind, content_type=ct) for u, n, kind, ct in rows])


def test_retry_loop_asks_for_the_state_of_a_buckets_urls_together():
    loop, state = _loop()
    urls = [f"u{i}" for i in range(500)]
    assert len([*loop.handleInputRows((0,), _tries(*((u, 1, "ok", "x") for u in urls)), None)]) == 500
    state.calls = 0
    assert not [*loop.handleInputRows((0,), _tries(*((u, 2, "ok", "x") for u in urls)), None)]
    assert state.calls < 10  # not one or more a URL
    state.calls = 0
    assert not [*loop.handleInputRows((0,), _tries(("u7", 2, "ok", "x")), None)]
    assert state.calls < 10 and state.maps["held"][None] == (0, 0, 500)


def test_retry_loop_equals_the_loop_of_each_url():
    rnd = random.Random(11)
    kinds = ["ok", "fail", "retry_server", "retry_network", "retry_server", "retry_network"]
    for most in (1, 3, 40):  # rows a micro-batch: by lookups and by passes
        loop, state = _loop()
        rows = [(f"u{rnd.randrange(60)}", rnd.randrange(1, 6), rnd.choice(kinds), rnd.choice(["x", "y", None])) for _ in range(700)]
        got, first = [], {}
        while rows:
            batch, rows = rows[:(k := rnd.randint(1, most))], rows[k:]
            got += [tuple(r) for r in loop.handleInputRows((0,), _tries(*batch), None)]
            now = {}
            for u, n, *t in batch:
                now[u, n] = min(now.get((u, n), tuple(t)), tuple(t), key=SR._order)
            first = now | first
        want, open_, early = [], 0, 0
        for u in {u for u, _ in first}:
            n, backoff = 1, 0
            while (u, n) in first:
                kind, ct = first[u, n]
                backoff += 2 ** (n - 1) if kind == "retry_server" or kind == "retry_network" and n < 5 else 0
                if kind in ("ok", "fail") or n == 5:
                    want.append((u, "ok" if kind == "ok" else "failed", n, backoff, ct))
                    break
                n += 1
            else:
                open_ += 1
                early += sum((u, k) in first for k in range(n + 1, 6))
        assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 20
        held = tuple(len(state.maps[x]) for x in ("progress", "early", "done"))
        assert held == state.maps["held"][None] == (open_, early, len(want))


def test_retry_loop_ends_stalled_urls_of_a_bucket_at_their_own_times():
    loop, state = _loop(stalled_after_s=10)
    take = lambda ms, *rows: [tuple(r) for r in loop.handleInputRows((0,), _tries(*rows), _Now(ms))]

    def fire(ms):
        due = {t for t in state.timers if t <= ms}
        out = [tuple(r) for t in sorted(due) for r in loop.handleExpiredTimer((0,), _Now(ms), t)]
        state.timers -= due
        return out

    assert not take(0, ("a", 1, "retry_server", "x"), ("b", 1, "retry_server", "x"), ("b", 4, "ok", "x"))
    assert not take(4000, ("c", 1, "retry_network", "y"))
    assert not take(6000, ("a", 2, "retry_server", "z"))
    assert state.timers == {10000}
    assert fire(10000) == [("b", "pending", 1, 1, "x")] and state.timers == {14000} and not state.maps["early"]
    assert not take(11000, ("b", 2, "ok", "late"))
    assert fire(14000) == [("c", "pending", 1, 1, "y")] and state.timers == {16000}
    assert take(15000, ("a", 3, "ok", "w")) == [("a", "ok", 3, 3, "w")]
    assert not fire(16000) and not state.timers and state.maps["held"][None] == (0, 0, 3)
