"""The command-line job: mirror two sites from the captured pages, then resume."""

import uuid

from pyspark.sql import functions as F

from sitegraph.plans import fixtures as FX
from sitegraph.plans.mirror_job import assign_pages, run_mirror
from sitegraph.session import checkpoint_dir


def _exists(spark, path):
    try:
        spark.read.parquet(path).limit(0).collect()
        return True
    except Exception:  # noqa: BLE001
        return False


def test_run_mirror_then_gate_and_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    site, _ = FX.closed_site(pages)
    captured = FX.site_pages(pages, site).select("url", "html")
    roots = [r.url for r in FX.roots(site).orderBy("url").limit(2).collect()]
    out = f"{checkpoint_dir(spark)}/mirror-job-{uuid.uuid4().hex[:8]}"
    s1 = {r.crawl_id: r for r in run_mirror(spark, captured, roots, out, connections=5).collect()}
    assert len(s1) == 2 and all(r.visited >= 1 and r.completed >= 1 for r in s1.values())
    files = spark.read.parquet(f"{out}/mirror/v=1")
    assert files.count() == sum(r.completed for r in s1.values())
    assert files.where(F.col("path").endswith("index.html")).count() == 2
    # every crawl finished (failures counted apart), so a second run does nothing new ...
    assert all(r.complete for r in s1.values())
    s2 = {r.crawl_id: r for r in run_mirror(spark, captured, roots, out, connections=5).collect()}
    assert s2 == s1
    assert spark.read.parquet(f"{out}/mirror/v=2").count() == 0 if _exists(spark, f"{out}/mirror/v=2") else True
    # ... unless forced
    s3 = {r.crawl_id: r for r in run_mirror(spark, captured, roots, out, connections=5, force=True).collect()}
    assert {k: (r.visited, r.completed) for k, r in s3.items()} == {k: (r.visited, r.completed) for k, r in s1.items()}


def _pages(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, content_type string, body binary")


def test_mirror_rewrites_fetches_images_and_saves_only_what_was_pending(spark):
    root = "https://ex.com/"
    html = ('<a href="/a">a</a><a href="/gone?x=1">g</a><img src="https://cdn.org/i.png"><img src="https://cdn.org/no.png">'
            '<link href="/s.css"><img src="/own.png">')
    first = [(root, html, "text/html; charset=utf-8", None), ("https://ex.com/a", '<a href="/">up</a>', "text/html", None),
             ("https://ex.com/s.css", "a{}<a href='/not-a-link'>", "text/css", None),
             ("https://ex.com/own.png", None, "image/png", b"\x89own"), ("https://cdn.org/i.png", None, "image/png", b"\x89cdn"),
             ("https://other.org/", '<a href="/z">z</a>', "text/html", None)]
    out = f"{checkpoint_dir(spark)}/mirror-job-{uuid.uuid4().hex[:8]}"
    s1 = run_mirror(spark, _pages(spark, first), [root], out).first()
    files = {r.url: r for r in spark.read.parquet(f"{out}/mirror/v=1").collect()}
    assert set(files) == {root, "https://ex.com/a", "https://ex.com/s.css", "https://ex.com/own.png", "https://cdn.org/i.png"}
    saved = files[root]
    assert saved.path == "ex.com/index.html" and '<a href="a.html">' in saved.content
    assert '<img src="../cdn.org/i.png">' in saved.content and '<img src="https://cdn.org/no.png">' in saved.content
    assert files["https://ex.com/s.css"].mode == "text" or files["https://ex.com/s.css"].kind == "text/html"
    own = files["https://ex.com/own.png"]
    assert own.mode == "binary" and bytes(own.body) == b"\x89own" and own.content is None
    assert s1.failed >= 1 and s1.complete
    # the missing page is captured now; a forced run saves it and what it leads to, nothing else
    more = [*first, ("https://ex.com/gone?x=1", '<a href="/new">n</a>', "text/html", None),
            ("https://ex.com/new", "new", "text/html", None)]
    run_mirror(spark, _pages(spark, more), [root], out, force=True)
    second = {r.url for r in spark.read.parquet(f"{out}/mirror/v=2").select("url").collect()}
    assert second == {"https://ex.com/gone?x=1", "https://ex.com/new"}


def test_pages_are_assigned_without_a_join(spark):
    pages = _pages(spark, [("https://ex.com/a", "x", None, None), ("https://b.org/", "y", None, None)])
    got = assign_pages(pages, ["https://ex.com/", "https://b.org/", "https://ex.com/a"])
    assert sorted(r.url for r in got.collect()) == ["https://b.org/", "https://ex.com/a", "https://ex.com/a"]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert assign_pages(pages, []).count() == 0


def test_a_later_run_never_writes_a_file_of_an_earlier_one(spark):
    root = "https://ex.com/"
    first = [(root, '<a href="/a">a</a><a href="/a.html">late</a><a href="/n">n</a>', "text/html", None),
             ("https://ex.com/a", "first a", "text/html", None)]
    later = [*first, ("https://ex.com/a.html", "other a", "text/html", None), ("https://ex.com/n", "new", "text/html", None),
             ("https://ex.com/n.html", "unlinked", "text/html", None)]
    out = f"{checkpoint_dir(spark)}/mirror-job-{uuid.uuid4().hex[:8]}"
    s1 = run_mirror(spark, _pages(spark, first), [root], out).first()
    assert (s1.visited, s1.completed, s1.pending, s1.failed) == (4, 2, 2, 2)
    s2 = run_mirror(spark, _pages(spark, later), [root], out, force=True).first()
    assert (s2.visited, s2.completed, s2.pending, s2.complete) == (4, 4, 0, True)
    assert {r.url: r.path for r in spark.read.parquet(f"{out}/mirror/v=2").collect()} == {"https://ex.com/n": "ex.com/n.html"}
    m = {r.url: r for r in spark.read.parquet(f"{out}/manifest/v=2").collect()}
    assert not m["https://ex.com/a.html"].written and m["https://ex.com/a.html"].writer_url == "https://ex.com/a"
    state = {r.url: r.path for r in spark.read.parquet(f"{out}/state/url_state/v=2").collect()}
    assert state["https://ex.com/a.html"] == state["https://ex.com/a"] == "ex.com/a.html"


def test_urls_of_one_file_in_one_run_are_all_complete(spark):
    root = "https://ex.com/"
    pages = [(root, '<a href="/a">a</a><a href="/a.html">b</a>', "text/html", None), ("https://ex.com/a", "1", "text/html", None),
             ("https://ex.com/a.html", "2", "text/html", None)]
    out = f"{checkpoint_dir(spark)}/mirror-job-{uuid.uuid4().hex[:8]}"
    s = run_mirror(spark, _pages(spark, pages), [root], out).first()
    assert (s.completed, s.pending, s.complete) == (3, 0, True)
    assert spark.read.parquet(f"{out}/mirror/v=1").count() == 2
