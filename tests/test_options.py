"""Options beyond the original's defaults: resume modes, byte limits, fragments, mirror sink, duplicates."""

import uuid

from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import frontier as W
from sitegraph.operators import layout as K
from sitegraph.operators import links as X
from sitegraph.operators import state as S
from sitegraph.session import checkpoint_dir


def test_resume_modes(spark):
    st = spark.createDataFrame([("c", "https://a/x", None), ("c", "https://a/y", "a/y.html")],
                               "crawl_id string, url string, path string")
    done = spark.createDataFrame([("c", "https://a/y")], "crawl_id string, url string")
    starts = spark.createDataFrame([("c", "https://a/")], "crawl_id string, url string")
    retry = {(r.url, r.depth) for r in S.resume_frontier(st, done, starts).collect()}
    assert retry == {("https://a/x", 0), ("https://a/", 0)}
    again = {r.url for r in S.resume_frontier(st, done, starts, mode="refetch_all").collect()}
    assert again == {"https://a/x", "https://a/y", "https://a/"}


def test_name_limit_in_bytes(spark):
    name = "é" * 200  # 200 characters, 400 bytes
    df = spark.createDataFrame([(f"http://ex.com/{name}",)], "u string")
    chars, nbytes = df.select(U.local_path("u"), U.local_path("u", name_unit="bytes")).first()
    assert chars == f"ex.com/{name}.html"
    assert nbytes.startswith("ex.com/") and len(nbytes) == len("ex.com/") + 32 + len(".html")


def test_keep_fragment(spark):
    pages = spark.createDataFrame([(1, "http://ex.com/a/", "<a href='b#sec'>x</a><a href='#top'>t</a>")],
                                  "page_id long, url string, html string")
    plain = [r.new_href for r in X.link_map(pages).orderBy("pos").collect()]
    kept = [r.new_href for r in X.link_map(pages, keep_fragment=True).orderBy("pos").collect()]
    assert plain == ["b.html", "index.html"] and kept == ["b.html#sec", "index.html#top"]
    html = X.rewrite_html(pages, keep_fragment=True).first().html
    assert "href=\"b.html#sec\"" in html and "href=\"index.html#top\"" in html


def test_write_mirror_first_writer_wins(spark):
    res = spark.createDataFrame(
        [("c", 1, "http://ex.com/p", "<p>1</p>"), ("c", 2, "http://ex.com/p#x", "<p>2</p>"),
         ("c", 3, "http://ex.com/q.css", "q{}")], "crawl_id string, seq int, url string, html string")
    out = f"{checkpoint_dir(spark)}/mirror-{uuid.uuid4().hex[:8]}"
    man = K.write_mirror(res, out, order=["seq"])
    assert {(r.url, r.written) for r in man.collect()} == {
        ("http://ex.com/p", True), ("http://ex.com/p#x", False), ("http://ex.com/q.css", True)}
    files = {r.path: r.content for r in spark.read.parquet(out).collect()}
    assert files == {"ex.com/p.html": "<p>1</p>", "ex.com/q.css": "q{}"}


def test_fetch_outcome_duplicate_attempts_stay_bounded(spark):
    log = spark.createDataFrame([("u", 1, 503, None), ("u", 1, 503, None), ("u", 2, 200, None)] * 50,
                                "url string, attempt int, status int, error string").withColumn("content_type", F.lit("x"))
    assert [(r.outcome, r.attempts, r.backoff_s) for r in W.fetch_outcome(log).collect()] == [("ok", 2, 1)]


def test_per_crawl_knobs(spark):
    df = spark.createDataFrame([("http://a.com/x/blog", ["blog", "x"], ["zzz"]), ("http://a.com/q", [], ["/q"]),
                                ("http://a.com/x", None, None)], "u string, w array<string>, e array<string>")
    got = [(r.p, r.x) for r in df.select(U.url_priority_by("u", "w").alias("p"),
                                         U.is_excluded_by("u", "e").alias("x")).collect()]
    assert got == [(0, False), (0, True), (0, False)]


def test_fetched_offdomain_images_rewritten(spark):
    pages = spark.createDataFrame([(1, "http://ex.com/a/", "<img src='http://cdn.org/i.png'><img src='http://cdn.org/j.png'>")],
                                  "page_id long, url string, html string")
    ok = spark.createDataFrame([("http://cdn.org/i.png",)], "url string")
    got = [r.new_href for r in X.link_map(pages, fetched_images=ok).orderBy("pos").collect()]
    assert got == ["../../cdn.org/i.png", "http://cdn.org/j.png"]


def test_missing_snapshot_loads_empty(spark):
    st, done = S.load_state(spark, f"{checkpoint_dir(spark)}/no-such-snapshot-{uuid.uuid4().hex[:6]}")
    assert st.count() == 0 and done.count() == 0 and st.columns == ["crawl_id", "url", "path"]


def test_processing_time_cadence(spark):
    from sitegraph.streaming import discovery as SD

    base = f"{checkpoint_dir(spark)}/cadence-{uuid.uuid4().hex[:8]}"
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").write.parquet(f"{base}/pages")
    q = SD.start_discovery(spark, f"{base}/pages", f"{base}/links", f"{base}/ckpt", available_now=False,
                           processing_time="1 second", max_files_per_trigger=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{base}/links").count() == 279


def test_mirror_renames_conflicts_and_quarantines(spark):
    res = spark.createDataFrame(
        [("c", 1, "http://ex.com/d.", "file"), ("c", 2, "http://ex.com/d./x", "child"),
         ("c", 3, "http://ex.com/../../etc/e", "bad")], "crawl_id string, seq int, url string, html string")
    out = f"{checkpoint_dir(spark)}/mirror-{uuid.uuid4().hex[:8]}"
    man = {r.url: (r.final_path, r.renamed, r.unsafe) for r in K.write_mirror(res, out, order=["seq"]).collect()}
    renamed = man["http://ex.com/d."][0]
    assert man["http://ex.com/d."][1] and renamed.startswith("ex.com/d._") and man["http://ex.com/../../etc/e"][2]
    files = {r.path: r.content for r in spark.read.parquet(out).collect()}
    assert files == {renamed: "file", "ex.com/d./x.html": "child"}


def test_strip_fragment_and_script_rule_option(spark):
    pages = spark.createDataFrame([(1, "http://ex.com/", "<a href='/a#x'>1</a><a href='/a#y'>2</a><a href='http://o.org/p.php'>3</a>")],
                                  "page_id long, url string, html string")
    assert {r.url for r in X.extract_links(pages, domain="ex.com", strip_fragment=True).collect()} == {"http://ex.com/a"}
    plain = [r.new_href for r in X.link_map(pages).orderBy("pos").collect()]
    ruled = [r.new_href for r in X.link_map(pages, script_rule=True).orderBy("pos").collect()]
    assert plain[2] == "http://o.org/p.php" and ruled[2] == "http://o.org/p.html"


def test_rewrite_fetched_offdomain_images(spark):
    pages = spark.createDataFrame(
        [(1, "http://ex.com/a/", "<img src='http://cdn.org/i.png'><img src='http://cdn.org/j.png'>", ["http://cdn.org/i.png"])],
        "page_id long, url string, html string, imgs array<string>")
    html = X.rewrite_html(pages, fetched_images="imgs").first().html
    assert html == "<img src=\"../../cdn.org/i.png\"><img src='http://cdn.org/j.png'>"
