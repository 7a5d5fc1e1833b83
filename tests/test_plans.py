"""Scale properties checked on plans: hot keys spread, partial aggregation, no HTML in shuffles."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitegraph.plans.mirror_job import site_resources
from sitegraph.operators import frontier as W
from sitegraph.operators import graph as G
from sitegraph.operators import links as X
from sitegraph.operators import state as S


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_hot_crawl_is_spread_by_rank_within(spark):
    # one crawl holds ~90% of the rows
    rows = [("hot" if i % 10 else f"c{i}", f"u{i:05d}", i % 7, 1) for i in range(5000)]
    f = spark.createDataFrame(rows, "crawl_id string, url string, priority int, depth int")
    keys = ["crawl_id", "priority", "depth", "url"]
    spread = f.repartitionByRange(8, *keys).where(F.col("crawl_id") == "hot") \
        .select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1
    ranked = W.frontier_rank(f).where(F.col("crawl_id") == "hot")
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 4501))


def test_rank_within_equals_a_plain_window_with_extra_columns(spark):
    # 600,000 rows, a crawl with a third of them, null groups and ties, and columns beyond the sort keys
    n = F.col("id")
    f = spark.range(600_000).select(
        F.when(n % 3 == 0, F.lit("hot")).when(n % 101 == 1, None).otherwise(F.concat(F.lit("c"), n % 50)).alias("crawl_id"),
        F.concat(F.lit("u"), n.cast("string")).alias("url"), (F.xxhash64(n) % 7).alias("priority"), (n % 4).alias("depth"),
        F.concat(F.lit("tag"), n % 5).alias("tag"), F.sha2(n.cast("string"), 256).alias("attr"))
    ranked = W.frontier_rank(f)
    w = Window.partitionBy("crawl_id").orderBy("priority", "depth", "url")
    plain = f.withColumn("want", F.row_number().over(w)).select("url", "want")
    both = ranked.join(plain, "url", "full")
    got = both.agg(F.count("rank"), F.count("want"), F.count(F.when(F.col("rank") != F.col("want"), 1))).first()
    assert tuple(got) == (600_000, 600_000, 0)
    assert ranked.columns == [*f.columns, "rank"]


def test_partial_aggregation_before_the_shuffle(spark):
    links = spark.createDataFrame([("c", f"u{i % 3}", i, 0) for i in range(100)],
                                  "crawl_id string, url string, page_id int, pos int")
    plan = _plan(S.first_seen(links))
    assert "partial_min" in plan
    st = spark.createDataFrame([("c", "u", None)], "crawl_id string, url string, path string")
    assert "partial_count" in _plan(S.crawl_summary(st, st.select("crawl_id", "url")))


def test_top_k_is_limited_before_the_exchange(spark):
    f = spark.createDataFrame([("c", f"u{i}", i % 3, 1) for i in range(100)],
                              "crawl_id string, url string, priority int, depth int")
    tree = _plan(W.frontier_batch(f, 5)).split("\n\n", 1)[0]
    lines = [ln.strip(" :+-|") for ln in tree.splitlines()]
    first_exchange = next(i for i, ln in enumerate(lines) if ln.startswith("Exchange"))
    assert any(ln.startswith("WindowGroupLimit") for ln in lines[first_exchange + 1:])


def test_html_never_enters_a_shuffle_after_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")  # read as is: no balancing exchange
    links = X.extract_links(pages)
    edges = G.link_edges(links)
    plan = _plan(edges)
    exchanges = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert exchanges and all("html" not in cols for cols in exchanges)


def test_bfs_edges_keep_their_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = spark.createDataFrame([("c", f"u{i}", f"u{(i * 7) % 50}") for i in range(50)],
                                    "crawl_id string, src string, dst string")
        e = G.materialize(G.partitioned(raw, "crawl_id", "src"), keep_partitioning=True)  # as in bfs()
        level = spark.createDataFrame([("c", "u0", "u0")], "crawl_id string, start string, url string")
        step = level.select("crawl_id", "start", F.col("url").alias("src")).join(e, ["crawl_id", "src"])
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = _plan(step).split("\n\n", 1)[0]
        # exactly one exchange: the level's; the checkpointed edges are read in place
        assert plan.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_mirror_moves_the_html_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(c, f"https://{c}.com/{p}", f'<a href="/{p}x">l</a><img src="https://cdn.org/{p}.png">', "text/html", None)
                for c in ("a", "b") for p in ("", "x", "xx")]
        captured = spark.createDataFrame(rows, "crawl_id string, url string, html string, content_type string, body binary")
        starts = spark.createDataFrame([(c, f"https://{c}.com/") for c in ("a", "b")], "crawl_id string, url string")
        for pages in (None, captured.drop("crawl_id")):
            _, resources = site_resources(spark, captured, starts, pages=pages)
            plan = _plan(resources)
            moved = [cols for cols in re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan) if re.search(r"\bhtml#|_one#|body#", cols)]
            assert len(moved) == (1 if pages is None else 2), moved  # and the captures of images once
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
