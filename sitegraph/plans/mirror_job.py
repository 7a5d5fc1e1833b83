"""The crawler's command line as a Spark job: mirror sites from captured pages.

    spark-submit --py-files sitegraph.zip sitegraph/plans/mirror_job.py URL [URL ...] --pages PAGES --out DIR
        [-c CONNECTIONS] [-w WEIGHT ...] [-v EXCLUDE ...] [-f]

keyed by the SHA-256 of the URL), ``-c`` is the number of pages each crawl
pops per round, best-first (without it a crawl pops whole link levels, the mode
for large sites), ``-w`` the priority strings, ``-v`` the exclusions, ``-f``
re-runs a crawl whose summary says complete. A run saves only URLs that are not
completed yet. ``DIR`` receives versioned ``mirror/``, ``manifest/``, ``state/``
(url_state and completed) and ``summary/`` tables, clustered by crawl.
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegraph.functions import urls as U
from sitegraph.operators import crawl as C
from sitegraph.operators import layout as K
from sitegraph.operators import links as X
from sitegraph.operators import state as S
from sitegraph.operators.graph import materialize
from sitegraph.session import checkpoint_dir

KEY = ["crawl_id", "url"]
LAST = 2**31 - 1  # depth and priority of images outside the domain: after every crawled page


def assign_pages(pages: DataFrame, start_urls: Sequence[str]) -> DataFrame:
    """Captured pages of each crawl: pages whose URL holds the crawl's domain (the original's rule).

    The starts come from a command line, which bounds their number; they enter
    the plan as constants, so the page table streams through once without a
    join. Adds ``crawl_id``; a page inside several crawls gives a row for each.
    """
    starts = [F.struct(U.crawl_key(F.lit(u)).alias("crawl_id"), U.url_netloc(F.lit(u)).alias("domain")) for u in start_urls]
    if not starts:
        return pages.withColumn("crawl_id", F.lit("")).limit(0)
    mine = F.filter(F.array(*starts), lambda s: F.col("url").contains(s["domain"]))
    return pages.select(F.explode(F.transform(mine, lambda s: s["crawl_id"])).alias("crawl_id"), *pages.columns)


def with_kinds(pages: DataFrame) -> DataFrame:
    """``url, html, content_type, body``: a missing type counts as HTML, a missing body as null."""
    have = pages.columns
    return pages.select(
        "url", "html",
        F.coalesce(F.col("content_type"), F.lit("text/html")).alias("content_type") if "content_type" in have
        else F.lit("text/html").alias("content_type"),
        (F.col("body") if "body" in have else F.lit(None)).cast("binary").alias("body"))


def _one_capture(captures: DataFrame, *carry: str) -> DataFrame:
    """One row per key: the capture whose content has the least hash; further columns are equal in all captures of a key."""
    content = ["html", "content_type", "body"]
    rest = [c for c in carry if c != "crawl_id"]
    one = captures.groupBy(*KEY).agg(F.min_by(F.struct(*content, *rest), F.struct(F.xxhash64(*content), F.length("html"))).alias("_one"))
    return one.select(*KEY, *[F.col(f"_one.{c}").alias(c) for c in (*content, *rest)])


def site_resources(spark: SparkSession, captured: DataFrame, starts: DataFrame, weights: Sequence[str] = (),
                   excluded: Sequence[str] = (), batch_size: int | None = None, pages: DataFrame | None = None,
                   completed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(crawl, resources)``: what each crawl reaches, and the content a mirror saves of it.

    ``captured(crawl_id, url, html, content_type, body)`` are the crawls' pages;
    only those of an HTML type are parsed. HTML is rewritten: links inside the
    domain point at the local copies (X4). ``pages`` (every captured URL) serves
    images outside the domain (X2, X3): those captured are saved, and their
    tags point at the copies, too. URLs in ``completed`` are not saved again.

    All that is known of a URL (order, domain, images) is joined by keys first;
    then the captures meet it, which moves their HTML once. Of several captures
    of a URL that counts whose content has the least hash.
    """
    _, is_html, _ = U.content_kind(F.col("content_type"), F.col("url"))
    html_pages = captured.where(is_html)
    dom = starts.select("crawl_id", U.url_netloc(F.col("url")).alias("domain"))
    crawl = C.replay_crawl(spark, html_pages, starts, weights, excluded, batch_size=batch_size, content=captured)
    crawl = materialize(crawl)
    save = crawl.where(F.col("fetched")).select(*KEY, "depth", "priority")
    if completed is not None:
        save = save.join(completed.select(*KEY), KEY, "left_anti")
    save = save.join(dom, "crawl_id")
    if pages is not None:
        images = X.extract_images(html_pages, keep=("crawl_id",)).join(dom, "crawl_id")
        images = X.image_routing(images, F.col("domain"), excluded).where(F.col("route") == "image").select(
            "crawl_id", "page_url", "url").distinct()
        mine = images.join(save.select("crawl_id", F.col("url").alias("page_url")), ["crawl_id", "page_url"], "left_semi")
        got = mine.join(pages.select("url").distinct(), "url", "left_semi")
        per_page = got.groupBy("crawl_id", F.col("page_url").alias("url")).agg(F.collect_set(F.col("url")).alias("_imgs"))
        wanted = got.select(*KEY).distinct()
        if completed is not None:
            wanted = wanted.join(completed.select(*KEY), KEY, "left_anti")
        wanted = wanted.join(save.select(*KEY), KEY, "left_anti")
        outside = _one_capture(pages.join(wanted, "url"), "crawl_id").select(
            *KEY, F.lit(LAST).alias("depth"), F.lit(LAST).alias("priority"), "html", "content_type", "body")
        save = save.join(per_page, KEY, "left").withColumn("_imgs", F.coalesce("_imgs", F.array().cast("array<string>")))
    known = _one_capture(captured.join(save, KEY), "crawl_id", *[c for c in save.columns if c not in KEY]).withColumn("_raw", F.col("html"))
    html = is_html & F.col("html").isNotNull()
    rewritten = X.rewrite_html(known, F.col("domain"), fetched_images="_imgs" if pages is not None else None)
    cols = [*KEY, "depth", "priority", F.when(html, F.col("html")).otherwise(F.col("_raw")).alias("html"), "content_type", "body"]
    resources = rewritten.select(*cols)
    return crawl, resources.unionByName(outside) if pages is not None else resources


def _latest(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """Newest snapshot of a versioned table (``path/v=<n>/...``) and its version; empty and 0 if none."""
    df = S.load_table(spark, path, T.StructType([*schema.fields, T.StructField("v", T.IntegerType())]))
    n = df.agg(F.max("v")).first()[0] or 0
    return df.where(F.col("v") == n).drop("v"), n


def _append_version(df: DataFrame, path: str, n: int, keys: Sequence[str] = KEY) -> None:
    S.clustered(df, *keys).write.mode("append").parquet(f"{path}/v={n}")


SUMMARY_SCHEMA = T.StructType([T.StructField("crawl_id", T.StringType()), T.StructField("complete", T.BooleanType())])
MANIFEST_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("crawl_id", "url", "path")],
    T.StructField("written", T.BooleanType()), T.StructField("unsafe", T.BooleanType()),
])
SUMMARY_FULL_SCHEMA = T.StructType([
    T.StructField("crawl_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in
                                                ("visited", "completed", "pending", "failed")],
    T.StructField("complete", T.BooleanType()),
])


def run_mirror(spark: SparkSession, pages: DataFrame, start_urls: Sequence[str], out_dir: str,
               connections: int | None = None, weights: Sequence[str] = (), excluded: Sequence[str] = (),
               force: bool = False) -> DataFrame:
    """Crawl, mirror and record state for every start URL; returns the per-crawl summary.

    ``pages(url, html)`` may carry ``content_type`` and ``body`` (binary). URLs
    that an earlier run completed are followed but not saved again, so a forced
    run writes what was pending: failed URLs that are captured by now, and what
    they lead to. ``pages`` should go on holding the earlier pages.

    A file that an earlier run wrote is never written again: another URL that
    maps to it is recorded as complete with that file, as within a run.

    State and summary are versioned snapshots (``v=<n>``): a run reads the
    newest one and appends the next, so nothing is rewritten in place and an
    interrupted run leaves the previous snapshot intact.
    """
    starts = spark.createDataFrame([(u,) for u in start_urls], "url string").withColumn(
        "crawl_id", U.crawl_key(F.col("url")))
    url_state, n = _latest(spark, f"{out_dir}/state/url_state", S.URL_STATE_SCHEMA)
    completed, _ = _latest(spark, f"{out_dir}/state/completed", S.KEY_SCHEMA)
    if not force:  # the completion gate; -f runs them again (failed URLs are retried, saved ones kept)
        previous, _ = _latest(spark, f"{out_dir}/summary", SUMMARY_SCHEMA)
        starts = starts.join(previous.where(F.col("complete")).select("crawl_id"), "crawl_id", "left_anti")
    pages = with_kinds(pages)
    running = [r.url for r in starts.collect()]  # start URLs of the command line
    crawl, resources = site_resources(spark, assign_pages(pages, running), starts.select(*KEY), weights, excluded,
                                      connections, pages, completed)
    path = f"{checkpoint_dir(spark)}/mirror-resources-{uuid.uuid4().hex}"
    resources.write.parquet(path)  # written once: the manifest reads its keys and sizes, the sink its content
    resources = spark.read.schema(resources.schema).parquet(path)
    earlier = S.load_table(spark, f"{out_dir}/manifest", MANIFEST_SCHEMA).where(F.col("written") & ~F.col("unsafe"))
    written = K.write_mirror(resources, f"{out_dir}/mirror/v={n + 1}", order=["depth", "priority", "url"],
                             content_type="content_type", body="body", earlier=earlier)
    S.clustered(written, *KEY).write.mode("overwrite").parquet(f"{out_dir}/manifest/v={n + 1}")
    manifest = spark.read.schema(written.schema).parquet(f"{out_dir}/manifest/v={n + 1}")
    discovered = crawl.select(*KEY).unionByName(resources.select(*KEY)).distinct().withColumn(
        "path", F.lit(None).cast("string"))
    # a URL whose file stands already, from this or an earlier run, is complete with that file
    saved = manifest.where(~F.col("unsafe")).select(
        "crawl_id", "url", F.col("final_path").alias("path"))
    state, done = S.upsert_paths(url_state.unionByName(discovered).groupBy("crawl_id", "url").agg(
        F.max("path").alias("path")), completed, saved)
    _append_version(state, f"{out_dir}/state/url_state", n + 1)
    _append_version(done, f"{out_dir}/state/completed", n + 1)
    new_state, _ = _latest(spark, f"{out_dir}/state/url_state", S.URL_STATE_SCHEMA)
    new_done, _ = _latest(spark, f"{out_dir}/state/completed", S.KEY_SCHEMA)
    failed = crawl.where(~F.col("fetched")).select("crawl_id", "url")
    ran = starts.select("crawl_id")
    fresh = S.crawl_summary(new_state.join(ran, "crawl_id", "left_semi"), new_done, failed)
    before, _ = _latest(spark, f"{out_dir}/summary", SUMMARY_FULL_SCHEMA)
    _append_version(fresh.unionByName(before.join(ran, "crawl_id", "left_anti")), f"{out_dir}/summary", n + 1, ("crawl_id",))
    summary, _ = _latest(spark, f"{out_dir}/summary", SUMMARY_FULL_SCHEMA)
    return summary


def main(argv: Sequence[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Mirror websites from captured pages.")
    ap.add_argument("urls", nargs="+", help="start URLs (one crawl each)")
    ap.add_argument("--pages", required=True, help="Parquet table of captured pages (url, html)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("-c", "--connections", type=int, default=None,
                    help="pages each crawl pops per round, best-first; default: whole link levels (fewest rounds, for scale)")
    ap.add_argument("-w", "--weights", nargs="+", default=[], help="priority strings, first match wins")
    ap.add_argument("-v", "--exclude", nargs="+", default=[], help="exclusion strings")
    ap.add_argument("-f", "--force", action="store_true", help="run crawls already marked complete again")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("sitegraph-mirror").getOrCreate()
    summary = run_mirror(spark, spark.read.parquet(args.pages), args.urls, args.out, args.connections,
                         args.weights, args.exclude, args.force)
    summary.show(truncate=False)


if __name__ == "__main__":
    main()
