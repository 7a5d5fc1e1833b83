"""Crawl state as keyed DataFrames.

State is three tables keyed by ``(crawl_id, url)``: ``url_state(crawl_id, url,
path)`` (every URL ever discovered; ``path`` null until saved),
``completed(crawl_id, url)`` and ``active(crawl_id, url)``. Every operator is an
equi-join, anti-join or aggregation on that key, so work spreads by URL even
when one crawl holds most of the rows; AQE turns a join into a broadcast only
when the runtime size of a side is below its threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from sitegraph.functions import urls as U

KEY = ["crawl_id", "url"]

URL_STATE_SCHEMA = T.StructType([
    T.StructField("crawl_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("path", T.StringType()),
])
KEY_SCHEMA = T.StructType([T.StructField("crawl_id", T.StringType()), T.StructField("url", T.StringType())])


# ------------------------------------------------------------------ sources / sinks

def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a state snapshot; a missing snapshot is an empty table with the same schema."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(0).collect()  # resolves the path now, reads no rows
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def load_state(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(url_state, completed)`` of a snapshot folder written by ``save_state``."""
    return (load_table(spark, f"{root}/url_state", URL_STATE_SCHEMA),
            load_table(spark, f"{root}/completed", KEY_SCHEMA))


def save_state(url_state: DataFrame, completed: DataFrame, root: str) -> None:
    """S4 sink: a new snapshot folder (one that exists is refused), laid out by key.

    A crawl's rows stand together in few files, found by the files' key
    statistics; a large crawl is spread over many, small ones share one.
    """
    clustered(url_state).write.parquet(f"{root}/url_state")
    clustered(completed).write.parquet(f"{root}/completed")


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to key ranges and sorted in them (default key: crawl and URL)."""
    keys = keys or tuple(KEY)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def path_map(url_state: DataFrame) -> DataFrame:
    """The URL -> saved path map (non-empty paths only)."""
    return url_state.where(F.col("path").isNotNull() & (F.col("path") != ""))


# ------------------------------------------------------------------ insert / upsert / lookup

def first_seen(links: DataFrame, order: Sequence[str] = ("page_id", "pos"), key: Sequence[str] = KEY) -> DataFrame:
    """A1: the first discovery of each URL per crawl (smallest ``order``), one row per key.

    An aggregation rather than a window, so the minimum is taken map-side
    before the shuffle and a hot crawl never lands in one task.
    """
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("first")
    return links.groupBy(*key).agg(first).select(*key, *[F.col(f"first.{c}").alias(c) for c in order])


def new_links(links: DataFrame, visited: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Links whose URL is not yet in ``visited``."""
    return links.join(visited.select(*key), list(key), "left_anti")


def insert_if_absent(url_state: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1+J1: (added, new_state). ``added`` are the distinct URLs not seen before; they enter with a null path."""
    added = new_links(links.select(*KEY).distinct(), url_state)
    new_state = url_state.unionByName(added.withColumn("path", F.lit(None).cast("string")))
    return added, new_state


def upsert_paths(url_state: DataFrame, completed: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record saved files. ``saved(crawl_id, url, path)`` sets paths and marks URLs complete.

    A URL saved but never discovered is inserted (the start URL case).
    """
    s = saved.select(*KEY, F.col("path").alias("new_path"))
    state = url_state.join(s, KEY, "full_outer").select(
        *KEY, F.coalesce(F.col("new_path"), F.col("path")).alias("path"))
    done = completed.select(*KEY).unionByName(saved.select(*KEY)).distinct()
    return state, done


def lookup(url_state: DataFrame, keys: DataFrame) -> DataFrame:
    """J4 get: every key with its recorded path (null when unknown)."""
    return keys.select(*KEY).join(url_state, KEY, "left")


def delete(url_state: DataFrame, keys: DataFrame) -> DataFrame:
    """J4 remove: the state without the given keys."""
    return url_state.join(keys.select(*KEY), KEY, "left_anti")


def relative_paths(links: DataFrame, url_state: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Relative path between the recorded paths of both ends of each link (null unless both saved)."""
    paths = path_map(url_state)
    a = paths.select("crawl_id", F.col("url").alias(src), F.col("path").alias("src_path"))
    b = paths.select("crawl_id", F.col("url").alias(dst), F.col("path").alias("dst_path"))
    out = links.join(a, ["crawl_id", src], "left").join(b, ["crawl_id", dst], "left")
    return out.withColumn("rel_path", U.state_relative_path(F.col("src_path"), F.col("dst_path")))


# ------------------------------------------------------------------ sets and counters

def pending_urls(url_state: DataFrame, completed: DataFrame) -> DataFrame:
    """O1: discovered but not completed (failures stay pending)."""
    return url_state.select(*KEY).join(completed.select(*KEY), KEY, "left_anti")


def crawl_summary(url_state: DataFrame, completed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per crawl visited / completed / pending counts and the completion flag.

    ``complete`` is true when nothing is pending or every pending URL is a
    known failure; ``failed`` (crawl_id, url) adds the failure count. The three
    tables are unioned as flag rows and folded per URL, then per crawl: two
    map-side-combinable aggregations instead of joins.
    """
    one, zero = F.lit(1), F.lit(0)
    flags = url_state.select(*KEY, one.alias("v"), zero.alias("d"), zero.alias("f")).unionByName(
        completed.select(*KEY, zero.alias("v"), one.alias("d"), zero.alias("f")))
    if failed is not None:
        flags = flags.unionByName(failed.select(*KEY, zero.alias("v"), zero.alias("d"), one.alias("f")))
    per_url = flags.groupBy(*KEY).agg(F.max("v").alias("v"), F.max("d").alias("d"), F.max("f").alias("f")) \
        .where(F.col("v") == 1)
    done = F.col("d") == 1
    agg = per_url.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("visited"),
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("pending"),
        F.count_if((F.col("f") == 1) & ~done).alias("failed"),
    )
    return agg.select(
        "crawl_id", *[F.col(c).cast("bigint").alias(c) for c in ("visited", "completed", "pending", "failed")],
        (F.col("pending") == F.col("failed")).alias("complete"),
    )


# ------------------------------------------------------------------ seeds and resume

def crawl_seeds(starts: DataFrame, visited: DataFrame, excluded: Sequence[str] = (),
                summary: DataFrame | None = None) -> DataFrame:
    """Start URLs to enqueue: crawl not complete, start not excluded, start not visited.

    ``starts(crawl_id, url)``; output adds ``priority`` 0 and ``depth`` 0.
    """
    s = starts.select(*KEY)
    if excluded:
        s = s.where(~U.is_excluded(F.col("url"), excluded))
    if summary is not None:
        s = s.join(summary.where(F.col("complete")).select("crawl_id"), "crawl_id", "left_anti")
    s = new_links(s, visited)
    return s.withColumn("priority", F.lit(0)).withColumn("depth", F.lit(0))


def resume_frontier(url_state: DataFrame, completed: DataFrame, starts: DataFrame,
                    weights: Sequence[str] = (), excluded: Sequence[str] = (),
                    mode: str = "retry_failed") -> DataFrame:
    """O2: what a resumed crawl queues, at depth 0 with its priority, plus unvisited starts at priority 0.

    ``mode="retry_failed"`` (what a forced restart of the original does) queues
    the pending URLs: discovered, not completed, failures included.
    ``mode="refetch_all"`` queues every visited URL again.
    """
    if mode == "retry_failed":
        pend = pending_urls(url_state, completed)
    elif mode == "refetch_all":
        pend = url_state.select(*KEY).distinct()
    else:
        raise ValueError(f"unknown resume mode {mode!r}")
    if excluded:
        pend = pend.where(~U.is_excluded(F.col("url"), excluded))
    pend = pend.withColumn("priority", U.url_priority(F.col("url"), weights)).withColumn("depth", F.lit(0))
    return pend.unionByName(crawl_seeds(starts, url_state, excluded))
