"""The crawl as one stream that feeds itself (§2.9): found URLs are written where the stream reads.

The table ``found(crawl_id, url, depth, parent, priority)`` is both the
stream's source and its sink. A micro-batch is a link level: its URLs meet the
links of the captured pages, targets found before are dropped, and the rest is
the next folder of the table, which the next micro-batch reads. A level without
new URLs writes nothing, so the stream comes to rest by itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitegraph.session import checkpoint_dir

KEY = ["crawl_id", "url"]
FOUND = "crawl_id string, url string, depth int, parent string, priority int"


def found(spark: SparkSession, crawl_dir: str) -> DataFrame:
    """All URLs found so far, with the number ``level`` of the micro-batch that wrote them (-1: the starts)."""
    return spark.read.schema(f"{FOUND}, level int").option("basePath", crawl_dir).parquet(crawl_dir)


def _write(rows: DataFrame, crawl_dir: str, level: int) -> None:
    rows.select("crawl_id", "url", "depth", "parent", "priority").write.mode("overwrite").parquet(f"{crawl_dir}/level={level}")


def start_crawl(spark: SparkSession, links: DataFrame, starts: DataFrame, crawl_dir: str, checkpoint: str,
                available_now: bool = False) -> StreamingQuery:
    """Start, or go on with, the crawl of ``starts(crawl_id, url)`` over ``links`` (as ``crawl.page_links`` gives them).

    The first call writes the starts; a later one with the same folders finds
    them and continues where the stream's checkpoint stands. A micro-batch that
    is replayed after a failure writes its folder anew and does not see what
    its first attempt wrote, so the table is exact. Call
    ``processAllAvailable()`` to wait for the end of the crawl;
    ``available_now`` stops after the levels that are there already.
    """
    checkpoint_dir(spark)
    try:
        found(spark, crawl_dir).limit(0).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        _write(starts.select(*KEY).distinct().select(*KEY, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"),
                                                     F.lit(0).alias("priority")), crawl_dir, -1)

    def level(batch: DataFrame, number: int) -> None:
        first = F.min(F.struct("rank", "src", "priority", "depth")).alias("f")  # first discoverer, combined before the shuffle
        step = batch.select("crawl_id", F.col("url").alias("src"), "depth").join(links, ["crawl_id", "src"]).where(
            F.col("src") != F.col("dst")).groupBy("crawl_id", F.col("dst").alias("url")).agg(first)
        before = found(batch.sparkSession, crawl_dir).where(F.col("level") < number).select(*KEY)
        new = step.join(before, KEY, "left_anti").select(
            *KEY, (F.col("f.depth") + 1).alias("depth"), F.col("f.src").alias("parent"), F.col("f.priority").alias("priority")).persist()
        try:
            if not new.isEmpty():
                _write(new, crawl_dir, number)
        finally:
            new.unpersist()

    stream = spark.readStream.schema(FOUND).option("recursiveFileLookup", "true").parquet(crawl_dir)
    writer = stream.writeStream.foreachBatch(level).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="0 seconds").start()
