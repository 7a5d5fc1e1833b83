"""Table sources: the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES_PARTITIONS = "sitegraph.pages.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(page_id, url, html)`` as scanned, one task per file split.

    A session whose files have too few row groups for its cores may set
    ``sitegraph.pages.partitions`` to a number of partitions to deal the rows to;
    without the setting no row is moved.
    """
    pages = read_table(spark, sf_dir, "pages")
    n = spark.conf.get(PAGES_PARTITIONS, None)
    return pages.repartition(int(n)) if n else pages
