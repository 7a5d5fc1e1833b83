"""Frontier order and retry outcome.

The frontier is a table ``(crawl_id, url, priority, depth, ...)`` ordered per
crawl by ``(priority, depth, url)``: priority beats depth, so the order is
best-first rather than breadth-first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.operators.graph import materialize

KEY = ["crawl_id", "url"]
ORDER = ("priority", "depth", "url")

# --- fixed values: retry schedule of the fetcher ---
MAX_ATTEMPTS = 5
FIRST_DELAY_S = 1
RETRY_ERRORS = ["timeout", "payload"]
# --- end of fixed values ---


def open_frontier(frontier: DataFrame, completed: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """P5: drop entries already completed."""
    return frontier.join(completed.select(*key), list(key), "left_anti")


def frontier_rank(frontier: DataFrame, order: Sequence[str] = ORDER, by: str = "crawl_id") -> DataFrame:
    """Position of every entry within its crawl (1 = popped first); see ``rank_within``."""
    return rank_within(frontier, order, by)


def rank_within(frontier: DataFrame, order: Sequence[str], by: str) -> DataFrame:
    """``row_number()`` over ``by`` ordered by ``order`` as column ``rank``, safe for a hot group.

    One range-partitioned sort spreads a group that holds most rows over many
    tasks. The sorted rows, each with its place in its partition, are written
    once to the checkpoint folder, and both the offsets (one small row per group
    and partition) and the ranks are read from that copy: computing the sort
    twice could choose other range bounds for each. Rows that tie on all of
    ``order`` get consecutive ranks in any order; null groups rank on their own.
    """
    keys = [by, *order]
    place = 33  # bits of the row's place below the partition number in monotonically_increasing_id
    local = materialize(frontier.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("_at", F.monotonically_increasing_id()))
    local = local.withColumn("_pid", F.shiftright("_at", place)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << place) - 1)))
    counts = local.groupBy(by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(by).alias("_by"), F.col("_pid").alias("_p"),
                            (before - F.col("_first") + 1).alias("_off"))
    return local.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_pid") == F.col("_p"))).withColumn(
        "rank", (F.col("_off") + F.col("_pos")).cast("bigint")).drop("_at", "_pid", "_pos", "_by", "_p", "_off")


def frontier_batch(frontier: DataFrame, k: int, order: Sequence[str] = ORDER, by: str = "crawl_id") -> DataFrame:
    """The ``k`` entries each crawl pops next.

    ``row_number() <= k`` lets Spark insert a partial per-partition top-k before
    the shuffle (WindowGroupLimit), so each map task sends at most ``k`` rows
    per crawl however large one crawl is.
    """
    w = Window.partitionBy(by).orderBy(*order)
    return frontier.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint"))


def claim_urls(batch: DataFrame, active: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """URLs that may start now: one claim per URL, none while the URL is in progress."""
    return batch.select(*key).distinct().join(active.select(*key), list(key), "left_anti")


def attempt_class(status, error):
    """ok / retry_server / retry_network / fail for one attempt."""
    return (
        F.when(status == 200, F.lit("ok"))
        .when(status.between(500, 599), F.lit("retry_server"))
        .when(status.isNotNull(), F.lit("fail"))
        .when(error.isin(*RETRY_ERRORS), F.lit("retry_network"))
        .otherwise(F.lit("fail"))
    )


def fetch_outcome(log: DataFrame, url: str = "url", by: Sequence[str] = ()) -> DataFrame:
    """Outcome of the retry loop per URL from its attempt log.

    Rules: 200 succeeds; 5xx sleeps ``2^(n-1)`` s and retries (also after the
    last attempt); a timeout or payload error sleeps likewise except after the
    last attempt; any other status or error fails at once; five attempts at most.
    Each URL has at most ``MAX_ATTEMPTS`` rows, so its group is bounded.
    A log that ends before the last allowed attempt without a terminal one is
    ``pending`` (the streaming form emits nothing for it yet).
    Output: by..., url, outcome, attempts, backoff_s, content_type (of the final attempt);
    ``by`` (e.g. ``["crawl_id"]``) keeps the logs of many crawls apart.
    """
    keys = [*by, url]
    # one row per (url, attempt) first (deterministic on duplicates), so a URL's group is at most five rows
    tries = log.where(F.col("attempt").between(1, MAX_ATTEMPTS)).groupBy(*keys, F.col("attempt").cast("int").alias("n")) \
        .agg(F.min(F.struct(attempt_class(F.col("status"), F.col("error")).alias("cls"),
                            F.col("content_type").alias("ct"))).alias("t"))
    rows = tries.select(*keys, F.struct("n", F.col("t.cls").alias("cls"), F.col("t.ct").alias("ct")).alias("a"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("a")).alias("tries"))
    stop = F.filter("tries", lambda a: a["cls"].isin("ok", "fail"))
    term = F.when(F.size(stop) > 0, F.try_element_at(stop, F.lit(1))["n"]).otherwise(F.array_max("tries")["n"])
    outcome = F.when(F.size(stop) > 0, F.try_element_at(stop, F.lit(1))["cls"])

    def delay(a, t):
        sleeps = (a["n"] <= t) & (
            (a["cls"] == "retry_server") | ((a["cls"] == "retry_network") & (a["n"] < MAX_ATTEMPTS)))
        return F.when(sleeps, (F.lit(FIRST_DELAY_S) * F.pow(F.lit(2), a["n"] - 1)).cast("int")).otherwise(F.lit(0))

    with_term = grouped.withColumn("term", term).withColumn("outcome_cls", outcome)
    backoff = F.aggregate("tries", F.lit(0), lambda acc, a: acc + delay(a, F.col("term")))
    final_ct = F.try_element_at(F.filter("tries", lambda a: a["n"] == F.col("term")), F.lit(1))["ct"]
    return with_term.select(
        *keys,
        F.when(F.col("outcome_cls") == "ok", F.lit("ok"))
        .when((F.col("outcome_cls") == "fail") | (F.col("term") == MAX_ATTEMPTS), F.lit("failed"))
        .otherwise(F.lit("pending")).alias("outcome"),
        F.col("term").cast("bigint").alias("attempts"),
        backoff.cast("bigint").alias("backoff_s"),
        final_ct.alias("content_type"),
    )
