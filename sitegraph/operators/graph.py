"""Link-graph operators (A4, G1-G7) over ``edges(crawl_id, src, dst)``.

Reachability is a level-synchronous BFS written as a driver loop of DataFrame
rounds. Each round joins the current level with the edges on
``(crawl_id, src)`` and anti-joins everything reached so far; only the new
level is a reliable checkpoint in ``spark.checkpoint.dir`` (the edges once,
keeping their hash partitioning), so the lineage stays one
level deep and a lost executor costs one round at most. The driver only ever
sees a row count per round, observed during the write.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions.urls import url_priority
from sitegraph.session import checkpoint_dir


def link_edges(links: DataFrame, src: str = "page_url", dst: str = "url", by: Sequence[str] = ()) -> DataFrame:
    """Distinct page -> target edges without self-loops."""
    return (links.select(*by, F.col(src).alias("src"), F.col(dst).alias("dst"))
            .where(F.col("src") != F.col("dst")).distinct())


def graph_remove(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = ("crawl_id",)) -> DataFrame:
    """Drop the nodes with their out-edges and in-edges; unknown nodes are ignored."""
    n = nodes.select(*by, F.col("url").alias("src"))
    out = edges.join(n, [*by, "src"], "left_anti")
    return out.join(n.withColumnRenamed("src", "dst"), [*by, "dst"], "left_anti")


def graph_ends(edges: DataFrame, by: Sequence[str] = ("crawl_id",)) -> DataFrame:
    """Both ends of every edge, repeats included."""
    return edges.select(*by, F.col("src").alias("url")).unionByName(edges.select(*by, F.col("dst").alias("url")))


def graph_nodes(edges: DataFrame, by: Sequence[str] = ("crawl_id",)) -> DataFrame:
    return graph_ends(edges, by).distinct()


def materialize(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Reliable checkpoint (computed once: persisted while written).

    With ``keep_partitioning`` the checkpoint records the frame's hash
    partitioning, so later joins on those keys leave it in place. Spark only
    records it when the checkpointed plan is not adaptive, so AQE is switched
    off for this one job (the plan is a repartition with an explicit count,
    where AQE has nothing to change) and restored afterwards.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    if keep_partitioning:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.persist()
        out = df.checkpoint()
        df.unpersist()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
    return out


def partitioned(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition on ``cols`` with an explicit count, so AQE keeps it and a checkpoint records it.

    A join with another side on the same keys then shuffles only that side.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def checkpoint_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Reliable checkpoint (into ``spark.checkpoint.dir``) plus the row count, observed in the same job."""
    checkpoint_dir(df.sparkSession)
    obs = Observation(f"rows-{uuid.uuid4().hex[:8]}")
    out = df.observe(obs, F.count(F.lit(1)).alias("n")).checkpoint()
    return out, int(obs.get["n"])


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Pieces:
    """Append-only table of hash-partitioned checkpoints.

    Pieces that have been merged equally often are merged, so a row is written
    again about log2(additions) times and the table has about as many pieces.
    """

    def __init__(self, *keys: str):
        self.keys, self.pieces = list(keys), []

    def add(self, rows: DataFrame) -> DataFrame:
        """Append ``rows``; returns their checkpoint."""
        added = materialize(partitioned(rows, *self.keys), keep_partitioning=True)
        merges, piece = 0, added
        while self.pieces and self.pieces[-1][0] == merges:
            piece, merges = self.pieces.pop()[1].unionByName(piece), merges + 1
        if merges:
            piece = materialize(partitioned(piece, *self.keys), keep_partitioning=True)
        self.pieces.append((merges, piece))
        return added

    def rows(self) -> DataFrame:
        return _union([piece for _, piece in self.pieces])

    def missing(self, rows: DataFrame) -> DataFrame:
        """The ``rows`` whose keys no piece holds; only ``rows`` are shuffled."""
        for _, piece in self.pieces:
            rows = rows.join(piece.select(*self.keys), self.keys, "left_anti")
        return rows


def bfs(spark: SparkSession, edges: DataFrame, sources: DataFrame, by: Sequence[str] = ("crawl_id",),
        max_depth: int | None = None, prior: DataFrame | None = None, compact_every: int = 4,
        wanted: DataFrame | None = None) -> DataFrame:
    """Multi-source BFS: every node reached from each source with its shortest depth and a parent.

    ``sources(*by, start)`` (a start need not be a node); ``edges(*by, src, dst)``.
    Output ``(*by, start, url, depth, parent)``; ``parent`` is the node of the
    previous level that links to the node and comes first by ``(rank, src)``
    (null for the start); ``rank``, the source's priority, may be a column of ``edges``.

    Each round: level ⋈ edges on ``(*by, src)`` (the edges stay hash-partitioned
    on that key, so only the level is shuffled), ``min(src)`` per reached node
    (combined map-side), anti-join with everything reached so far, then the new
    level is checkpointed into ``spark.checkpoint.dir``. Rounds = graph depth.
    Every ``compact_every`` levels the visited levels are folded into one
    hash-partitioned checkpoint that later anti-joins read in place; only the
    few levels since then are shuffled again.

    ``wanted(*by, start, end)``: the nodes looked for. A start whose ends are
    all found is expanded no further (looked at whenever levels are folded).

    ``prior`` (an earlier, interrupted result) resumes the search: its levels
    are taken as found and its deepest level is expanded next, so an
    interrupted-then-resumed run equals an uninterrupted one. ``max_depth``
    bounds the total depth.
    """
    checkpoint_dir(spark)
    by = list(by)
    order = ["rank", "src"] if "rank" in edges.columns else ["src"]
    e = materialize(partitioned(edges.select(*by, *order, "dst").where(F.col("src") != F.col("dst")).distinct(),
                                *by, "src"), keep_partitioning=True)
    start = sources.select(*by, "start").distinct().select(
        *by, "start", F.col("start").alias("url"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent"))
    if prior is None:
        level, _ = checkpoint_counted(start)
        visited, depth = [level], 0
    else:
        p = prior.select(*by, "start", "url", F.col("depth").cast("int").alias("depth"), "parent")
        p = p.unionByName(start.join(p.select(*by, "start"), [*by, "start"], "left_anti"))
        p, _ = checkpoint_counted(p)
        depth = p.agg(F.max("depth")).first()[0] or 0
        level = p.where(F.col("depth") == depth)
        visited = [p.where(F.col("depth") < depth), level]
    keys = [*by, "start", "url"]
    folded, fresh = None, visited  # what is reached: the folded levels and those since
    while max_depth is None or depth < max_depth:
        step = (
            level.select(*by, "start", F.col("url").alias("src"))
            .join(e, [*by, "src"])
            .groupBy(*by, "start", F.col("dst").alias("url"))
            .agg(F.min(F.struct(*order))["src"].alias("parent"))
        )
        if folded is not None:
            step = step.join(folded.select(*keys), keys, "left_anti")
        if fresh:
            step = step.join(_union(fresh).select(*keys), keys, "left_anti")
        level, n = checkpoint_counted(step.select(*keys, F.lit(depth + 1).alias("depth"), "parent"))
        if n == 0:
            break
        fresh.append(level)
        depth += 1
        if compact_every and len(fresh) >= compact_every:
            reached = fresh if folded is None else [folded, *fresh]
            folded, fresh = materialize(partitioned(_union(reached), *keys), keep_partitioning=True), []
            if wanted is not None:
                found = folded.select(*by, "start", F.col("url").alias("end"))
                wanted, n_open = checkpoint_counted(wanted.join(found, [*by, "start", "end"], "left_anti"))
                if n_open == 0:
                    break
                level = level.join(wanted.select(*by, "start").distinct(), [*by, "start"], "left_semi")
    return _union(fresh if folded is None else [folded, *fresh])


def has_path(spark: SparkSession, edges: DataFrame, queries: DataFrame, by: Sequence[str] = ("crawl_id",),
             nodes: DataFrame | None = None) -> DataFrame:
    """For each ``(*by, start, end)`` query, whether ``end`` is reachable from ``start``.

    ``start == end`` is true iff the node exists; an unknown node gives false.
    ``nodes(*by, url)`` names nodes beside the edges' ends (those without links).
    Starts may be as many as nodes: see ``reach.reach_ids``.
    """
    from sitegraph.operators.reach import reach_ids

    by = list(by)
    known = graph_ends(edges, by)
    if nodes is not None:
        known = known.unionByName(nodes.select(*by, "url"))
    asked = materialize(queries.select(F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("_q"), *by, "start", "end",
                                       F.monotonically_increasing_id().alias("id")))
    itself = asked.where(F.col("start") == F.col("end")).join(known.withColumnRenamed("url", "start"), [*by, "start"], "left_semi")
    hits = reach_ids(spark, edges, asked, by).unionByName(itself.select("id")).withColumn("hit", F.lit(True))
    return asked.join(hits, "id", "left").select("_q.*", F.coalesce(F.col("hit"), F.lit(False)).alias("reachable"))


def cycle_check(spark: SparkSession, edges: DataFrame, candidates: DataFrame,
                by: Sequence[str] = ("crawl_id",)) -> DataFrame:
    """Would adding ``src -> dst`` close a cycle, i.e. does ``dst`` already reach ``src``?

    A self-loop always does; candidates are checked as one batch against the
    fixed graph and may be as many as its edges.
    """
    by = list(by)
    q = candidates.select(*by, "src", "dst", F.col("dst").alias("start"), F.col("src").alias("end"))
    r = has_path(spark, edges, q.where(F.col("src") != F.col("dst")), by)
    loops = q.where(F.col("src") == F.col("dst")).withColumn("reachable", F.lit(True))
    return r.unionByName(loops).select(*by, "src", "dst", F.col("reachable").alias("creates_cycle"))


def discovery_tree(spark: SparkSession, edges: DataFrame, starts: DataFrame, by: Sequence[str] = ("crawl_id",),
                   weights: Sequence[str] | None = None) -> DataFrame:
    """G1: one parent per reached URL (a forest): its first discoverer by (depth, priority, url).

    Priorities follow ``weights``; without them, a column ``rank`` of ``edges`` (the source's priority) or none.
    """
    if weights is not None:
        edges = edges.withColumn("rank", url_priority(F.col("src"), weights))
    return bfs(spark, edges, starts, by)


def acyclic_edges(spark: SparkSession, edges: DataFrame, starts: DataFrame,
                  by: Sequence[str] = ("crawl_id",)) -> DataFrame:
    """Keep an edge iff ``(depth, url)`` of its source ranks below that of its target.

    Depths are BFS depths from the starts (unreached nodes rank after every
    reached one). The kept graph is acyclic whatever the arrival order; the
    order-dependent greedy admission of the original is deliberately not copied.
    """
    by = list(by)
    d = bfs(spark, edges, starts, by).groupBy(*by, "url").agg(F.min("depth").alias("depth"))
    unreached = F.lit(2**31 - 1)
    e = edges.select(*by, "src", "dst").where(F.col("src") != F.col("dst")).distinct()
    s = d.select(*by, F.col("url").alias("src"), F.col("depth").alias("src_depth"))
    t = d.select(*by, F.col("url").alias("dst"), F.col("depth").alias("dst_depth"))
    j = e.join(s, [*by, "src"], "left").join(t, [*by, "dst"], "left")
    sd, td = F.coalesce("src_depth", unreached), F.coalesce("dst_depth", unreached)
    keep = (sd < td) | ((sd == td) & (F.col("src") < F.col("dst")))
    return j.where(keep).select(*by, "src", "dst")
