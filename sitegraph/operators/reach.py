"""Reachability for many starts at once (G3, G4): components first, then labels, then a search of what is left.

A search from every start lists starts times reach. Here the graph is first cut
down to its strongly connected components (trimming, forward-backward
colouring). On the component graph a few hubs decide most pairs by two bit
labels (the hubs a node reaches, the hubs that reach it). Without the hubs,
most components have few ancestors, which are listed; a pair whose end has too
many of them is searched for in that smaller graph.

Nodes are numbered once, so the loops move pairs of integers. Every round is a
reliable checkpoint; the driver sees counts only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.operators import graph as G
from sitegraph.session import checkpoint_dir

HUBS = 62  # per graph: one bit of a long each
ANCESTORS = 64  # listed per component
PART_ROWS, LEAST_PARTS = 50_000, 12  # edges in a partition of a flow; its least number of partitions


@contextmanager
def _parts(spark: SparkSession, rows: int):
    """Plans made inside shuffle into as many partitions as ``rows`` need, without AQE, so that checkpoints keep their partitioning."""
    was = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(was["spark.sql.shuffle.partitions"]), max(LEAST_PARTS, rows // PART_ROWS))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)


def flow(edges: DataFrame, values: DataFrame, merge: Callable[[Column, Column], Column], total: Callable[[str], Column],
         n: int | None = None) -> DataFrame:
    """``values(node, v)`` after every value has flowed along ``edges(a, b)`` until nothing changes.

    ``total`` merges the values that reach a node, ``merge`` those with its
    own; a round sends only values that changed. All nodes must have a value.
    ``n`` is the number of edges, if known; else they are written once more to count them.

    Edges and values are dealt and sorted by their node once and stay so: a
    round shuffles what is sent and nothing else.
    """
    spark = edges.sparkSession
    if n is None:
        edges, n = G.checkpoint_counted(edges.select("a", "b"))
    with _parts(spark, n):
        edges = G.materialize(G.partitioned(edges.select("a", "b"), "a").sortWithinPartitions("a"), keep_partitioning=True)
        state = G.materialize(G.partitioned(values.select("node", "v", F.lit(True).alias("changed")), "node").sortWithinPartitions("node"),
                              keep_partitioning=True)
        while True:
            sent = state.where("changed").select(F.col("node").alias("a"), "v").join(edges.hint("merge"), "a").groupBy(
                F.col("b").alias("node")).agg(total("v").alias("w"))
            met = state.join(sent.hint("merge"), "node", "left").select("node", "v", F.coalesce(merge(F.col("v"), F.col("w")), "v").alias("w"))
            seen = Observation(f"changed-{uuid.uuid4().hex[:8]}")
            state = met.select("node", F.col("w").alias("v"), (F.col("w") != F.col("v")).alias("changed")).observe(
                seen, F.count_if("changed").alias("n")).checkpoint()
            if not seen.get["n"]:
                return state.select("node", "v")


def _greatest(edges: DataFrame, values: DataFrame, n: int | None = None) -> DataFrame:
    return flow(edges, values, F.greatest, F.max, n)


def _bits(edges: DataFrame, values: DataFrame, n: int | None = None) -> DataFrame:
    return flow(edges, values, lambda a, b: a.bitwiseOR(b), F.bit_or, n)


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that can lie on a cycle by the look of it: their source is entered and their target left; and how many."""
    edges, n = G.checkpoint_counted(edges)
    while n:
        entered, left = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges, kept = G.checkpoint_counted(edges.join(entered, "a", "left_semi").join(left, "b", "left_semi"))
        if kept > .9 * n:  # a long chain loses an end a round; colouring cuts it in pieces
            return edges, kept
        n = kept
    return edges, 0


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``edges(a, b)`` that share a cycle; all others are components of their own.

    Each round trims, colours every node with the greatest number that reaches
    it, and takes from each colour what reaches its namesake back: these are
    whole components. Edges between colours lie on no cycle and go.
    """
    live, found = edges.where(F.col("a") != F.col("b")).distinct(), []
    while True:
        live, n = _trimmed(live)
        if not n:
            break
        nodes = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct()
        colour = _greatest(live, nodes.select("node", F.col("node").alias("v")), n).withColumnRenamed("v", "c")
        same = live.join(colour.withColumnRenamed("node", "a"), "a").join(
            colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where(F.col("c") == F.col("cb")).select("a", "b")
        same, n = G.checkpoint_counted(same)
        back = _greatest(same.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.select(
            "node", F.when(F.col("c") == F.col("node"), F.col("c")).otherwise(F.lit(-1)).alias("v")), n)
        member = back.where(F.col("v") >= 0).select("node", F.col("v").alias("component"))
        found.append(member)
        gone = member.select("node")
        live = same.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti")
    if not found:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _ancestors(dag: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``node, x``: the ancestors of components that have at most ``most``; ``node``: components with more."""
    dag = G.materialize(G.partitioned(dag, "a"), keep_partitioning=True)
    fresh, n = G.checkpoint_counted(dag.select(F.col("b").alias("node"), F.col("a").alias("x")).distinct())
    pairs = fresh
    many = pairs.select("node").limit(0)
    while n:
        crowded = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node")
        many, _ = G.checkpoint_counted(many.unionByName(crowded).distinct())
        onward = fresh.join(many, "node", "left_anti").withColumnRenamed("node", "a").join(dag, "a").select(F.col("b").alias("node"), "x").distinct()
        fresh, n = G.checkpoint_counted(onward.join(many, "node", "left_anti").join(pairs, ["node", "x"], "left_anti"))
        pairs, _ = G.checkpoint_counted(pairs.join(many, "node", "left_anti").unionByName(fresh))
    nodes = dag.select(F.col("a").alias("node")).unionByName(dag.select(F.col("b").alias("node"))).distinct()
    marked = nodes.join(many.withColumn("v", F.lit(1)), "node", "left").select("node", F.coalesce("v", F.lit(0)).alias("v"))
    below = _greatest(dag, marked).where(F.col("v") == 1).select("node")  # what a crowded one reaches has its ancestors, too
    return pairs, below


def reach_pairs(spark: SparkSession, edges: DataFrame, asked: DataFrame, by: Sequence[str] = ("crawl_id",),
                hubs: int = HUBS, ancestors: int = ANCESTORS) -> DataFrame:
    """The pairs ``(*by, start, end)`` of ``asked``, start and end different, whose end can be reached over ``edges(*by, src, dst)``."""
    asked = G.materialize(asked.select(*by, "start", "end").distinct().withColumn("id", F.monotonically_increasing_id()))
    return asked.join(reach_ids(spark, edges, asked, by, hubs, ancestors), "id", "left_semi").select(*by, "start", "end")


def reach_ids(spark: SparkSession, edges: DataFrame, asked: DataFrame, by: Sequence[str] = ("crawl_id",),
              hubs: int = HUBS, ancestors: int = ANCESTORS) -> DataFrame:
    """The ``id`` of each row of ``asked(id, *by, start, end)``, start and end different, whose end can be reached over ``edges(*by, src, dst)``.

    Work grows with edges and pairs, and with starts times reach only for pairs
    that no label decides: those whose end has more than ``ancestors``
    ancestors beside the hubs. ``hubs`` (at most 62) counts per graph.

    URLs are shuffled to number the nodes and to look the numbers up, nowhere else.
    """
    checkpoint_dir(spark)
    by = list(by)
    links = edges.select(*by, "src", "dst").where(F.col("src") != F.col("dst"))
    nodes = G.materialize(G.graph_nodes(links, by).withColumn("node", F.monotonically_increasing_id()))

    def numbered(df, names, of, number):
        """``df`` with each column in ``names`` replaced by the number that ``of`` has for its URL."""
        for name, out in names.items():
            df = df.join(of.select(*by, F.col("url").alias(name), F.col(number).alias(out)), [*by, name]).drop(name)
        return df.drop(*by)

    e = G.materialize(numbered(links, {"src": "a", "dst": "b"}, nodes, "node").distinct())
    component = nodes.join(strong_components(e), "node", "left").select(*by, "url", "node", F.coalesce("component", "node").alias("c"))
    component = G.materialize(component)
    of = component.select("node", "c")
    dag = e.join(of.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(
        of.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    dag, n_dag = G.checkpoint_counted(dag.where(F.col("a") != F.col("b")).distinct())

    q = asked.select("id", *by, "start", "end").where(F.col("start") != F.col("end"))
    q = G.materialize(numbered(q, {"start": "cs", "end": "ce"}, component, "c"))
    together = q.where(F.col("cs") == F.col("ce"))
    apart = q.where(F.col("cs") != F.col("ce")).select("cs", "ce").distinct()

    # hubs: the components with most edges in times edges out, a bit each
    degree = dag.groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("out")).join(
        dag.groupBy(F.col("b").alias("c")).agg(F.count(F.lit(1)).alias("into")), "c")
    graphs = component.where(F.col("node") == F.col("c")).select(*by, "c")  # a component bears the number of one of its nodes
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy((F.col("out") * F.col("into")).desc(), "c"))
    hub = degree.join(graphs, "c").withColumn("k", rank).where(F.col("k") <= hubs).select("c", F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("k") - 1).alias("bit"))
    hub = G.materialize(hub)
    own = graphs.select("c").join(hub, "c", "left").select(F.col("c").alias("node"), F.coalesce("bit", F.lit(0).cast("long")).alias("v"))
    over = _bits(dag, own, n_dag)  # hubs above
    under = _bits(dag.select(F.col("b").alias("a"), F.col("a").alias("b")), own, n_dag)  # hubs below
    met = apart.join(under.select(F.col("node").alias("cs"), F.col("v").alias("down")), "cs").join(
        over.select(F.col("node").alias("ce"), F.col("v").alias("up")), "ce")
    met = G.materialize(met.select("cs", "ce", (F.col("down").bitwiseAND(F.col("up")) != 0).alias("hit")))
    open_ = met.where(~F.col("hit")).select("cs", "ce")
    for side in ("cs", "ce"):  # the bits say all about a hub
        open_ = open_.join(hub.select(F.col("c").alias(side)), side, "left_anti")
    open_, n = G.checkpoint_counted(open_)
    hits = met.where("hit").select("cs", "ce")
    if n:
        rest = dag.join(hub.select(F.col("c").alias("a")), "a", "left_anti").join(hub.select(F.col("c").alias("b")), "b", "left_anti")
        rest = G.materialize(rest)
        pairs, crowded = _ancestors(rest, ancestors)
        hits = hits.unionByName(open_.join(pairs.select(F.col("node").alias("ce"), F.col("x").alias("cs")), ["cs", "ce"], "left_semi"))
        left, n = G.checkpoint_counted(open_.join(crowded.withColumnRenamed("node", "ce"), "ce", "left_semi").select(
            F.col("cs").cast("string").alias("start"), F.col("ce").cast("string").alias("end")))
        if n:
            found = G.bfs(spark, rest.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst")),
                          left.select("start"), by=(), wanted=left).select("start", F.col("url").alias("end"))
            hits = hits.unionByName(found.join(left, ["start", "end"], "left_semi").select(
                F.col("start").cast("long").alias("cs"), F.col("end").cast("long").alias("ce")))
    return together.select("id").unionByName(q.join(hits, ["cs", "ce"], "left_semi").select("id"))
