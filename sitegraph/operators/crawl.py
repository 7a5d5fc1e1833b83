"""Replay crawl over captured pages.

Fetching is a join: a frontier row finds its content in ``pages(crawl_id, url,
html)`` or fails. Links of every captured page are extracted once, up front,
by the narrow X1 stage, so the crawl loop joins small key tables only and
``html`` never enters a shuffle. All crawls advance together in one plan.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import frontier as W
from sitegraph.operators import graph as G
from sitegraph.operators import links as X
from sitegraph.session import checkpoint_dir

KEY = ["crawl_id", "url"]
STEP_ENTRIES = 20_000  # open entries per crawl that a step of a best-first crawl may pop
STEP_LINKS = 100_000  # their links, per crawl and generation; the entries of one round may have more
STEP_GENERATIONS = 4  # the open entries and three generations of what they link to


def replay_fetch(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Each frontier row with its captured content; no match is a failed fetch.

    The page table is first semi-joined with the batch keys (the small side,
    which AQE broadcasts when its runtime size is under the threshold), so only
    the fetched pages' HTML moves; the outer join then runs on that small result.
    """
    keys = frontier.select(*KEY).distinct()
    content = pages.select(*KEY, "html").join(keys, KEY, "left_semi")
    return frontier.join(content, KEY, "left").withColumn("fetched", F.col("html").isNotNull())


def page_links(pages: DataFrame, starts: DataFrame, weights: Sequence[str] = (),
               excluded: Sequence[str] = (), strict_domain: bool = False) -> DataFrame:
    """X1 over every captured page with its crawl's domain: ``(crawl_id, src, dst, priority, rank)``.

    ``priority`` is the target's, ``rank`` the source's.

    ``starts`` may carry per-crawl knobs as ``weights`` / ``excluded``
    (``array<string>``) columns; they take the place of the shared lists.

    Links are extracted and resolved narrowly first; only the small link rows
    are then joined with the crawl's domain (netloc of its start URL), so no
    HTML is shuffled, and a crawl holding most links is split by AQE's skew join.
    """
    knobs = [c for c in ("weights", "excluded") if c in starts.columns]
    dom = starts.select("crawl_id", U.url_netloc(F.col("url")).alias("domain"), *knobs)
    raw = X.raw_links(pages.select("crawl_id", "url", "html"), keep=("crawl_id",), resolve=True)
    links = raw.where((F.col("href") != "") & ~F.col("href").startswith("#") & F.col("url").isNotNull()) \
        .select("crawl_id", F.col("page_url").alias("src"), F.col("url").alias("dst"))
    out = links.join(dom, "crawl_id").where(U.in_domain(F.col("dst"), F.col("domain"), strict_domain))
    if excluded:
        out = out.where(~U.is_excluded(F.col("dst"), excluded))
    if "excluded" in knobs:
        out = out.where(~U.is_excluded_by(F.col("dst"), F.col("excluded")))

    def prio(url):
        return (U.url_priority_by(F.col(url), F.col("weights")) if "weights" in knobs else U.url_priority(
            F.col(url), weights)).cast("int")
    return out.select("crawl_id", "src", "dst", prio("dst").alias("priority"), prio("src").alias("rank"))


def replay_crawl(spark: SparkSession, pages: DataFrame, starts: DataFrame, weights: Sequence[str] = (),
                 excluded: Sequence[str] = (), batch_size: int | None = None, strict_domain: bool = False,
                 max_rounds: int | None = None, resume_from: DataFrame | None = None,
                 content: DataFrame | None = None, outcomes: DataFrame | None = None,
                 state_dir: str | None = None) -> DataFrame:
    """Crawl every start URL over the captured pages until the frontier is empty.

    ``batch_size=None`` pops whole BFS levels (depth = shortest link distance);
    ``batch_size=k`` pops the best ``k`` entries per crawl each round by
    ``(priority, depth, url)`` like the original's bounded queue (depth =
    discovery depth). Output: every discovered URL with ``depth``, ``priority``,
    ``parent`` (first discoverer) and ``fetched``.

    ``pages`` are parsed for links; ``content(crawl_id, url)`` names everything
    that can be fetched if that is more (style sheets, images). ``outcomes``
    (``url, outcome`` and perhaps ``crawl_id``, as ``fetch_outcome`` gives them)
    names fetches that did not end ``ok``: those URLs count as not captured.

    ``max_rounds`` stops after so many rounds in all; the output then has one
    more column ``open``, true for URLs that are found but not popped yet.
    ``resume_from`` (the output of a stopped level crawl) continues a level
    crawl. A best-first crawl is continued from ``state_dir``, a shared folder
    in which every finished step of rounds leaves what it popped and found: called again
    with it, the crawl goes on behind the last finished step. Either way the
    result is that of an uninterrupted crawl.

    Rounds: level mode needs one per link-depth level. Best-first mode has about
    (pages of the largest crawl) / ``k`` rounds, like the bounded queue, and
    plays many of them in one step of a few jobs (``_best_first``): a step
    pops up to ``STEP_ENTRIES`` entries of every crawl.
    """
    if batch_size is not None and resume_from is not None:
        raise ValueError("a best-first crawl is resumed from its state_dir, a level crawl with resume_from")
    if batch_size is None and state_dir is not None:
        raise ValueError("state_dir keeps the rounds of best-first crawls; a level crawl is resumed with resume_from")
    checkpoint_dir(spark)
    if outcomes is not None:
        on = [c for c in KEY if c in outcomes.columns]
        failed = outcomes.where(F.col("outcome") != "ok").select(*on).distinct()
        pages = pages.join(failed, on, "left_anti")
        content = None if content is None else content.join(failed, on, "left_anti")
    seeds = starts
    if excluded:
        seeds = seeds.where(~U.is_excluded(F.col("url"), excluded))
    if "excluded" in starts.columns:
        seeds = seeds.where(~U.is_excluded_by(F.col("url"), F.col("excluded")))
    seeds = seeds.select(*KEY)
    edges = G.materialize(page_links(pages, starts, weights, excluded, strict_domain))
    if batch_size is None:
        prior = None
        if resume_from is not None:
            first = seeds.select("crawl_id", F.col("url").alias("start"))
            prior = resume_from.join(resume_from.where(F.col("depth") == 0).select(
                "crawl_id", F.col("url").alias("start")), "crawl_id").join(first, ["crawl_id", "start"], "left_semi")
        found = G.bfs(spark, edges, seeds.select("crawl_id", F.col("url").alias("start")), max_depth=max_rounds,
                      prior=prior)
        found = found.select("crawl_id", "url", "depth", "parent")
        if "weights" in starts.columns:
            found = found.join(starts.select("crawl_id", "weights"), "crawl_id")
            prio = U.url_priority_by(F.col("url"), F.col("weights"))
        else:
            prio = U.url_priority(F.col("url"), weights)
        found = found.withColumn("priority", F.when(F.col("depth") == 0, F.lit(0)).otherwise(prio))
        waiting = F.col("depth") == (max_rounds if max_rounds is not None else -1)
    else:
        found, open_ = _best_first(spark, edges, seeds, batch_size, max_rounds=max_rounds, state_dir=state_dir)
        if max_rounds is not None:
            found = found.join(open_.select(*KEY, F.lit(True).alias("_open")), KEY, "left")
        waiting = F.coalesce("_open", F.lit(False)) if max_rounds is not None else None
    captured = (pages if content is None else content).select(*KEY).distinct().withColumn("fetched", F.lit(True))
    return found.join(captured, KEY, "left").select(
        *KEY, F.col("depth").cast("int").alias("depth"), F.col("priority").cast("int").alias("priority"),
        "parent", F.coalesce(F.col("fetched"), F.lit(False)).alias("fetched"),
        *([waiting.alias("open")] if max_rounds is not None else []))


def _kept_rounds(spark: SparkSession, state_dir: str) -> tuple[int, DataFrame, DataFrame] | None:
    """The last finished step of a best-first crawl, what was found and what popped up to it; None for a new crawl.

    ``at`` is the round of its crawl in which a URL popped; a step of one round may lack it.
    """
    try:
        last = spark.read.schema("id long, round int").parquet(f"{state_dir}/done").agg(F.max("round")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return None

    def kept(name, schema):
        return spark.read.schema(f"{schema}, round int").parquet(f"{state_dir}/{name}").where(F.col("round") <= last)

    popped = kept("popped", "crawl_id string, url string, at int")
    return (last, kept("found", "crawl_id string, url string, priority int, depth int, parent string").drop("round"),
            popped.select(*KEY, F.coalesce("at", "round").alias("at")))


def _keep_round(state_dir: str, number: int, found: DataFrame, popped: DataFrame) -> None:
    """Write a step's rows, then the mark that it is finished; a step without its mark is written anew."""
    found.select("crawl_id", "url", F.col("priority").cast("int").alias("priority"), F.col("depth").cast("int").alias("depth"), "parent") \
        .write.mode("overwrite").parquet(f"{state_dir}/found/round={number}")
    popped.select(*KEY, F.col("at").cast("int").alias("at")).write.mode("overwrite").parquet(f"{state_dir}/popped/round={number}")
    found.sparkSession.range(1).write.mode("overwrite").parquet(f"{state_dir}/done/round={number}")


def _pop_rounds(k: int, max_rounds: int | None):
    """Rounds of one crawl over the entries and links of a step, up to the first round that needs the links of an entry not expanded.

    Rows: open entries (``depth`` given, ``base`` the rounds before), expanded
    URLs (``expanded``) and their links (``dst``). Every entry that pops before
    an entry of the step that is not expanded is in the step, so the rounds are
    exactly those of the whole queue.
    """
    def pop(rows: pa.Table) -> pa.Table:
        heap, parents, expanded, links, number = [], {}, set(), {}, 0
        for row in rows.select(["url", "priority", "depth", "parent", "base", "expanded", "dst"]).to_pylist():
            if row["dst"] is not None:
                links.setdefault(row["url"], []).append((row["dst"], row["priority"]))
                continue
            if row["expanded"]:
                expanded.add(row["url"])
            if row["depth"] is not None:
                heap.append((row["priority"], row["depth"], row["url"]))
                parents[row["url"]] = row["parent"]
                number = row["base"]
        heapq.heapify(heap)
        old, at, entry = set(parents), {}, {u: (p, d) for p, d, u in heap}
        while heap and (max_rounds is None or number < max_rounds):
            batch = [heapq.heappop(heap) for _ in range(min(k, len(heap)))]
            if not all(u in expanded for *_, u in batch):
                break
            number += 1
            found = {}
            for priority, depth, url in batch:
                at[url] = number
                for dst, to in links.get(url, ()):
                    if dst not in entry:
                        found[dst] = min(found.get(dst, (depth, priority, url, to)), (depth, priority, url, to))
            for dst, (depth, _, url, to) in found.items():
                entry[dst], parents[dst] = (to, depth + 1), url
                heapq.heappush(heap, (to, depth + 1, dst))
        out = [u for u in entry if u in at or u not in old]
        crawl = rows.column("crawl_id")[0].as_py()
        return pa.table([
            pa.array([crawl] * len(out), pa.string()), pa.array(out, pa.string()), pa.array([entry[u][0] for u in out], pa.int32()),
            pa.array([entry[u][1] for u in out], pa.int32()), pa.array([parents[u] for u in out], pa.string()),
            pa.array([u not in old for u in out], pa.bool_()), pa.array([at.get(u, 0) for u in out], pa.int32()),
        ], ["crawl_id", "url", "priority", "depth", "parent", "fresh", "at"])
    return pop


def _within(nodes: DataFrame, links: DataFrame, most: int, always: int) -> DataFrame:
    """``nodes(crawl_id, url, rank)`` that come first in their crawl with ``most`` links in all; the first ``always`` in any case."""
    degree = links.groupBy("crawl_id", F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("crawl_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    ranked = nodes.select(*KEY, "rank").join(degree, KEY, "left").withColumn("links", so_far)
    return ranked.where((F.col("rank") <= always) | (F.col("links") <= most)).select(*KEY)


def _best_first(spark, edges, seeds, k, max_rounds=None, state_dir=None, entries=STEP_ENTRIES, links_most=STEP_LINKS):
    """Rounds of the best ``k`` open entries per crawl: all that is found, and what is still open.

    A step runs many rounds at once. It takes the best ``entries`` open entries
    of every crawl and what they link to if it may pop before the next open
    entry, joins both with their links, and plays the queue's rounds on this
    bounded part (``_pop_rounds``). A crawl stops in the step at the first round
    that would need more than the step holds, and goes on in the next; the first
    round of a step is always whole. What is found is only appended (``Pieces``).
    """
    e = G.materialize(G.partitioned(edges.drop("rank"), "crawl_id", "src"), keep_partitioning=True)
    visited = G.Pieces(*KEY)
    columns = ["priority", "depth", "parent"]
    size = max(entries, k)
    counted = max_rounds is not None or state_dir is not None
    kept = _kept_rounds(spark, state_dir) if state_dir else None
    if kept:
        number, found, gone = kept
        open_ = G.materialize(visited.add(found).join(gone, KEY, "left_anti"))
        rounds = G.materialize(gone.groupBy("crawl_id").agg(F.max("at").alias("base")))
    else:
        number = 0
        open_ = visited.add(seeds.select(*KEY, F.lit(0).alias("priority"), F.lit(0).alias("depth"),
                                         F.lit(None).cast("string").alias("parent")).distinct())
        rounds = open_.select("crawl_id", F.lit(0).alias("base")).limit(0)
        if state_dir:
            _keep_round(state_dir, 0, open_, open_.select(*KEY, F.lit(0).alias("at")).limit(0))

    def links_of(nodes):
        """Links of ``nodes`` to URLs not found yet."""
        out = nodes.select("crawl_id", F.col("url").alias("src"), F.col("depth").alias("pdepth")).join(e, ["crawl_id", "src"])
        return G.checkpoint_counted(visited.missing(out.withColumnRenamed("dst", "url")).withColumnRenamed("url", "dst"))

    while True:
        top = W.frontier_batch(open_, size + 1)
        if counted:
            top = top.join(F.broadcast(rounds), "crawl_id", "left")
        top = top.withColumn("base", F.coalesce("base", F.lit(0)) if counted else F.lit(0))
        top, n = G.checkpoint_counted(top if max_rounds is None else top.where(F.col("base") < max_rounds))
        if n == 0:
            break
        beyond = top.where(F.col("rank") > size).select("crawl_id", F.struct("priority", "depth", "url").alias("next"))
        nodes = top.where(F.col("rank") <= size).select(*KEY, "depth", "rank")
        always, expanded, known = k, [], None
        for generation in range(STEP_GENERATIONS):
            links, n = links_of(nodes)
            chosen = nodes.select(*KEY)
            if n > links_most:
                chosen = G.materialize(_within(nodes, links, links_most, always))
                links = links.join(chosen.withColumnRenamed("url", "src"), ["crawl_id", "src"], "left_semi")
            expanded.append((chosen, links))
            if n == 0 or generation + 1 == STEP_GENERATIONS:
                break
            targets = links.groupBy("crawl_id", F.col("dst").alias("url")).agg(
                F.min("priority").alias("priority"), (F.min("pdepth") + 1).alias("depth"))
            if known is not None:
                targets = targets.join(known, KEY, "left_anti")
            targets = targets.join(beyond, "crawl_id", "left").where(
                F.col("next").isNull() | (F.struct("priority", "depth", "url") < F.col("next"))).drop("next")
            nodes, n = G.checkpoint_counted(W.frontier_batch(targets, size))
            if n == 0:
                break
            known = nodes.select(*KEY) if known is None else known.unionByName(nodes.select(*KEY))
            always = 0
        rows = top.select(*KEY, F.col("priority").cast("int").alias("priority"), F.col("depth").cast("int").alias("depth"), "parent",
                          F.col("base").cast("int").alias("base"), F.lit(False).alias("expanded"), F.lit(None).cast("string").alias("dst"))
        for chosen, links in expanded:
            rows = rows.unionByName(chosen.select(*KEY, F.lit(True).alias("expanded")), allowMissingColumns=True)
            rows = rows.unionByName(links.select("crawl_id", F.col("src").alias("url"), F.col("priority").cast("int").alias("priority"), "dst"),
                                    allowMissingColumns=True)
        step = G.materialize(rows.groupBy("crawl_id").applyInArrow(
            _pop_rounds(k, max_rounds), "crawl_id string, url string, priority int, depth int, parent string, fresh boolean, at int"))
        popped, found = step.where(F.col("at") > 0).select(*KEY, "at"), visited.add(step.where("fresh").select(*KEY, *columns))
        number += 1
        if state_dir:
            _keep_round(state_dir, number, found, popped)
        if counted:
            rounds = G.materialize(rounds.unionByName(popped.select("crawl_id", F.col("at").alias("base"))).groupBy("crawl_id").agg(F.max("base").alias("base")))
        open_ = G.materialize(open_.select(*KEY, *columns).join(popped.select(*KEY), KEY, "left_anti").unionByName(
            step.where("fresh and at = 0").select(*KEY, *columns)))
    return visited.rows(), open_


def dead_links(crawl: DataFrame) -> DataFrame:
    """URLs discovered by the crawl whose fetch failed (they stay pending); of a stopped crawl not those still open."""
    done = crawl.where(~F.col("open")) if "open" in crawl.columns else crawl
    return done.where(~F.col("fetched")).select(*KEY, "depth", "parent")
