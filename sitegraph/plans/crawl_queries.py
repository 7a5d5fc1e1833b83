"""Registered queries on the closed site (F3), its crawl state (F5) and the link-graph loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import crawl as C
from sitegraph.operators import frontier as W
from sitegraph.operators import graph as G
from sitegraph.operators import state as S
from sitegraph.plans import fixtures as FX
from sitegraph.plans.mirror_job import site_resources
from sitegraph.plans.registry import BATCH, EXCLUDED, WEIGHTS, register
from sitegraph.session import checkpoint_dir
from sitegraph.sources.tables import read_pages
from sitegraph.streaming import crawl as SC


def _prio_sql(u: str) -> str:
    arms = " ".join(f"when contains({u}, '{w}') then {i}" for i, w in enumerate(WEIGHTS))
    return f"cast(case {arms} else {len(WEIGHTS)} end as integer)"


def _excl_sql(u: str) -> str:
    return "(" + " or ".join(f"contains({u}, '{x}')" for x in EXCLUDED) + ")"


F5 = "with " + FX.SQL_F5.strip()
F5R = "with recursive " + FX.SQL_F5.strip()


_FIXTURE_CACHE: dict = {}


def _site(spark: SparkSession, sf_dir: str):
    """F3 materialised once per session and data folder (reliable checkpoints), shared by the queries.

    Fixture derivation is test-data preparation, not an operator under test;
    building it once keeps every query from re-deriving it several times.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "site")
    if key not in _FIXTURE_CACHE:
        pages = read_pages(spark, sf_dir)
        site, edges = FX.closed_site(pages)
        _FIXTURE_CACHE.clear()
        _FIXTURE_CACHE[key] = (pages, site, G.materialize(edges))
    return _FIXTURE_CACHE[key]


def _state(spark: SparkSession, sf_dir: str):
    pages, site, edges = _site(spark, sf_dir)
    return FX.crawl_state(pages, site, edges)


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every discovered link target as a depth-1 frontier entry, completed ones dropped (P5)."""
    _, _, edges = _site(spark, sf_dir)
    _, completed, _ = _state(spark, sf_dir)
    f = edges.select("crawl_id", F.col("dst").alias("url")).distinct().select(
        "crawl_id", "url", U.url_priority(F.col("url"), WEIGHTS).cast("int").alias("priority"),
        F.lit(1).alias("depth"))
    return W.open_frontier(f, completed)


SQL_FRONTIER = """,
frontier as (select distinct e.crawl_id, e.dst as url, {prio} as priority, 1 as depth from edges e
             where not exists (select 1 from completed c where c.crawl_id = e.crawl_id and c.url = e.dst))
""".format(prio=_prio_sql("e.dst"))


# ------------------------------------------------------------------ state

@register("state_load", F5 + """
select crawl_id, url, path from url_state where path is not null and path <> ''""")
def q_state_load(spark, sf_dir):
    """Write the F5 state as a snapshot, load it back, keep the path map (saved URLs)."""
    url_state, completed, _ = _state(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/state-snapshot-{uuid.uuid4().hex}"
    S.save_state(url_state, completed, root)
    loaded, _ = S.load_state(spark, root)
    return S.path_map(loaded).select("crawl_id", "url", "path")


@register("state_upsert", F5 + f""",
batch as (select crawl_id, url, {FX.sql_local_path('url')} as path from site where page_id % 3 = 0)
select coalesce(s.crawl_id, b.crawl_id) as crawl_id, coalesce(s.url, b.url) as url, coalesce(b.path, s.path) as path
from url_state s full join batch b on s.crawl_id = b.crawl_id and s.url = b.url""")
def q_state_upsert(spark, sf_dir):
    """Save the not-yet-completed site pages and record their paths."""
    pages, site, _ = _site(spark, sf_dir)
    url_state, completed, _ = _state(spark, sf_dir)
    batch = site.where(F.col("page_id") % 3 == 0).select("crawl_id", "url", U.local_path(F.col("url")).alias("path"))
    state, _ = S.upsert_paths(url_state, completed, batch)
    return state


@register("state_lookup", F5 + """,
k as (select distinct crawl_id, dst as url from edges)
select k.crawl_id, k.url, s.path from k left join url_state s on s.crawl_id = k.crawl_id and s.url = k.url""")
def q_state_lookup(spark, sf_dir):
    """J4 get: recorded path of every link target."""
    _, _, edges = _site(spark, sf_dir)
    url_state, _, _ = _state(spark, sf_dir)
    keys = edges.select("crawl_id", F.col("dst").alias("url")).distinct()
    return S.lookup(url_state, keys)


@register("state_delete", F5 + """
select s.crawl_id, s.url, s.path from url_state s
where not exists (select 1 from active a where a.crawl_id = s.crawl_id and a.url = s.url)""")
def q_state_delete(spark, sf_dir):
    """J4 remove: drop the URLs in progress from the state."""
    url_state, _, active = _state(spark, sf_dir)
    return S.delete(url_state, active)


_SUMMARY_SQL = """,
failed as (select s.crawl_id, s.url from url_state s
           where not exists (select 1 from site t where t.crawl_id = s.crawl_id and t.url = s.url)),
st as (select s.crawl_id, s.url, c.url is not null as done, f.url is not null as bad from url_state s
       left join completed c on c.crawl_id = s.crawl_id and c.url = s.url
       left join failed f on f.crawl_id = s.crawl_id and f.url = s.url),
summary as (select crawl_id, cast(count(*) as bigint) as visited, cast(count(*) filter (where done) as bigint) as completed,
              cast(count(*) filter (where not done) as bigint) as pending,
              cast(count(*) filter (where bad and not done) as bigint) as failed
            from st group by crawl_id)
"""


def _failed(spark, sf_dir):
    """URLs whose fetch fails: discovered targets that are not captured pages."""
    _, site, _ = _site(spark, sf_dir)
    url_state, _, _ = _state(spark, sf_dir)
    return url_state.select("crawl_id", "url").join(site.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti")


@register("crawl_summary", F5 + _SUMMARY_SQL + """
select crawl_id, visited, completed, pending, failed, pending = failed as complete from summary""")
def q_crawl_summary(spark, sf_dir):
    """Per-crawl counters and the completion flag (failures counted apart)."""
    url_state, completed, _ = _state(spark, sf_dir)
    return S.crawl_summary(url_state, completed, _failed(spark, sf_dir))


@register("crawl_seeds", F5 + _SUMMARY_SQL + f"""
select r.crawl_id, r.url, 0 as priority, 0 as depth from roots r
where not {_excl_sql('r.url')}
  and not exists (select 1 from summary m where m.crawl_id = r.crawl_id and m.pending = m.failed)
  and not exists (select 1 from edges e where e.crawl_id = r.crawl_id and e.dst = r.url)""")
def q_crawl_seeds(spark, sf_dir):
    """Start URLs to enqueue: crawl not complete, start not excluded and not yet linked to."""
    _, site, edges = _site(spark, sf_dir)
    url_state, completed, _ = _state(spark, sf_dir)
    summary = S.crawl_summary(url_state, completed, _failed(spark, sf_dir))
    visited = edges.select("crawl_id", F.col("dst").alias("url"))
    return S.crawl_seeds(FX.roots(site), visited, EXCLUDED, summary)


@register("new_links", F5 + """
select distinct e.crawl_id, e.src, e.dst as url from edges e
where not exists (select 1 from completed c where c.crawl_id = e.crawl_id and c.url = e.dst)
  and not exists (select 1 from active a where a.crawl_id = e.crawl_id and a.url = e.dst)""")
def q_new_links(spark, sf_dir):
    """Links whose target is neither completed nor in progress."""
    _, _, edges = _site(spark, sf_dir)
    _, completed, active = _state(spark, sf_dir)
    links = edges.select("crawl_id", "src", F.col("dst").alias("url"))
    return S.new_links(links, completed.unionByName(active))


@register("frontier_open", F5 + SQL_FRONTIER + "select crawl_id, url, priority, depth from frontier")
def q_frontier_open(spark, sf_dir):
    """P5: the frontier without completed URLs."""
    return _frontier(spark, sf_dir)


@register("frontier_rank", F5 + SQL_FRONTIER + """
select crawl_id, url, priority, depth,
       row_number() over (partition by crawl_id order by priority, depth, url) as rank from frontier""")
def q_frontier_rank(spark, sf_dir):
    """Pop order of every frontier entry within its crawl."""
    return W.frontier_rank(_frontier(spark, sf_dir)).select("crawl_id", "url", "priority", "depth", "rank")


@register("frontier_batch", F5 + SQL_FRONTIER + f"""
select * from (select crawl_id, url, priority, depth,
       row_number() over (partition by crawl_id order by priority, depth, url) as rank from frontier) x
where rank <= {BATCH}""")
def q_frontier_batch(spark, sf_dir):
    """The next batch (max_connections) each crawl pops."""
    return W.frontier_batch(_frontier(spark, sf_dir), BATCH).select("crawl_id", "url", "priority", "depth", "rank")


@register("pending_urls", F5 + """
select s.crawl_id, s.url from url_state s
where not exists (select 1 from completed c where c.crawl_id = s.crawl_id and c.url = s.url)""")
def q_pending_urls(spark, sf_dir):
    """O1: visited minus completed."""
    url_state, completed, _ = _state(spark, sf_dir)
    return S.pending_urls(url_state, completed)


@register("resume_frontier", F5 + f""",
pend as (select s.crawl_id, s.url from url_state s
         where not exists (select 1 from completed c where c.crawl_id = s.crawl_id and c.url = s.url))
select crawl_id, url, {_prio_sql('url')} as priority, 0 as depth from pend where not {_excl_sql('url')}
union all
select r.crawl_id, r.url, 0, 0 from roots r
where not {_excl_sql('r.url')} and not exists (select 1 from url_state s where s.crawl_id = r.crawl_id and s.url = r.url)""")
def q_resume_frontier(spark, sf_dir):
    """O2: what a resumed crawl queues: pending URLs at depth 0, plus unvisited starts."""
    _, site, _ = _site(spark, sf_dir)
    url_state, completed, _ = _state(spark, sf_dir)
    out = S.resume_frontier(url_state, completed, FX.roots(site), WEIGHTS, EXCLUDED)
    return out.select("crawl_id", "url", F.col("priority").cast("int").alias("priority"),
                      F.col("depth").cast("int").alias("depth"))


@register("relative_path_state", F5 + """
select e.crawl_id, e.src, e.dst, a.path as src_path, b.path as dst_path,
       case when a.path is not null and a.path <> '' and b.path is not null and b.path <> ''
            then """ + FX.sql_relpath("b.path", FX.sql_dirname("a.path")) + """ end as rel_path
from edges e
left join url_state a on a.crawl_id = e.crawl_id and a.url = e.src and a.path is not null and a.path <> ''
left join url_state b on b.crawl_id = e.crawl_id and b.url = e.dst and b.path is not null and b.path <> ''""")
def q_relative_path_state(spark, sf_dir):
    """Link between two saved files as a relative path (null unless both ends are saved)."""
    _, _, edges = _site(spark, sf_dir)
    url_state, _, _ = _state(spark, sf_dir)
    return S.relative_paths(edges.select("crawl_id", "src", "dst"), url_state).select(
        "crawl_id", "src", "dst", "src_path", "dst_path", "rel_path")


@register("replay_fetch", F5 + SQL_FRONTIER + f""",
batch as (select * from (select crawl_id, url, priority, depth,
          row_number() over (partition by crawl_id order by priority, depth, url) as rank from frontier) x
          where rank <= {BATCH})
select b.crawl_id, b.url, c.html is not null as fetched, cast(length(c.html) as bigint) as n_chars
from batch b left join content c on c.crawl_id = b.crawl_id and c.url = b.url""")
def q_replay_fetch(spark, sf_dir):
    """Fetch the next batch of every crawl from the captured pages."""
    pages, site, _ = _site(spark, sf_dir)
    batch = W.frontier_batch(_frontier(spark, sf_dir), BATCH)
    got = C.replay_fetch(batch, FX.site_pages(pages, site))
    return got.select("crawl_id", "url", "fetched", F.length("html").cast("bigint").alias("n_chars"))


@register("claim_urls", F5 + """
select distinct s.crawl_id, s.url from site s
where not exists (select 1 from active a where a.crawl_id = s.crawl_id and a.url = s.url)""")
def q_claim_urls(spark, sf_dir):
    """Claim every site URL for download; URLs in progress are refused."""
    _, site, _ = _site(spark, sf_dir)
    _, _, active = _state(spark, sf_dir)
    return W.claim_urls(site.select("crawl_id", "url"), active)


# ------------------------------------------------------------------ graph loops

def _bfs_sql(start_filter: str = "") -> str:
    return f""",
bfs(crawl_id, url, depth) using key (crawl_id, url) as (
  select crawl_id, url, 0 from roots r {start_filter}
  union
  select e.crawl_id, e.dst, min(b.depth) + 1 from bfs b join edges e on e.crawl_id = b.crawl_id and e.src = b.url
  where e.src <> e.dst and not exists (select 1 from recurring.bfs x where x.crawl_id = e.crawl_id and x.url = e.dst)
  group by e.crawl_id, e.dst),
tree as (select b.crawl_id, b.url, b.depth,
           (select arg_min(e.src, ({_prio_sql('e.src')}, e.src)) from edges e join bfs p on p.crawl_id = e.crawl_id and p.url = e.src and p.depth = b.depth - 1
            where e.crawl_id = b.crawl_id and e.dst = b.url and e.src <> e.dst) as parent
         from bfs b)
"""


_REACH_SQL = """,
links as (select distinct crawl_id, src, dst from edges where src <> dst),
reach(crawl_id, start, url) as (
  select crawl_id, src, dst from links
  union select r.crawl_id, r.start, l.dst from reach r join links l on l.crawl_id = r.crawl_id and l.src = r.url)
"""


@register("has_path", F5R + _REACH_SQL + """,
asked as (select s.crawl_id, r.url as start, s.url as "end" from url_state s join roots r on r.crawl_id = s.crawl_id
          union select crawl_id, dst, src from edges)
select a.crawl_id, a.start, a."end", a.start = a."end" or r.url is not null as reachable
from asked a left join reach r on r.crawl_id = a.crawl_id and r.start = a.start and r.url = a."end" """)
def q_has_path(spark, sf_dir):
    """From its crawl's start to each known URL, and from each link's target back to its page."""
    _, site, edges = _site(spark, sf_dir)
    url_state, _, _ = _state(spark, sf_dir)
    q = url_state.select("crawl_id", F.col("url").alias("end")).join(
        FX.roots(site).select("crawl_id", F.col("url").alias("start")), "crawl_id").select("crawl_id", "start", "end")
    q = q.unionByName(edges.select("crawl_id", F.col("dst").alias("start"), F.col("src").alias("end"))).distinct()
    return G.has_path(spark, edges.select("crawl_id", "src", "dst"), q, nodes=site.select("crawl_id", "url"))


@register("cycle_check", F5R + _REACH_SQL + """,
asked as (select crawl_id, src, dst from edges union select crawl_id, dst, src from edges
          union select s.crawl_id, s.url, r.url from url_state s join roots r on r.crawl_id = s.crawl_id)
select a.crawl_id, a.src, a.dst, a.src = a.dst or r.url is not null as creates_cycle
from asked a left join reach r on r.crawl_id = a.crawl_id and r.start = a.dst and r.url = a.src""")
def q_cycle_check(spark, sf_dir):
    """Would a link close a cycle, asked for every link, for every link reversed, and for a link from every URL to its start?"""
    _, site, edges = _site(spark, sf_dir)
    url_state, _, _ = _state(spark, sf_dir)
    links = edges.select("crawl_id", "src", "dst")
    home = url_state.select("crawl_id", F.col("url").alias("src")).join(
        FX.roots(site).select("crawl_id", F.col("url").alias("dst")), "crawl_id").select("crawl_id", "src", "dst")
    asked = links.unionByName(edges.select("crawl_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(home).distinct()
    return G.cycle_check(spark, links, asked)


@register("graph_remove", F5 + """
select e.crawl_id, e.src, e.dst from edges e
where not exists (select 1 from active a where a.crawl_id = e.crawl_id and a.url = e.src)
  and not exists (select 1 from active a where a.crawl_id = e.crawl_id and a.url = e.dst)""")
def q_graph_remove(spark, sf_dir):
    """The link graph after the in-progress URLs finish (node and all its edges dropped)."""
    _, _, edges = _site(spark, sf_dir)
    _, _, active = _state(spark, sf_dir)
    return G.graph_remove(edges.select("crawl_id", "src", "dst"), active)


@register("discovery_tree", F5R + _bfs_sql() + "select crawl_id, url, depth, parent from tree")
def q_discovery_tree(spark, sf_dir):
    """G1: BFS discovery forest from every start: depth and first discoverer."""
    _, site, edges = _site(spark, sf_dir)
    starts = FX.roots(site).select("crawl_id", F.col("url").alias("start"))
    t = G.discovery_tree(spark, edges.select("crawl_id", "src", "dst"), starts, weights=WEIGHTS)
    return t.select("crawl_id", "url", "depth", "parent")


@register("acyclic_edges", F5R + _bfs_sql() + """,
d as (select crawl_id, url, depth from bfs),
j as (select distinct e.crawl_id, e.src, e.dst, coalesce(a.depth, 2147483647) as sd, coalesce(b.depth, 2147483647) as td
      from edges e left join d a on a.crawl_id = e.crawl_id and a.url = e.src
      left join d b on b.crawl_id = e.crawl_id and b.url = e.dst where e.src <> e.dst)
select crawl_id, src, dst from j where sd < td or (sd = td and src < dst)""")
def q_acyclic_edges(spark, sf_dir):
    """The largest rank-consistent (hence acyclic) subset of the link graph."""
    _, site, edges = _site(spark, sf_dir)
    starts = FX.roots(site).select("crawl_id", F.col("url").alias("start"))
    return G.acyclic_edges(spark, edges.select("crawl_id", "src", "dst"), starts)


_REPLAY_SQL = _bfs_sql() + f""",
crawl as (select t.crawl_id, t.url, cast(t.depth as integer) as depth,
            case when t.depth = 0 then 0 else {_prio_sql('t.url')} end as priority, t.parent,
            exists (select 1 from site s where s.crawl_id = t.crawl_id and s.url = t.url) as fetched
          from tree t)
"""


def _replay(spark, sf_dir, **options):
    pages, site, _ = _site(spark, sf_dir)
    return C.replay_crawl(spark, FX.site_pages(pages, site), FX.roots(site).select("crawl_id", "url"), WEIGHTS, **options)


@register("replay_crawl", F5R + _REPLAY_SQL + "select crawl_id, url, depth, priority, parent, fetched from crawl")
def q_replay_crawl(spark, sf_dir):
    """Crawl every site from its start over the captured pages (whole BFS levels per round)."""
    return _replay(spark, sf_dir)


@register("replay_crawl_batch", F5R + _REPLAY_SQL + "select crawl_id, url, priority, fetched from crawl")
def q_replay_crawl_batch(spark, sf_dir):
    """G8 best-first: the best BATCH open URLs of every crawl a round; depth and parent depend on the order, the rest not."""
    return _replay(spark, sf_dir, batch_size=BATCH).select("crawl_id", "url", "priority", "fetched")


@register("stream_crawl", F5R + _REPLAY_SQL + "select crawl_id, url, depth, priority, parent, fetched from crawl")
def q_stream_crawl(spark, sf_dir):
    """The crawl as a stream whose found URLs are its own input; stopped after the starts and continued from its checkpoint."""
    pages, site, _ = _site(spark, sf_dir)
    captured, starts = FX.site_pages(pages, site), FX.roots(site).select("crawl_id", "url")
    links = G.materialize(C.page_links(captured, starts, WEIGHTS))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-crawl-{uuid.uuid4().hex}"
    SC.start_crawl(spark, links, starts, f"{folder}/found", f"{folder}/checkpoint", available_now=True).awaitTermination()
    stream = SC.start_crawl(spark, links, starts, f"{folder}/found", f"{folder}/checkpoint")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    there = site.select("crawl_id", "url").distinct().withColumn("there", F.lit(True))
    return SC.found(spark, f"{folder}/found").join(there, ["crawl_id", "url"], "left").select(
        "crawl_id", "url", "depth", "priority", "parent", F.coalesce("there", F.lit(False)).alias("fetched"))


@register("mirror_site", F5R + _REPLAY_SQL + f""",
saved as (select c.crawl_id, c.url, p.html from crawl c join content p on p.crawl_id = c.crawl_id and p.url = c.url where c.fetched)
select crawl_id, url, {FX.sql_local_path('url')} as path,
       regexp_replace(regexp_replace(regexp_replace(html, '<a href="/p/([0-9]+)"', '<a href="' || case when up = '' then 'p/' else '' end || '\\1.html"', 'g'),
                                     '<a href="/([^"./]*)"', '<a href="' || up || '\\1.html"', 'g'),
                      '<a href="/([^"/]*)"', '<a href="' || up || '\\1"', 'g') as html
from (select *, case when regexp_matches(url, '/p/[0-9]+$') then '../' else '' end as up from saved)""")
def q_mirror_site(spark, sf_dir):
    """G8 + X4 + U3: every page that the crawls reach, with its file and its links pointing at the local copies."""
    pages, site, _ = _site(spark, sf_dir)
    captured = FX.site_pages(pages, site).select("crawl_id", *[
        F.col("url"), F.col("html"), F.lit("text/html").alias("content_type"), F.lit(None).cast("binary").alias("body")])
    _, resources = site_resources(spark, captured, FX.roots(site).select("crawl_id", "url"), WEIGHTS)
    return resources.select("crawl_id", "url", U.local_path(F.col("url")).alias("path"), "html")


@register("dead_links", F5R + _REPLAY_SQL + "select crawl_id, url, depth, parent from crawl where not fetched")
def q_dead_links(spark, sf_dir):
    """URLs the crawl discovered but could not fetch."""
    return C.dead_links(_replay(spark, sf_dir))
