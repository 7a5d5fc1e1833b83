"""Derived test tables of FIXTURES.md, as Spark DataFrames and as DuckDB SQL text.

The given ``pages`` table has no link between its pages, so F3 re-keys the
pages of each host into a closed site; F4 derives a fetch log and F5 a crawl
state from it. Each builder has a DuckDB twin (a ``WITH`` prefix) used by the
oracle queries, so both engines start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators.frontier import rank_within
from sitegraph.operators.graph import materialize

# --- fixed values of the fixtures (FIXTURES.md) ---
FIXTURE_HREF_RE = r'<a[^>]*? href="([^"]*)"'
RFC3986_RE = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
SURPLUS_LINKS = 8
CONTENT_TYPES = ["text/html; charset=utf-8", "text/css", "application/javascript", "image/png", ""]
# --- end of fixed values ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ F3 closed site

def fixture_links(pages: DataFrame) -> DataFrame:
    """(page_id, netloc, pos, href) with the fixture's plain href pattern."""
    p = pages.select("page_id", F.regexp_extract("url", RFC3986_RE, 4).alias("netloc"), "html")
    return p.select(
        "page_id", "netloc",
        F.posexplode(F.regexp_extract_all("html", F.lit(FIXTURE_HREF_RE), 1)).alias("pos", "href"),
    )


def closed_site(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``site(crawl_id, netloc, page_id, url, k, surplus)`` and ``edges(crawl_id, netloc, src, dst)``.

    ``k`` numbers a host's pages from 0, the root. A host has more pages than
    distinct links at times: such a surplus page gets the URL ``/p/<page_id>``
    and a link from the page numbered ``k / 8``.
    """
    p = pages.select("page_id", F.regexp_extract("url", RFC3986_RE, 4).alias("netloc"))
    links = materialize(fixture_links(pages).select("page_id", "netloc", "href"))  # read twice: the HTML is parsed once
    # numbering within a host with the skew-safe rank (a host may hold a third of all pages)
    t = rank_within(links.select("netloc", "href").distinct(), ["href"], "netloc").withColumnRenamed("rank", "k")
    r = rank_within(p, ["page_id"], "netloc").select("page_id", "netloc", (F.col("rank") - 1).alias("k"))
    home = F.concat(F.lit("https://"), "netloc", F.lit("/"))
    site = r.join(t, ["netloc", "k"], "left").select(
        "netloc", "page_id", "k", ((F.col("k") > 0) & F.col("href").isNull()).alias("surplus"),
        F.when(F.col("k") == 0, home).when(F.col("href").isNotNull(), F.concat(F.lit("https://"), "netloc", "href"))
        .otherwise(F.concat(home, F.lit("p/"), F.col("page_id").cast("string"))).alias("url"),
    ).withColumn("crawl_id", U.crawl_key(home))
    site = materialize(site)  # the edges are made from it, too
    found = site.join(links.select("page_id", "href"), "page_id").select(
        "crawl_id", "netloc", F.col("url").alias("src"), F.concat(F.lit("https://"), "netloc", "href").alias("dst"))
    added = _surplus_links(site).select("crawl_id", "netloc", "src", "dst")
    return site, found.unionByName(added).distinct()


def _surplus_links(site: DataFrame) -> DataFrame:
    """``crawl_id, netloc, src, src_id, dst, dst_id`` of the links to surplus pages: at most eight from a page."""
    below = site.where("surplus").select("netloc", F.expr(f"k div {SURPLUS_LINKS}").alias("k"), F.col("url").alias("dst"), F.col("page_id").alias("dst_id"))
    return site.select("crawl_id", "netloc", "k", F.col("url").alias("src"), F.col("page_id").alias("src_id")).join(below, ["netloc", "k"])


def site_pages(pages: DataFrame, site: DataFrame) -> DataFrame:
    """Captured content of the closed site, links to surplus pages at its end: (crawl_id, url, html)."""
    tags = F.array_join(F.transform(F.array_sort(F.collect_list("dst_id")), lambda i: F.concat(
        F.lit('<a href="/p/'), i.cast("string"), F.lit('"></a>'))), "")
    more = _surplus_links(site).groupBy(F.col("src_id").alias("page_id")).agg(tags.alias("more"))
    return site.join(more, "page_id", "left").select("crawl_id", "url", "page_id", "more").join(
        pages.select("page_id", "html"), "page_id").select("crawl_id", "url", F.concat("html", F.coalesce("more", F.lit(""))).alias("html"))


def roots(site: DataFrame) -> DataFrame:
    """Start URL of every crawl: (crawl_id, netloc, url)."""
    return site.where(F.col("url") == F.concat(F.lit("https://"), "netloc", F.lit("/"))).select(
        "crawl_id", "netloc", "url")


SQL_F3 = r"""
p as (select page_id, url, html,
        regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 4) as netloc
      from pages),
l as (select page_id, netloc, cast(generate_subscripts(hs, 1) - 1 as bigint) as pos, unnest(hs) as href
      from (select page_id, netloc, regexp_extract_all(html, '<a[^>]*? href="([^"]*)"', 1) as hs from p) q),
t as (select netloc, href, row_number() over (partition by netloc order by href) as k
      from (select distinct netloc, href from l) x),
r as (select page_id, netloc, row_number() over (partition by netloc order by page_id) - 1 as k from p),
site as (select r.netloc, r.page_id,
           case when r.k = 0 then concat('https://', r.netloc, '/') when t.href is not null then concat('https://', r.netloc, t.href)
                else concat('https://', r.netloc, '/p/', r.page_id) end as url,
           sha256(concat('https://', r.netloc, '/')) as crawl_id, r.k, r.k > 0 and t.href is null as surplus
         from r left join t on r.netloc = t.netloc and r.k = t.k),
more as (select s.crawl_id, s.netloc, s.url as src, s.page_id as src_id, c.url as dst, c.page_id as dst_id
         from site s join site c on c.surplus and c.netloc = s.netloc and c.k // 8 = s.k),
edges as (select s.crawl_id, s.netloc, s.url as src, concat('https://', s.netloc, l.href) as dst
          from site s join l on s.page_id = l.page_id
          union select crawl_id, netloc, src, dst from more),
content as (select s.crawl_id, s.url, p.html || coalesce(m.tags, '') as html from site s join p on p.page_id = s.page_id
            left join (select src_id, string_agg('<a href="/p/' || dst_id || '"></a>', '' order by dst_id) as tags from more group by src_id) m
              on m.src_id = s.page_id),
roots as (select crawl_id, netloc, url from site where url = concat('https://', netloc, '/'))
"""


# ------------------------------------------------------------------ F5 crawl state

def crawl_state(pages: DataFrame, site: DataFrame | None = None,
                edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``url_state(crawl_id, url, path)``, ``completed(crawl_id, url)``, ``active(crawl_id, url)``.

    ``path`` is the saved file of a completed URL and null for a URL only discovered.
    """
    if site is None or edges is None:
        site, edges = closed_site(pages)
    completed = site.where(F.col("page_id") % 3 != 0).select("crawl_id", "url")
    active = site.where(F.col("page_id") % 5 == 0).select("crawl_id", "url")
    urls = site.select("crawl_id", "url").unionByName(
        edges.select("crawl_id", F.col("dst").alias("url"))).distinct()
    done = completed.withColumn("done", F.lit(True))
    url_state = urls.join(done, ["crawl_id", "url"], "left").select(
        "crawl_id", "url", F.when(F.col("done"), U.local_path(F.col("url"))).alias("path"))
    return url_state, completed, active


def _sql_path_steps(u: str) -> tuple[str, str]:
    """DuckDB text of rules U3a-U3c for URLs without ``;params``: (name before the long rule, netloc)."""
    path = f"regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#(.*))?', 5)"
    query = f"regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#(.*))?', 7)"
    net = f"regexp_extract({u}, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\\?([^#]*))?(#(.*))?', 4)"
    s1 = (f"(case when {path} = '' or ends_with({path}, '/') then {path} || 'index.html' "
          f"when not contains(regexp_extract({path}, '[^/]*$'), '.') or regexp_matches({path}, '\\.(php|pl)$') "
          f"then {path} || '.html' else {path} end)")
    ext = f"regexp_extract(regexp_extract({s1}, '[^/]*$'), '^\\.*[^.].*(\\.[^.]*)$', 1)"
    s2 = (f"(case when {query} <> '' then left({s1}, length({s1}) - length({ext})) || '_' || "
          f"md5({query}) || {ext} else {s1} end)")
    return s2, net


def sql_local_name(u: str) -> str:
    return _sql_path_steps(u)[0]


def sql_local_path(u: str) -> str:
    """DuckDB text of the local-path rules for URLs without ``;params`` (enough for the fixtures)."""
    s2, net = _sql_path_steps(u)
    ext2 = f"regexp_extract(regexp_extract({s2}, '[^/]*$'), '^\\.*[^.].*(\\.[^.]*)$', 1)"
    s3 = f"(case when length(regexp_extract({s2}, '[^/]*$')) > 255 then md5({s2}) || {ext2} else {s2} end)"
    rel = f"ltrim({s3}, '/')"
    return f"(case when {net} <> '' then {net} || '/' || {rel} else {rel} end)"


def sql_relpath(path: str, start: str) -> str:
    """DuckDB text of the relative path from folder ``start`` to ``path``, neither with dot segments."""
    a, b = f"(case when {start} = '' then [] else string_split({start}, '/') end)", f"string_split({path}, '/')"
    same = (f"coalesce(list_min(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] <> {b}[i])) - 1, "
            f"least(len({a}), len({b})))")
    return f"(repeat('../', len({a}) - {same}) || array_to_string({b}[{same} + 1:], '/'))"


def sql_dirname(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


SQL_F5 = SQL_F3 + f""",
completed as (select crawl_id, url from site where page_id % 3 <> 0),
active as (select crawl_id, url from site where page_id % 5 = 0),
all_urls as (select crawl_id, url from site union select crawl_id, dst from edges),
url_state as (select a.crawl_id, a.url, case when c.url is not null then {sql_local_path('a.url')} end as path
              from all_urls a left join completed c on a.crawl_id = c.crawl_id and a.url = c.url)
"""


# ------------------------------------------------------------------ F4 fetch log

def fetch_log(pages: DataFrame) -> DataFrame:
    """five potential attempts per page; (url, attempt, status, error, content_type)."""
    k = F.col("page_id") % 12
    a = F.col("attempt")
    status = (
        F.when(k == 0, 404).when(k == 1, 500).when(k == 3, F.when(a <= 2, 503).otherwise(200))
        .when(k == 4, F.when(a == 1, None).otherwise(200)).when(k == 5, 204)
        .when(k == 7, F.when(a <= 4, 503)).when(k >= 8, 200)
    ).cast("int")
    error = F.when(k == 2, "timeout").when((k == 4) & (a == 1), "timeout").when(k == 6, "other") \
        .when((k == 7) & (a == 5), "timeout")
    ct = F.element_at(F.array(*[F.lit(c) for c in CONTENT_TYPES]), (F.col("page_id") % 5 + 1).cast("int"))
    return (
        pages.select("page_id", "url")
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(5))))
        .select("url", "attempt", status.alias("status"), error.alias("error"), ct.alias("content_type"))
    )


SQL_F4 = """
fetch_log as (
  select url, cast(attempt as integer) as attempt,
    cast(case when k = 0 then 404 when k = 1 then 500 when k = 3 then (case when attempt <= 2 then 503 else 200 end)
         when k = 4 then (case when attempt = 1 then null else 200 end) when k = 5 then 204
         when k = 7 then (case when attempt <= 4 then 503 end) when k >= 8 then 200 end as integer) as status,
    case when k = 2 then 'timeout' when k = 4 and attempt = 1 then 'timeout' when k = 6 then 'other'
         when k = 7 and attempt = 5 then 'timeout' end as error,
    case page_id % 5 when 0 then 'text/html; charset=utf-8' when 1 then 'text/css'
         when 2 then 'application/javascript' when 3 then 'image/png' else '' end as content_type
  from (select page_id, url, page_id % 12 as k, unnest(range(1, 6)) as attempt from pages) x)
"""
