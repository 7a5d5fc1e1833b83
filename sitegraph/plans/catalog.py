"""Registered queries: one Spark plan per operator key, with its DuckDB oracle text.

Every query reads the given tables (or tables Spark derives from them) in
full. Oracles are written independently in DuckDB SQL from the operator's
definition on the shapes the given data holds (root-relative ``<a href>``
links, no ``;params``); the general cases are covered by the pytest suite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import layout as K
from sitegraph.operators import links as X
from sitegraph.operators import state as S
from sitegraph.plans import fixtures as FX
from sitegraph.sources.tables import read_pages

from sitegraph.plans.registry import EXCLUDED, ORACLES, QUERIES, WEIGHTS, register  # noqa: F401


# ------------------------------------------------------------------ SQL snippets

RFC = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"


LONGER = 260  # characters added to a link to pass the file-name limit
# every third page again under a URL that differs in its fragment only: both claim one file
SQL_TWICE = """
pv as (select page_id, url, html from pages
       union all select page_id + 1000000000, url || '#top', html from pages where page_id % 3 = 0)"""


def _twice(pages: DataFrame) -> DataFrame:
    again = pages.where(F.col("page_id") % 3 == 0).select(
        (F.col("page_id") + 1000000000).alias("page_id"), F.concat("url", F.lit("#top")).alias("url"), "html")
    return pages.select("page_id", "url", "html").unionByName(again)


def sql_part(u: str, g: int) -> str:
    return f"regexp_extract({u}, {RFC}, {g})"


def sql_priority(u: str) -> str:
    arms = " ".join(f"when contains({u}, '{w}') then {i}" for i, w in enumerate(WEIGHTS))
    return f"cast(case {arms} else {len(WEIGHTS)} end as integer)"


def sql_excluded(u: str) -> str:
    return "(" + " or ".join(f"contains({u}, '{x}')" for x in EXCLUDED) + ")"


SQL_LINKS = rf"""
p as (select page_id, url, html, lower({sql_part('url', 2)}) as scheme, {sql_part('url', 4)} as netloc,
             {sql_part('url', 5)} as upath from pages),
raw as (select page_id, url as page_url, scheme, netloc, upath, cast(generate_subscripts(hs, 1) - 1 as bigint) as pos,
               unnest(hs) as href
        from (select *, regexp_extract_all(html, '<a[^>]*? href="([^"]*)"', 1) as hs from p) q),
rl as (select *, scheme || '://' || netloc || href as link from raw where href <> '' and not starts_with(href, '#'))
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, sf_dir)


def _links(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return X.extract_links(_pages(spark, sf_dir), weights=WEIGHTS, **kw)


def _resolved_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link with its resolved URL, before the domain and exclusion filters."""
    raw = X.raw_links(_pages(spark, sf_dir), resolve=True)
    return raw.where((F.col("href") != "") & ~F.col("href").startswith("#") & F.col("url").isNotNull())


# ------------------------------------------------------------------ F1: the given pages

@register("pages_scan", "select page_id, url, cast(length(html) as bigint) as n_chars from pages")
def q_pages_scan(spark, sf_dir):
    """The page source, content pruned to its size."""
    return _pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@register("url_parts", f"""
select page_id, url, lower({sql_part('url', 2)}) as scheme, {sql_part('url', 4)} as netloc,
       {sql_part('url', 5)} as path, {sql_part('url', 7)} as query, {sql_part('url', 9)} as fragment
from pages""")
def q_url_parts(spark, sf_dir):
    """Urlparse of every page URL."""
    p = _pages(spark, sf_dir).select("page_id", "url", U.url_parts(F.col("url")).alias("u"))
    return p.select("page_id", "url", "u.scheme", "u.netloc", U.url_path(F.col("url")).alias("path"),
                    "u.query", "u.fragment")


@register("local_path", f"select page_id, url, {FX.sql_local_path('url')} as path from pages")
def q_local_path(spark, sf_dir):
    """File path of every page under the output folder."""
    return _pages(spark, sf_dir).select("page_id", "url", U.local_path(F.col("url")).alias("path"))


@register("long_paths", f"""
with {SQL_LINKS.strip()},
u as (select link as url from rl union select link || repeat('x', {LONGER}) from rl)
select url, {FX.sql_local_path('url')} as path,
       cast(length(regexp_extract({FX.sql_local_name('url')}, '[^/]*$')) as bigint) as name_chars,
       length(regexp_extract({FX.sql_local_name('url')}, '[^/]*$')) > 255 as is_long
from u""")
def q_long_paths(spark, sf_dir):
    """U3d: file-name length of every linked URL, as it is and drawn out, and whether the long-name rule replaced it."""
    u = _resolved_raw(spark, sf_dir).select(F.explode(F.array(
        F.col("url"), F.concat(F.col("url"), F.lit("x" * LONGER)))).alias("url")).distinct()
    name = U.basename(U.local_name(F.col("url")))
    return u.select("url", U.local_path(F.col("url")).alias("path"),
                    F.length(name).cast("bigint").alias("name_chars"),
                    (F.length(name) > U.MAX_NAME_CHARS).alias("is_long"))


@register("url_priority", f"""
with {SQL_LINKS.strip()}
select distinct link as url, {sql_priority('link')} as priority from rl""")
def q_url_priority(spark, sf_dir):
    """Priority of every linked URL under the weights."""
    u = _resolved_raw(spark, sf_dir).select("url").distinct()
    return u.select("url", U.url_priority(F.col("url"), WEIGHTS).cast("int").alias("priority"))


@register("crawl_key", "select page_id, url, sha256(url) as crawl_id from pages")
def q_crawl_key(spark, sf_dir):
    """Crawl id of every page taken as a start URL."""
    return _pages(spark, sf_dir).select("page_id", "url", U.crawl_key(F.col("url")).alias("crawl_id"))


@register("in_domain", f"""
with {SQL_LINKS.strip()}
select page_id, pos, link as url, regexp_replace(netloc, '^(www|blog|m)\\.', '') as domain,
       contains(link, regexp_replace(netloc, '^(www|blog|m)\\.', '')) as in_domain,
       {sql_part('link', 4)} = regexp_replace(netloc, '^(www|blog|m)\\.', '') as in_domain_strict
from rl""")
def q_in_domain(spark, sf_dir):
    """Each link against its site's registered domain, substring rule and strict host rule."""
    r = _resolved_raw(spark, sf_dir).withColumn(
        "domain", F.regexp_replace(U.url_netloc(F.col("page_url")), r"^(www|blog|m)\.", ""))
    return r.select("page_id", "pos", "url", "domain",
                    U.in_domain(F.col("url"), F.col("domain")).alias("in_domain"),
                    U.in_domain(F.col("url"), F.col("domain"), strict=True).alias("in_domain_strict"))


@register("excluded_urls", f"""
with {SQL_LINKS.strip()}
select page_id, pos, link as url, {sql_excluded('link')} as excluded from rl""")
def q_excluded_urls(spark, sf_dir):
    """Exclusion flag of every link."""
    r = _resolved_raw(spark, sf_dir)
    return r.select("page_id", "pos", "url", U.is_excluded(F.col("url"), EXCLUDED).alias("excluded"))


@register("extract_links", f"""
with {SQL_LINKS.strip()}
select page_id, pos, 'a' as tag, 'href' as attr, href, link as url, {sql_priority('link')} as priority
from rl where contains(link, netloc)""")
def q_extract_links(spark, sf_dir):
    """Links each page would queue, domain = the page's own host, weights applied."""
    return _links(spark, sf_dir).select("page_id", "pos", "tag", "attr", "href", "url", "priority")


@register("link_edges", f"""
with {SQL_LINKS.strip()}
select distinct page_url as src, link as dst from rl where contains(link, netloc) and page_url <> link""")
def q_link_edges(spark, sf_dir):
    """Distinct page -> link edges, self-loops dropped."""
    from sitegraph.operators.graph import link_edges

    return link_edges(_links(spark, sf_dir))


@register("first_seen", f"""
with {SQL_LINKS.strip()},
k as (select sha256('https://' || netloc || '/') as crawl_id, link as url, page_id, pos,
             row_number() over (partition by sha256('https://' || netloc || '/'), link order by page_id, pos) as rn
      from rl where contains(link, netloc))
select crawl_id, url, page_id, pos from k where rn = 1""")
def q_first_seen(spark, sf_dir):
    """A1: first discovery of every URL per site (site = host, crawl id of its root)."""
    links = _links(spark, sf_dir).withColumn(
        "crawl_id", U.crawl_key(F.concat(F.lit("https://"), U.url_netloc(F.col("page_url")), F.lit("/"))))
    return S.first_seen(links, order=("page_id", "pos"))


_UP = "greatest(length(upath) - length(replace(upath, '/', '')) - 1, 0)"
_TARGET = "case when contains(substr(href, 2), '.') then substr(href, 2) else substr(href, 2) || '.html' end"


@register("link_map", f"""
with {SQL_LINKS.strip()}
select page_id, pos, 'a' as tag, 'href' as attr, href,
       case when contains(scheme || '://' || netloc || href, netloc) then repeat('../', {_UP}) || {_TARGET}
            else href end as new_href
from raw where href <> ''""")
def q_link_map(spark, sf_dir):
    """The rewrite plan: every link tag with its new relative href."""
    return X.link_map(_pages(spark, sf_dir)).select("page_id", "pos", "tag", "attr", "href", "new_href")


@register("rewrite_links", f"""
with p as (select page_id, url, html, {sql_part('url', 5)} as upath from pages)
select page_id, url,
  regexp_replace(regexp_replace(html, '<a href="/([^"./]*)"', '<a href="' || repeat('../', {_UP}) || '\\1.html"', 'g'),
                 '<a href="/([^"/]*)"', '<a href="' || repeat('../', {_UP}) || '\\1"', 'g') as html
from p""")
def q_rewrite_links(spark, sf_dir):
    """Every page with in-domain links pointing at the local copies."""
    return X.rewrite_html(_pages(spark, sf_dir)).select("page_id", "url", "html")


@register("path_collisions", f"""
with {SQL_TWICE.strip()},
f as (select page_id, url, {FX.sql_local_path('url')} as path from pv),
g as (select path, count(*) as n_urls, arg_min(url, page_id) as winner_url from f group by path)
select path, cast(n_urls as bigint) as n_urls, winner_url from g where n_urls > 1""")
def q_path_collisions(spark, sf_dir):
    """K2: files claimed by several page URLs (fragment or '.html' variants), first page wins."""
    return K.path_collisions(_twice(_pages(spark, sf_dir)), order=["page_id"])


@register("mirror_manifest", f"""
with {SQL_TWICE.strip()},
f as (select page_id, url, html, {FX.sql_local_path('url')} as path from pv),
w as (select path, arg_min(url, page_id) as writer_url from f group by path)
select f.url, f.path, 'text/html' as kind, 'text' as mode, cast(octet_length(encode(f.html)) as bigint) as n_bytes,
       w.writer_url, w.writer_url = f.url as written
from f join w on f.path = w.path""")
def q_mirror_manifest(spark, sf_dir):
    """S3 + K2: what a mirror of all pages and their fragment variants holds; the first page per file is written."""
    return K.manifest(_twice(_pages(spark, sf_dir)), order=["page_id"])


# registering the other query families
from sitegraph.plans import crawl_queries  # noqa: E402,F401
from sitegraph.plans import fetch_queries  # noqa: E402,F401
from sitegraph.plans import url_queries  # noqa: E402,F401
