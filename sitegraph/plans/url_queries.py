"""Registered queries for the URL and path rules on link variants derived from ``pages``.

The given pages only hold root-relative ``<a href="/word">`` links. To run the
resolver, the script-link rule and the path checks over data that grows with
the table, every such link is also written in the other shapes an href can take
(relative, parent, dot, query-only, fragment-only, scheme-relative, absolute
with dot segments); links of any other form are taken as they are. Each oracle
states the expected result of a shape directly from the page URL's parts; the
full rule tables live in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import layout as K
from sitegraph.operators import links as X
from sitegraph.plans import fixtures as FX
from sitegraph.plans.registry import EXCLUDED, register
from sitegraph.sources.tables import read_pages

# --- fixed values: the href shapes derived from a root-relative link '/<word>' ---
CDN_HOST = "cdn.example.com"
SCRIPT_SUFFIXES = [".php", ".pl", ".php.bak", ".PHP"]
# --- end of fixed values ---

RFC = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"


def _shapes(href, word, page_url):
    """The href shapes of one link, in variant order 0..7."""
    return [
        href,
        word,
        F.concat(F.lit("../"), word),
        F.concat(F.lit("./"), word, F.lit("/")),
        F.concat(F.lit("?q="), word),
        F.concat(F.lit("#"), word),
        F.concat(F.lit(f"//{CDN_HOST}/"), word),
        F.concat(U.url_scheme(page_url), F.lit("://"), U.url_netloc(page_url), F.lit("/../../"), word),
    ]


def _links(spark, sf_dir) -> DataFrame:
    """Every link of every page; ``word`` is what follows the slash of a root-relative one, else null."""
    raw = X.raw_links(read_pages(spark, sf_dir)).where(F.col("href") != "")
    return raw.withColumn("word", F.when(F.col("href").rlike("^/[^/]"), F.substring(F.col("href"), 2, 1 << 30)))


def _variants(spark, sf_dir) -> DataFrame:
    shapes = F.array(*_shapes(F.col("href"), F.col("word"), F.col("page_url")))
    v = _links(spark, sf_dir).select("page_id", "pos", "page_url", F.posexplode(
        F.when(F.col("word").isNull(), F.array("href")).otherwise(shapes)).alias("variant", "href"))
    return v.select("page_id", "pos", "page_url", F.col("variant").cast("int").alias("variant"), "href",
                    U.resolve_url(F.col("page_url"), F.col("href")).alias("url"))


def _sql_resolve(h: str) -> str:
    """DuckDB text of the resolver for hrefs without dot segments, from the page URL's parts."""
    query = "(case when uquery <> '' then '?' || uquery else '' end)"
    return f"""(case when regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {h} when starts_with({h}, '//') then scheme || ':' || {h}
      when starts_with({h}, '/') then origin || {h} when starts_with({h}, '?') then origin || upath || {h}
      when starts_with({h}, '#') then origin || upath || {query} || {h} else origin || dir || {h} end)"""


SQL_BASE = rf"""
p as (select page_id, url, html, lower(regexp_extract(url, {RFC}, 2)) as scheme, regexp_extract(url, {RFC}, 4) as netloc,
             regexp_extract(url, {RFC}, 5) as upath, regexp_extract(url, {RFC}, 7) as uquery from pages),
l as (select page_id, url as page_url, scheme, netloc, upath, uquery, cast(generate_subscripts(hs, 1) - 1 as bigint) as pos,
             unnest(hs) as href
      from (select *, regexp_extract_all(html, '<a[^>]*? href="([^"]*)"', 1) as hs from p) q),
a as (select *, regexp_replace(upath, '[^/]*$', '') as dir, scheme || '://' || netloc as origin from l where href <> ''),
w as (select *, substr(href, 2) as word from a where regexp_matches(href, '^/[^/]')),
v as (
  select page_id, pos, 0 as variant, href, {_sql_resolve('href')} as url, netloc, '' as word from a where not regexp_matches(href, '^/[^/]')
  union all select page_id, pos, 0, href, origin || href, netloc, word from w
  union all select page_id, pos, 1, word, origin || dir || word, netloc, word from w
  union all select page_id, pos, 2, '../' || word,
         origin || (case when dir = '/' then '/' else regexp_replace(dir, '[^/]*/$', '') end) || word, netloc, word from w
  union all select page_id, pos, 3, './' || word || '/', origin || dir || word || '/', netloc, word from w
  union all select page_id, pos, 4, '?q=' || word, origin || upath || '?q=' || word, netloc, word from w
  union all select page_id, pos, 5, '#' || word,
         origin || upath || (case when uquery <> '' then '?' || uquery else '' end) || '#' || word, netloc, word from w
  union all select page_id, pos, 6, '//{CDN_HOST}/' || word, scheme || '://{CDN_HOST}/' || word, netloc, word from w
  union all select page_id, pos, 7, origin || '/../../' || word, origin || '/../../' || word, netloc, word from w)
"""


@register("resolve_url", "with " + SQL_BASE.strip() + "\nselect page_id, pos, variant, href, url from v")
def q_resolve_url(spark, sf_dir):
    """Every link in eight href shapes, resolved against its page."""
    return _variants(spark, sf_dir).select("page_id", "pos", "variant", "href", "url")


@register("unsafe_paths", "with " + SQL_BASE.strip() + f"""
select page_id, pos, variant, url, {FX.sql_local_path('url')} as path from v where variant = 7 or regexp_matches(url, '^[^:]*://[^/]*/\\.\\.(/|$)')""")
def q_unsafe_paths(spark, sf_dir):
    """K3: resolved links whose file would land outside the output folder."""
    v = _variants(spark, sf_dir).withColumn("path", U.local_path(F.col("url")))
    return K.unsafe_paths(v).select("page_id", "pos", "variant", "url", "path")


@register("relative_path", "with " + SQL_BASE.strip() + f""",
f as (select v.page_id, v.pos, v.variant, {FX.sql_local_path('v.url')} as from_path, {FX.sql_local_path('p.url')} as to_path
      from v join p on v.page_id = p.page_id where v.variant < 7)
select page_id, pos, variant, from_path, to_path, {FX.sql_relpath('to_path', FX.sql_dirname('from_path'))} as rel_path from f""")
def q_relative_path(spark, sf_dir):
    """U4: from every link target's file back to its page's file, as a relative path, for all shapes that stay below the root."""
    r = _variants(spark, sf_dir).where(F.col("variant") < 7)
    r = r.select("page_id", "pos", "variant", U.local_path(F.col("url")).alias("from_path"), U.local_path(F.col("page_url")).alias("to_path"))
    return r.withColumn("rel_path", U.relative_path(F.col("to_path"), U.dirname(F.col("from_path"))))


@register("script_links", "with " + SQL_BASE.strip() + """
select page_id, pos, 0 as variant, href || '.php' as href, href || '.html' as new_href from a
union all select page_id, pos, 1, href || '.pl', href || '.html' from a
union all select page_id, pos, 2, href || '.php.bak', href || '.php.bak' from a
union all select page_id, pos, 3, href || '.PHP', href || '.PHP' from a""")
def q_script_links(spark, sf_dir):
    """The '.php'/'.pl' link rule on every link with script suffixes attached."""
    v = _links(spark, sf_dir).select("page_id", "pos", F.posexplode(F.array(
        *[F.concat(F.col("href"), F.lit(sfx)) for sfx in SCRIPT_SUFFIXES])).alias("variant", "href"))
    return v.select("page_id", "pos", F.col("variant").cast("int").alias("variant"), "href",
                    U.script_link(F.col("href")).alias("new_href"))


_FILES = " union ".join(f"select {FX.sql_local_path(_sql_resolve(h))} from a" for h in ("href", "(href || '.css')", "(href || '.css/x')"))


@register("path_conflicts", "with " + SQL_BASE.strip() + f""",
files as (select distinct {FX.sql_local_path('url')} as path from pages union {_FILES})
select a.path, a.path || '_' || md5(a.path) as renamed_path, cast(count(distinct b.path) as bigint) as n_children
from files a join files b on starts_with(b.path, a.path || '/')
group by a.path""")
def q_path_conflicts(spark, sf_dir):
    """K1: saved files that another file needs as a folder (the older file gets renamed).

    Every link also counts as a style sheet ``<link>.css`` and a page ``<link>.css/x`` below it.
    """
    pages = read_pages(spark, sf_dir)
    page_paths = pages.select(U.local_path(F.col("url")).alias("path"))
    hrefs = _links(spark, sf_dir).select("page_url", F.explode(F.array(
        F.col("href"), F.concat("href", F.lit(".css")), F.concat("href", F.lit(".css/x")))).alias("href"))
    link_paths = hrefs.select(U.local_path(U.resolve_url(F.col("page_url"), F.col("href"))).alias("path"))
    return K.path_conflicts(page_paths.unionByName(link_paths))


SQL_IMG = "with " + SQL_BASE.strip() + f""",
h as (select *, row_number() over (partition by page_id order by pos) - 1 as k from a),
i as (select page_id, netloc, cast(2 * k as bigint) as pos, href, {_sql_resolve('href')} as url from h
      union all
      select page_id, netloc, cast(2 * k + 1 as bigint), '//{CDN_HOST}/' || ltrim(href, '/'), scheme || '://{CDN_HOST}/' || ltrim(href, '/') from h)
"""


def _with_images(pages: DataFrame) -> DataFrame:
    """Every page with two images per link at its end, one of the link's URL, one on another host."""
    hrefs = F.filter(F.regexp_extract_all("html", F.lit(FX.FIXTURE_HREF_RE), 1), lambda h: h != "")
    tags = F.transform(hrefs, lambda h: F.concat(
        F.lit('<img alt="" src="'), h, F.lit(f'"><IMG src="//{CDN_HOST}/'), F.ltrim(h, F.lit("/")), F.lit('"/>')))
    return pages.withColumn("html", F.concat("html", F.array_join(tags, "")))


@register("extract_images", SQL_IMG + """
select page_id, pos, href, url from i""")
def q_extract_images(spark, sf_dir):
    """Every image of every page, whatever its domain."""
    return X.extract_images(_with_images(read_pages(spark, sf_dir))).select("page_id", "pos", "href", "url")


@register("image_routing", SQL_IMG + """
select page_id, pos, url,
       case when contains(url, netloc) and not (""" + " or ".join(f"contains(url, '{x}')" for x in EXCLUDED) + """)
            then 'queue' else 'image' end as route
from i""")
def q_image_routing(spark, sf_dir):
    """Images inside the crawl domain and not excluded join the queue; the rest are fetched as images."""
    imgs = X.extract_images(_with_images(read_pages(spark, sf_dir)))
    return X.image_routing(imgs, U.url_netloc(F.col("page_url")), EXCLUDED).select("page_id", "pos", "url", "route")
