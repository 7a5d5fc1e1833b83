"""Link extraction and rewriting over a pages table (operators X1-X5, U6).

All operators are narrow (row-local) transformations of ``pages``: a page's
links, their resolved URLs and its rewritten HTML depend on that page alone, so
no shuffle happens here. ``html`` is dropped as soon as the link array exists so
that it never travels through a later exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.functions import urls as U


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_links(pages: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", html: str = "html",
              tags: Sequence[str] = tuple(H.LINK_TAGS), resolve: bool = False) -> DataFrame:
    """Every link-carrying tag of every page: keep cols, page_url, pos, tag, attr, href (document order).

    With ``resolve`` the link is also resolved against the page (column
    ``url``) inside the generator, so later filters on it can not be pushed
    below it and re-run the resolver.
    """
    structs = H.link_structs(F.col(html), tuple(tags))
    if resolve:
        structs = F.transform(structs, lambda l: F.struct(
            l["tag"].alias("tag"), l["attr"].alias("attr"), l["value"].alias("value"),
            U.resolve_url(F.col(url), l["value"]).alias("url")))
    exploded = pages.select(*keep, F.col(url).alias("page_url"), F.posexplode(structs).alias("pos", "l"))
    cols = [*keep, "page_url", F.col("pos").cast("bigint").alias("pos"), F.col("l.tag").alias("tag"),
            F.col("l.attr").alias("attr"), F.col("l.value").alias("href")]
    if resolve:
        cols.append(F.col("l.url").alias("url"))
    return exploded.select(*cols)


def extract_links(
    pages: DataFrame,
    domain: Column | str | None = None,
    weights: Sequence[str] = (),
    excluded: Sequence[str] = (),
    strict_domain: bool = False,
    keep: Sequence[str] = ("page_id",),
    url: str = "url",
    html: str = "html",
    strip_fragment: bool = False,
) -> DataFrame:
    """Links a crawler would queue from each page, in document order, not de-duplicated.

    Skips empty and '#'-only hrefs (P3), resolves against the page URL (U2),
    keeps links inside ``domain`` (P1; default: the page's own netloc), drops
    excluded ones (P2) and ranks them by ``weights`` (U5). Output:
    ``keep..., page_url, pos, tag, attr, href, url, priority``. With
    ``strip_fragment`` the ``#fragment`` is dropped from ``url``, so ``/a#x``
    and ``/a#y`` become one URL key (the original keeps them apart).
    """
    if domain is None:
        dom_page = U.url_netloc(F.col(url))  # per page, before the explode
    elif isinstance(domain, str) and domain not in pages.columns:
        dom_page = F.lit(domain)
    else:
        dom_page = _col(domain)
    links = raw_links(pages.withColumn("_domain", dom_page), [*keep, "_domain"], url, html, resolve=True)
    dom = F.col("_domain")
    out = links.filter((F.col("href") != "") & ~F.col("href").startswith("#") & F.col("url").isNotNull())
    if strip_fragment:
        out = out.withColumn("url", F.regexp_replace(F.col("url"), "#.*$", ""))
    out = out.filter(U.in_domain(F.col("url"), dom, strict_domain))
    if excluded:
        out = out.filter(~U.is_excluded(F.col("url"), excluded))
    return out.withColumn("priority", U.url_priority(F.col("url"), weights).cast("int")).drop("_domain")


def extract_images(pages: DataFrame, keep: Sequence[str] = ("page_id",), url: str = "url", html: str = "html") -> DataFrame:
    """Every ``img[src]`` resolved against its page, ignoring domain and exclusions.

    An empty ``src`` would resolve to the page itself; it is skipped.
    """
    imgs = raw_links(pages, keep, url, html, tags=("img",), resolve=True)
    return imgs.filter((F.col("href") != "") & F.col("url").isNotNull())


def image_routing(images: DataFrame, domain: Column, excluded: Sequence[str] = ()) -> DataFrame:
    """Images inside the domain and not excluded go to the crawl queue, the rest to the image path."""
    ok = U.in_domain(F.col("url"), domain)
    if excluded:
        ok = ok & ~U.is_excluded(F.col("url"), excluded)
    return images.withColumn("route", F.when(ok, F.lit("queue")).otherwise(F.lit("image")))


def _with_fragment(new: Column, target: Column) -> Column:
    frag = U.url_fragment(target)
    return F.when(frag != "", F.concat(new, F.lit("#"), frag)).otherwise(new)


def link_map(pages: DataFrame, domain: Column | None = None, keep: Sequence[str] = ("page_id",),
             url: str = "url", html: str = "html", script_rule: bool = False, keep_fragment: bool = False,
             fetched_images: DataFrame | None = None, **path_opts) -> DataFrame:
    """The rewrite plan, one row per link tag with a non-empty value.

    ``new_href`` is the path of the target relative to the page's folder when
    the target is inside the domain; otherwise the href is kept. With
    ``script_rule`` an ``a`` href still ending ``.php``/``.pl`` becomes ``.html``
    (U6; off by default because it breaks off-domain links, always on in the original).
    ``keep_fragment`` carries a ``#fragment`` of the target over to the local
    href (the original drops it, so ``#top`` links lose their anchor).
    ``fetched_images(url)``: images downloaded successfully; such an ``img``
    points at its local copy even off-domain (every use, not only the first).
    """
    per_page = pages.withColumn("_domain", U.url_netloc(F.col(url)) if domain is None else domain).withColumn(
        "_dir", U.dirname(U.local_path(F.col(url), **path_opts)))  # page-level values once per page
    links = raw_links(per_page, [*keep, "_domain", "_dir"], url, html, resolve=True).withColumnRenamed(
        "url", "target").filter(F.col("href") != "")
    dom = F.col("_domain")
    rel = U.relative_path(U.local_path(F.col("target"), **path_opts), F.col("_dir"))
    if keep_fragment:
        rel = _with_fragment(rel, F.col("target"))
    local = F.col("target").isNotNull() & U.in_domain(F.col("target"), dom)
    if fetched_images is not None:
        got = fetched_images.select(F.col("url").alias("target")).distinct().withColumn("_img_ok", F.lit(True))
        links = links.join(got, "target", "left")
        local = local | ((F.col("tag") == "img") & F.coalesce(F.col("_img_ok"), F.lit(False)))
    out = links.withColumn("new_href", F.when(local, rel).otherwise(F.col("href")))
    out = out.drop("_domain", "_dir")
    if fetched_images is not None:
        out = out.drop("_img_ok")
    if script_rule:
        out = out.withColumn(
            "new_href", F.when(F.col("tag") == "a", U.script_link(F.col("new_href"))).otherwise(F.col("new_href"))
        )
    return out


def _escape_replacement(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _escape_attr(v: Column) -> Column:
    return F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def _rewrite_tag(tok: Column, page: Column, script_rule: bool, path_opts: dict,
                 keep_fragment: bool = False, fetched_images: bool = False) -> Column:
    """New text of one link tag; ``page`` holds the page's url, domain and folder (bound once per page)."""
    name = H.tag_name(tok)
    is_href = name.isin("a", "link")
    is_src = name.isin("img", "script")

    def body(v):
        val = v["val"]

        def with_target(target):
            rel = U.relative_path(U.local_path(target, **path_opts), page["dir"])
            if keep_fragment:
                rel = _with_fragment(rel, target)
            local = target.isNotNull() & U.in_domain(target, page["dom"])
            if fetched_images:
                local = local | ((v["name"] == "img") & F.coalesce(F.array_contains(page["imgs"], target), F.lit(False)))
            new = F.when(local, rel).otherwise(val)
            if script_rule:
                new = F.when(v["name"] == "a", U.script_link(new)).otherwise(new)
            return U.let(new, finish)

        def finish(new):
            repl = F.concat(F.lit("$1\""), _escape_replacement(_escape_attr(new)), F.lit('"'))
            return (F.when(new == val, tok)
                    .when(v["is_href"], F.regexp_replace(tok, F.lit(H.attr_regex("href")), repl))
                    .otherwise(F.regexp_replace(tok, F.lit(H.attr_regex("src")), repl)))
        return U.let(U.resolve_url(page["url"], val), with_target)

    val = F.when(is_href, H.attr_value(tok, "href")).when(is_src, H.attr_value(tok, "src"))
    return U.bind(lambda v: F.when(v["val"].isNotNull() & (v["val"] != ""), body(v)).otherwise(tok),
                  val=val, name=name, is_href=is_href)


def rewrite_html(pages: DataFrame, domain: Column | None = None, url: str = "url", html: str = "html",
                 script_rule: bool = False, keep_fragment: bool = False, fetched_images: str | None = None,
                 **path_opts) -> DataFrame:
    """The page with every in-domain link pointing at the local copy.

    The page is split around its link tags (comments and script/style blocks
    are matched too, so links inside them stay untouched); only the tags are
    rewritten and the pieces are joined back, so bytes outside the changed
    attribute values stay as they were. Output column ``html`` replaces the input.
    ``fetched_images`` names an ``array<string>`` column of the page's images
    that were downloaded; those point at their local copy even off-domain.
    """
    page_url = F.col(url)
    dom = U.url_netloc(page_url) if domain is None else domain
    pattern = H.tag_pattern()

    def body(p):
        tags = F.regexp_extract_all(p["html"], F.lit(pattern), 0)
        gaps = F.split(p["html"], pattern, -1)
        new_tags = F.transform(F.transform(tags, H.last_only), lambda t: _rewrite_tag(t, p, script_rule, path_opts, keep_fragment,
                                                            fetched_images is not None))
        tail = F.zip_with(new_tags, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))),
                          lambda t, g: F.concat(t, F.coalesce(g, F.lit(""))))
        return F.concat(F.element_at(gaps, 1), F.array_join(tail, ""))

    extra = {"imgs": F.col(fetched_images)} if fetched_images else {}
    page = U.bind(body, url=page_url, html=F.col(html), dom=dom,
                  dir=U.dirname(U.local_path(page_url, **path_opts)), **extra)
    return pages.withColumn(html, F.when(F.col(html).isNotNull(), page))
