"""Link extraction and rewriting on HTML shapes the given pages lack."""

from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.operators import links as X

PAGE = "http://ex.com/a/b.html"
HTML = (
    "<html><head><link rel=stylesheet href='/s.css'><script src=\"/app.js\"></script>"
    "<script>var x = '<a href=\"/in-script\">';</script><style>a{}</style></head><body>"
    "<!-- <a href=\"/in-comment\"> -->"
    "<A HREF=\"c.html\">c</A><a title=\"x href=/fake\" href='d.php'>d</a><a href=e.html>e</a>"
    "<a href=\"\">empty</a><a href=\"#top\">top</a><a name=x>noref</a>"
    "<img src=\"/i.png\" alt=\"a > b\"><a href=\"/x?a=1&amp;b=2\">q</a>"
    "<a href=\"http://other.org/p.php\">off</a></body></html>"
)


def _pages(spark, html=HTML, url=PAGE):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_raw_links_document_order(spark):
    got = [(r.tag, r.attr, r.href) for r in X.raw_links(_pages(spark)).orderBy("pos").collect()]
    assert got == [
        ("link", "href", "/s.css"), ("script", "src", "/app.js"), ("a", "href", "c.html"),
        ("a", "href", "d.php"), ("a", "href", "e.html"), ("a", "href", ""), ("a", "href", "#top"),
        ("img", "src", "/i.png"), ("a", "href", "/x?a=1&b=2"), ("a", "href", "http://other.org/p.php"),
    ]


def test_extract_links_filters(spark):
    out = X.extract_links(_pages(spark), weights=["css", "php"], excluded=["e.html"])
    got = [(r.url, r.priority) for r in out.orderBy("pos").collect()]
    assert got == [
        ("http://ex.com/s.css", 0), ("http://ex.com/app.js", 2), ("http://ex.com/a/c.html", 2),
        ("http://ex.com/a/d.php", 1), ("http://ex.com/i.png", 2), ("http://ex.com/x?a=1&b=2", 2),
    ]


def test_images_and_routing(spark):
    html = "<img src='/i.png'><img src='http://cdn.org/j.png'><img src=''><img alt=x>"
    imgs = X.extract_images(_pages(spark, html))
    routed = X.image_routing(imgs, F.lit("ex.com"), excluded=["i.png"]).orderBy("pos")
    assert [(r.url, r.route) for r in routed.collect()] == [
        ("http://ex.com/i.png", "image"), ("http://cdn.org/j.png", "image")]


def test_rewrite_keeps_bytes_and_points_local(spark):
    out = X.rewrite_html(_pages(spark), script_rule=True).first().html
    assert "href=\"../s.css\"" in out and "src=\"../app.js\"" in out
    assert "<A HREF=\"c.html\">" in out                      # already the local name
    assert "href=\"d.php.html\"" in out                      # .php page saved as .php.html
    assert "href=\"../x_" in out and "&amp;" not in out.split("x_")[1][:12]
    assert "href=\"http://other.org/p.html\"" in out         # off-domain: script rule only
    assert "<a href=\"/in-script\">" in out and "<a href=\"/in-comment\">" in out
    assert "href=\"b.html\">top" in out                      # fragment link -> the page's own file
    assert out.replace("../s.css", "/s.css").startswith("<html><head><link rel=stylesheet href=")


def test_rewritten_links_reextract_to_local_targets(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = X.link_map(pages).select("page_id", "pos", "new_href")
    again = X.raw_links(X.rewrite_html(pages)).select("page_id", "pos", F.col("href").alias("new_href"))
    assert plan.exceptAll(again).count() == 0 and again.exceptAll(plan).count() == 0


def test_huge_tag_does_not_break_the_tokenizer(spark):
    big = "<a title=\"" + "x" * 100_000 + "\" href=\"/big\">b</a><a href=\"/after\">"
    got = [r.href for r in X.raw_links(_pages(spark, big)).orderBy("pos").collect()]
    assert got == ["/big", "/after"]


def test_tag_with_many_attributes_does_not_overflow(spark):
    tag = "<a " + " ".join(f'x{i}="v"' for i in range(20_000)) + ' href="/deep">d</a><a href="/after">'
    pages = _pages(spark, tag, "http://ex.com/")
    assert [r.href for r in X.raw_links(pages).orderBy("pos").collect()] == ["/deep", "/after"]
    assert X.rewrite_html(pages).first().html.endswith('href="deep.html">d</a><a href="after.html">')


def test_links_that_a_lenient_parser_finds(spark):
    shapes = [
        ('<script-loader></script-loader><a href="/s">', ["/s"]),
        ('<a class="x"href="/y">', ["/y"]), ('<a/href="/y">', ["/y"]), ('<img / src="/i.png">', ["/i.png"]),
        ('<a title="x"" href="/y">', ["/y"]), ("<a title=it's href=\"/u1\">t<a href='/u2'>", ["/u1", "/u2"]),
        ('<a data-href="/no" href="/yes">', ["/yes"]), ('<style-guide><a href="/g"></style-guide>', ["/g"]),
    ]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(shapes)], "k int, html string")
    got = {r.k: [x["value"] for x in r.v] for r in df.select("k", H.link_structs(F.col("html")).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(shapes)}


def test_character_references_match_the_standard_library(spark):
    import html

    from sitegraph.functions import html as H

    values = ["a&b", "&#038;x", "&#38;", "&eacute;&#233;", "&amp;lt;", "&nope;", "&", "&&amp;", "&#x1F600;", "&#0;", "&#xD800;",
              "&#99999999999;", "&#150;", "/a?x=1&y=2", "&#65b", "&NotEqualTilde;", "", "&lt;&gt;&quot;"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(H.decode_entities(F.col("v"))).collect()] == [html.unescape(v) for v in values]


def test_unclosed_comment_hides_later_links(spark):
    from sitegraph.operators import links as X

    page = spark.createDataFrame([(1, "http://ex.com/", '<a href="/a">a</a><!-- <a href="/b">b</a>')],
                                 "page_id long, url string, html string")
    assert [r.href for r in X.raw_links(page).collect()] == ["/a"]
