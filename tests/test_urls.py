"""URL rules: golden tables and property tests against urllib.parse / posixpath."""

import hashlib
import posixpath
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitegraph.functions import urls as U

BASE = "http://ex.com/a/b/c.html?q=1"

RESOLVE_GOLDEN = [
    ("g/../h", "http://ex.com/a/b/h"),
    ("../../../x", "http://ex.com/x"),
    ("./", "http://ex.com/a/b/"),
    ("..", "http://ex.com/a/"),
    ("?p=2", "http://ex.com/a/b/c.html?p=2"),
    ("#t", "http://ex.com/a/b/c.html?q=1#t"),
    ("x#f", "http://ex.com/a/b/x#f"),
    ("//cdn.ex.com/x", "http://cdn.ex.com/x"),
    ("http:g", "http://ex.com/a/b/g"),
    ("http://ex.com/../../etc/x", "http://ex.com/../../etc/x"),
    ("HTTP://EX.com/A", "http://EX.com/A"),
    ("/a//b", "http://ex.com/a//b"),
    ("x?", "http://ex.com/a/b/x"),
    ("d;p?z", "http://ex.com/a/b/d;p?z"),
    ("  /sp ace ", "http://ex.com/sp ace "),
    ("/x\ny", "http://ex.com/xy"),
    ("mailto:me@ex.com", "mailto:me@ex.com"),
    ("javascript:void(0)", "javascript:void(0)"),
    ("https://[bad/x", None),
]


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


PATH_GOLDEN = [
    ("http://ex.com", "ex.com/index.html"),
    ("http://ex.com/", "ex.com/index.html"),
    ("http://ex.com/a", "ex.com/a.html"),
    ("http://ex.com/a/", "ex.com/a/index.html"),
    ("http://ex.com/a.css", "ex.com/a.css"),
    ("http://ex.com/v1.2/doc", "ex.com/v1.2/doc.html"),
    ("http://ex.com/a.php", "ex.com/a.php.html"),
    ("http://ex.com/a.php?x=1", f"ex.com/a.php_{_md5('x=1')}.html"),
    ("http://ex.com/a?x=1", f"ex.com/a_{_md5('x=1')}.html"),
    ("http://ex.com/a/?x=1", f"ex.com/a/index_{_md5('x=1')}.html"),
    ("http://ex.com/a.tar.gz?v=2", f"ex.com/a.tar_{_md5('v=2')}.gz"),
    ("http://ex.com/.htaccess?x=1", f"ex.com/.htaccess_{_md5('x=1')}"),
    ("http://ex.com/d;p", "ex.com/d.html"),
    ("http://U@Ex.com:80/a#f", "U@Ex.com:80/a.html"),
    ("http://ex.com/" + "a" * 250, "ex.com/" + "a" * 250 + ".html"),
    ("http://ex.com/" + "a" * 251, f"ex.com/{_md5('/' + 'a' * 251 + '.html')}.html"),
    ("http://ex.com/d/" + "a" * 252 + ".css", f"ex.com/{_md5('/d/' + 'a' * 252 + '.css')}.css"),
    ("mailto:me@ex.com", "me@ex.com"),
    ("http://ex.com/../../e", "ex.com/../../e.html"),
]


def test_resolve_golden(spark):
    df = spark.createDataFrame([(BASE, h, e) for h, e in RESOLVE_GOLDEN], "base string, href string, exp string")
    for r in df.select("href", "exp", U.resolve_url("base", "href").alias("got")).collect():
        assert r.got == r.exp, r.href


def test_resolve_matches_urljoin(spark):
    rng = random.Random(11)
    atoms = ["a", "b", ".", "..", "", "x;p", "q?", "#f", "é", ":", "//", "?", "#", "/", "http:", "HTTP://h.com",
             "ftp://f/", "mailto:", "[::1]", " ", "\t"]
    hrefs = ["".join(rng.choice(atoms) + rng.choice(["/", "", ";", "?", "#"]) for _ in range(rng.randint(1, 5)))
             for _ in range(300)]
    bases = [BASE, "https://h.com", "http://h.com/x/y/", "http://u@H.com:80/p;q/r;s?t#u", "ftp://f.org/d/e"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    for r in df.select("base", "href", U.resolve_url("base", "href").alias("got")).collect():
        try:
            exp = urljoin(r.base, r.href)
        except ValueError:
            exp = None
        assert r.got == exp, (r.base, r.href)


def test_local_path_golden(spark):
    df = spark.createDataFrame([(u, e) for u, e in PATH_GOLDEN], "u string, exp string")
    for r in df.select("u", "exp", U.local_path("u").alias("got")).collect():
        assert r.got == r.exp, r.u


def test_relative_path_matches_posixpath(spark):
    rng = random.Random(5)
    parts = ["a", "b", "c.html", "index.html", "x", "..", "."]
    paths = ["/".join(rng.choice(parts[:5]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    df = spark.createDataFrame([(a, b) for a in paths for b in paths], "a string, b string")
    got = df.select("a", "b", U.relative_path("b", U.dirname(F.col("a"))).alias("r")).collect()
    for r in got:
        assert r.r == posixpath.relpath("/R/" + r.b, posixpath.dirname("/R/" + r.a)), (r.a, r.b)


def test_link_target_golden(spark):
    cases = [("http://ex.com/a/b", "http://ex.com/c/d/", "../c/d/index.html"),
             ("http://ex.com/", "http://cdn.ex.com/x.js", "../cdn.ex.com/x.js"),
             ("http://ex.com/", "http://ex.com/#top", "index.html")]
    df = spark.createDataFrame(cases, "f string, t string, exp string")
    for r in df.select("exp", U.link_target_path("f", "t").alias("got")).collect():
        assert r.got == r.exp


def test_priority_exclusion_domain(spark):
    df = spark.createDataFrame([("http://ex.com/blog/the-x",), ("http://zzz.org/x",)], "u string")
    got = df.select(
        U.url_priority("u", ["the", "blog"]).alias("p"), U.url_priority("u", []).alias("p0"),
        U.is_excluded("u", ["zzz"]).alias("x"), U.in_domain("u", F.lit("ex.com")).alias("d"),
        U.in_domain("u", F.lit("ex.com"), strict=True).alias("s"),
    ).collect()
    assert [(r.p, r.p0, r.x, r.d, r.s) for r in got] == [(0, 0, False, True, True), (2, 0, True, False, False)]


def test_script_link_and_content_kind(spark):
    df = spark.createDataFrame(
        [("a.php", "text/html; charset=utf-8", "http://e/x"), ("a.pl", "image/png", "http://e/y.php"),
         ("a.php.bak", "text/css", "http://e/z"), ("a.PHP", "application/javascript", "http://e/w")],
        "h string, ct string, u string")
    kind, is_html, mode = U.content_kind(F.col("ct"), F.col("u"))
    got = df.select(U.script_link("h").alias("n"), kind.alias("k"), is_html.alias("i"), mode.alias("m")).collect()
    assert [tuple(r) for r in got] == [
        ("a.html", "text/html", True, "text"), ("a.html", "text/html", True, "text"),
        ("a.php.bak", "text/html", True, "text"), ("a.PHP", "application/javascript", False, "binary")]


def test_escapes_and_crawl_key(spark):
    df = spark.createDataFrame([("ex.com/../../e.html",), ("ex.com/../e.html",), ("ex.com/a.html",)], "p string")
    assert [r[0] for r in df.select(U.escapes_root("p")).collect()] == [True, False, False]
    k = spark.createDataFrame([("https://ex.com/",)], "u string").select(U.crawl_key("u")).first()[0]
    assert k == hashlib.sha256(b"https://ex.com/").hexdigest()


def test_escapes_root_on_empty_paths(spark):
    df = spark.createDataFrame([(".",), ("",), ("..",), ("a/../..",)], "p string")
    assert [r[0] for r in df.select(U.escapes_root("p")).collect()] == [False, False, True, True]
