"""Property tests: generated URLs and paths, checked in batches against urllib.parse / posixpath."""

import posixpath
from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegraph.functions import urls as U

SEG = st.text(alphabet="ab.;%é-_~", min_size=0, max_size=4)
PATHS = st.lists(SEG, min_size=0, max_size=4).map(lambda xs: "/".join(xs))
HREF = st.builds(
    lambda pre, p, q, f: pre + p + q + f,
    st.sampled_from(["", "/", "//h.org/", "./", "../", "http:", "https://x.com", "HTTP://Y.com/", "mailto:", " ", "?"]),
    PATHS,
    st.sampled_from(["", "?a=1", "?", "?x/y"]),
    st.sampled_from(["", "#f", "#", "#a/../b"]),
)
BASE = st.builds(lambda s, p, q: f"{s}://h.com/{p}{q}", st.sampled_from(["http", "https", "ftp"]), PATHS,
                 st.sampled_from(["", "?q=1", "?q"]))
SETTINGS = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(BASE, HREF), min_size=50, max_size=200))
def test_resolve_url_matches_urljoin(spark, pairs):
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", U.resolve_url("b", "h").alias("got")).collect():
        try:
            exp = urljoin(r.b, r.h)
        except ValueError:
            exp = None
        assert r.got == exp, (r.b, r.h)


@SETTINGS
@given(st.lists(st.tuples(BASE, HREF), min_size=50, max_size=200))
def test_url_parts_match_urlparse(spark, pairs):
    df = spark.createDataFrame([(urljoin(b, h),) for b, h in pairs], "u string")
    got = df.select("u", U.url_parts("u").alias("p"), U.url_path("u").alias("path")).collect()
    for r in got:
        e = urlparse(r.u)
        assert (r.p.scheme, r.p.netloc, r.path, r.p.query, r.p.fragment) == (
            e.scheme, e.netloc, e.path, e.query, e.fragment), r.u


@SETTINGS
@given(st.lists(st.tuples(PATHS, PATHS), min_size=50, max_size=200))
def test_relative_path_matches_relpath(spark, pairs):
    pairs = [(a or "x", b or "y") for a, b in pairs]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", U.relative_path("b", "a").alias("got"), U.norm_path("a").alias("n")).collect():
        if not r.a.startswith("/"):  # norm_path is the relative-path normpath
            assert r.n == posixpath.normpath(r.a), r.a
        if ".." not in r.a.split("/") and ".." not in r.b.split("/"):
            assert r.got == posixpath.relpath("/R/" + r.b, "/R/" + r.a), (r.a, r.b)
