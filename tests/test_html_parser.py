"""The tokenizer against the standard library's parser, on generated markup."""

import html
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from sitegraph.functions import html as H
from sitegraph.operators import links as X


class _Links(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.found = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        attr = H.LINK_TAGS.get(tag)
        if attr and dict(attrs).get(attr):  # of a repeated attribute the last one counts
            self.found.append(dict(attrs)[attr])


def _markup(rnd):
    values = ["/x", "/a&amp;b", "/a&copy=1&lt=2", "?q=1&amp", "/&notit;", "&#x41;&#66", "/n&eacute;", "a b", "/&bogus;x", "&#1;&#127;z", "é&Eacute"]

    def tag():
        names = rnd.choice(["a", "A", "link", "img", "p", "abbr", "image"])
        atts = []
        for _ in range(rnd.randint(0, 4)):
            name, v = rnd.choice(["href", "HREF", "src", "title", "data-href", "hrefs", "x"]), rnd.choice(values)
            quote = rnd.choice(['"', "'"])
            atts.append(f"{name}={quote}{v}{quote}" if rnd.random() < .8 or " " in v else f"{name}={v}")
        return f"<{names}{''.join(rnd.choice([' ', chr(10), '  ', ' / ']) + a for a in atts)}{rnd.choice(['', ' ', '/', ' /'])}>"

    other = ["text", "<!-- <a href=/c> -->", "<!-- <a href=/c2> -- >", "<![CDATA[ <a href=/d> ]]>", "<?php <a href=/e> ?>", "<! foo <a href=/f>>", "</ b <a href=/g>>",
             "</a>", "<!doctype html>", "<script>'<a href=/s>'</script>", "<style><a href=/t></style >", "<3", "a < b", "</p >", "<?xml version='1'?>", "<!-->x-->"]
    return "".join(tag() if rnd.random() < .6 else rnd.choice(other) for _ in range(rnd.randint(1, 8)))


def test_generated_markup_gives_the_links_of_the_standard_parser(spark):
    rnd = random.Random(11)
    texts = [_markup(rnd) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, html string").repartition(4)
    got = {r.k: [x["value"] for x in r.v if x["value"]] for r in df.select("k", H.link_structs(F.col("html")).alias("v")).collect()}
    wrong = [(t, _Links(t).found, got[k]) for k, t in enumerate(texts) if _Links(t).found != got[k]]
    assert not wrong, wrong[:3]


def test_references_without_semicolon_and_invalid_numbers(spark):
    values = ["&copy=1&lt=2", "&amp3", "&ampx", "&notit;", "&copy", "&notin;", "&#1;", "&#x7f;", "&#xFDD0;x", "&#x1FFFF;", "&#13;", "&#129;", "&Aacuteb&x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(H.decode_entities(F.col("v"))).collect()] == [html.unescape(v) for v in values]


def test_other_comment_ends(spark):
    df = spark.createDataFrame([(1, "http://ex.com/", '<!-- x --!><a href="/q"><!-- <a href="/n"> --!><a href="/r">')], "page_id long, url string, html string")
    assert [r.href for r in X.raw_links(df).orderBy("pos").collect()] == ["/q", "/r"]


def test_rewriting_a_repeated_attribute_leaves_the_last(spark):
    text = '<a href="/1" class=c href="/2">x</a><img src="/a.png" src="/b.png"/><!-- <a href="/1" href="/2"> --><script src="/s.js">a.href = b; c.href = d</script>'
    df = spark.createDataFrame([(1, "http://ex.com/", text)], "page_id long, url string, html string")
    out = X.rewrite_html(df).first().html
    assert out == ('<a class=c href="2.html">x</a><img src="b.png"><!-- <a href="/1" href="/2"> --><script src="s.js">a.href = b; c.href = d</script>')
    assert [r.href for r in X.raw_links(df).orderBy("pos").collect()] == ["/2", "/b.png", "/s.js"]
