"""HTML link tokens as Column expressions (no parse tree, no UDF).

``regexp_extract_all`` returns, in document order, the start tags of the
elements that carry links, while comments and the bodies of ``script``/``style``
elements are consumed whole so that links inside them never count. The
possessive quantifiers keep the Java regex engine from backtracking (or
recursing) through very long tags.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: which tag carries which link attribute (crawler rules) ---
LINK_TAGS = {"a": "href", "link": "href", "script": "src", "img": "src"}
# --- end of fixed values ---

# character references: decimal, hexadecimal, or what may be one of HTML5's names
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][^\t\n\f <&#;]{0,31}+;?)"
_NAMES = {k: v for k, v in html5.items() if k.endswith(";")}
# the older names need no semicolon: the longest one that a reference starts with counts
_OLD_NAMES = {k: v for k, v in html5.items() if not k.endswith(";")}
_OLD_NAME = "^&(" + "|".join(sorted(_OLD_NAMES, key=len, reverse=True)) + ")"
# numeric references 128 to 159 mean the Windows-1252 characters
_C1 = {chr(c): bytes([c]).decode("cp1252", "ignore") for c in range(128, 160)}
_C1 = {k: v for k, v in _C1.items() if v}

# one attribute: a name, then perhaps "=" with a quoted or bare value; blanks and slashes may stand around it
_VALUE = r"""(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?+"""
_ATT = rf"""(?:[\s/]++|[^\s/>=][^\s/=>]*+{_VALUE})*+[^>]*+"""


def tag_pattern(tags=tuple(LINK_TAGS)) -> str:
    """Regex whose matches are comments, other markup without links, skipped element bodies, or start tags of ``tags``."""
    names = "|".join(tags)
    return (
        r"(?is)<!--.*?(?:--!?\s*+>|\z)"
        r"|<!\[(?:temp|cdata|ignore|include|rcdata)\[.*?\]\s*+\]\s*+>"
        r"|<[!?/][^<>]*+<[^>]*+>"  # declarations, instructions and end tags run to their first '>'
        rf"|<script(?=[\s/>]){_ATT}>.*?</script\s*>"
        rf"|<style(?=[\s/>]){_ATT}>.*?</style\s*>"
        rf"|<(?:{names})(?=[\s/>]){_ATT}>"
    )


def link_tags(html: Column, tags=tuple(LINK_TAGS)) -> Column:
    """Array of tokens in document order (comments and script/style blocks included)."""
    return F.regexp_extract_all(html, F.lit(tag_pattern(tags)), 0)


def tag_name(token: Column) -> Column:
    """Lower-cased element name of a token; '' for comments and other text."""
    return F.lower(F.regexp_extract(token, r"^<([A-Za-z][A-Za-z0-9]*)", 1))


def attr_regex(attr: str) -> str:
    """Start-tag prefix up to ``attr=`` (group 1) and the raw, possibly quoted value (group 2).

    Earlier attributes are walked one by one so that text inside another value
    never matches. Every loop is possessive and the walk stops at ``attr=`` by
    a lookahead, so the Java engine iterates instead of recursing: a tag with
    tens of thousands of attributes can not overflow a task's stack.
    """
    return (
        r"(?is)^(<[a-z][a-z0-9]*+"
        rf"""(?:[\s/]++|(?!{attr}\s*+=)[^\s/>=][^\s/=>]*+{_VALUE})*+"""
        rf"""{attr}\s*+=++\s*+)("[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
    )


def last_only(token: Column) -> Column:
    """A start tag of ``a``, ``link`` or ``img`` without the earlier ones of a repeated link attribute: the last one counts."""
    def without_earlier(attr):
        atts = F.regexp_extract_all(token, F.lit(rf"(?is)^<[a-z][a-z0-9]*+|[^\s/>=][^\s/=>]*+{_VALUE}"), 0)

        def kept(xs):
            def is_it(x):
                return x.rlike(rf"(?is)^{attr}(?:\s*+=.*)?$")
            last = F.array_max(F.transform(xs, lambda x, i: F.when(is_it(x), i).otherwise(-1)))
            return F.filter(xs, lambda x, i: ~is_it(x) | (i == last))
        return F.concat(F.array_join(F.element_at(F.transform(F.array(atts), kept), 1), " "), F.lit(">"))

    out = token
    for attr, names in (("href", "a|link"), ("src", "img")):
        again = rf"""(?is)^<(?:{names})(?=[\s/])[^>]*[\s/"']{attr}[\s=/>].*[\s/"']{attr}[\s=/>]"""
        out = F.when(token.rlike(again), without_earlier(attr)).otherwise(out)
    return out


def _named(r: Column) -> Column:
    """A reference by name: the whole name, else the longest older name it starts with; any other stays as written."""
    def table(names):
        return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in names.items())), F.lit("\x02"), F.lit("\x01"))

    old = F.regexp_extract(r, _OLD_NAME, 1)
    by_old = F.when(old != "", F.concat(F.try_element_at(table(_OLD_NAMES), old), F.substring(r, F.length(old) + 2, F.length(r))))
    return F.coalesce(F.try_element_at(table(_NAMES), F.substring(r, F.lit(2), F.length(r))), by_old, r)


def _reference(r: Column) -> Column:
    """The characters of one character reference; an unknown name stays as written."""
    digits = F.regexp_extract(r, "^&#[xX]?([0-9a-fA-F]+)", 1)
    is_hex = F.lower(F.substring(r, 3, 1)) == "x"

    def character(n):
        bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        utf32 = F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(n)), 8, "0"))
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return F.when(~bad & none, F.lit("")).otherwise(F.translate(F.decode(utf32, "UTF-32"), "".join(_C1), "".join(_C1.values())))

    def number(d):
        long_ = F.length(F.ltrim(d, F.lit("0"))) > 8  # beyond every code point
        return F.when(~long_, F.when(is_hex, F.conv(d, 16, 10)).otherwise(F.conv(d, 10, 10)).cast("long"))

    numeric = F.element_at(F.transform(F.array(number(digits)), character), 1)
    return F.when(r.startswith("&#"), numeric).otherwise(_named(r))


def decode_entities(v: Column) -> Column:
    """Character references decoded once, from left to right."""
    parts = F.regexp_extract_all(v, F.lit(f"{_REFERENCE}|[^&]++|&"), 0)
    decoded = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{_REFERENCE}$"), _reference(p)).otherwise(p)), "")
    return F.when(v.contains("&"), decoded).otherwise(v)


def attr_value(token: Column, attr: str) -> Column:
    """Decoded value of ``attr`` in a start tag; null when the attribute is absent (one regex pass)."""
    raw = F.regexp_extract(token, attr_regex(attr), 2)

    def body(r):
        quoted = r.startswith('"') | r.startswith("'")
        inner = F.when(quoted, F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r)
        return F.when(r != "", decode_entities(inner))
    return F.element_at(F.transform(F.array(raw), body), 1)


def link_structs(html: Column, tags=tuple(LINK_TAGS)) -> Column:
    """array<struct<tag, attr, value>> of every link-carrying tag, document order.

    Tokens that are comments, script bodies without ``src`` or tags lacking their
    attribute are dropped, so array positions count real link occurrences.
    """
    def one(t):
        def with_name(name):
            is_href = name.isin("a", "link")
            return F.struct(
                name.alias("tag"),
                F.when(is_href, F.lit("href")).otherwise(F.lit("src")).alias("attr"),
                F.when(is_href, attr_value(t, "href")).when(name.isin("script", "img"), attr_value(t, "src"))
                .alias("value"),
            )
        # the element name is computed once per token
        return F.element_at(F.transform(F.array(tag_name(t)), with_name), 1)

    toks = F.transform(F.transform(link_tags(html, tags), last_only), one)
    return F.filter(toks, lambda s: s["value"].isNotNull() & s["tag"].isin(*tags))
