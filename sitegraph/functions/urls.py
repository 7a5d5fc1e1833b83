"""URL column functions: split, resolve, local path, relative path, priority.

Every function maps Columns to a Column built from Spark's own expressions
(regexp, split, higher-order array functions), so the work stays in the JVM and
runs row-local with no shuffle. The semantics follow Python's ``urllib.parse``
(3.13) and ``posixpath`` because that is what the crawler being re-expressed
calls; the tests compare against those modules directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (Python 3.13 urllib.parse scheme lists; crawler path rules) ---
USES_RELATIVE = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]
USES_NETLOC = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp",
    "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
    "git+ssh", "ws", "wss", "itms-services",
]
USES_PARAMS = [
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
    "sips", "mms", "sftp", "tel",
]
INDEX_FILE = "index.html"
HTML_SUFFIX = ".html"
SCRIPT_SUFFIX_RE = r"\.(php|pl)$"
MAX_NAME_CHARS = 255
# --- end of fixed values ---

# One pass of Python's urlsplit: optional scheme, optional //netloc, path, ?query, #fragment.
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _s(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (a lambda over it).

    Nested ``when`` chains that reuse a sub-expression otherwise copy it at each
    use, which makes the expression tree grow exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(body, **values: Column) -> Column:
    """``let`` for several named values, reachable as fields of the bound struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def clean_url(u: Column | str) -> Column:
    """Strip leading C0 controls/blanks and remove tab, CR and LF anywhere."""
    return F.regexp_replace(F.regexp_replace(_s(u), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, _SPLIT, group)


def _parts(clean: Column) -> Column:
    """struct(scheme, netloc, path, query, fragment) of an already cleaned URL."""
    return let(clean, lambda u: F.struct(
        F.lower(_part(u, 1)).alias("scheme"), _part(u, 3).alias("netloc"), _part(u, 4).alias("path"),
        _part(u, 5).alias("query"), _part(u, 6).alias("fragment"),
    ))


def url_parts(u: Column | str) -> Column:
    """``urlsplit`` as a struct: scheme (lower-cased), netloc, path, query, fragment."""
    return _parts(clean_url(u))


def url_scheme(u: Column | str) -> Column:
    """Lower-cased scheme, '' when absent."""
    return F.lower(_part(clean_url(u), 1))


def url_netloc(u: Column | str) -> Column:
    """netloc exactly as written: userinfo, port and case kept."""
    return _part(clean_url(u), 3)


def url_path_full(u: Column | str) -> Column:
    """Path including any ``;params`` of the last segment."""
    return _part(clean_url(u), 4)


def url_query(u: Column | str) -> Column:
    return _part(clean_url(u), 5)


def url_fragment(u: Column | str) -> Column:
    return _part(clean_url(u), 6)


def _split_params(path: Column, scheme: Column) -> Column:
    """struct(path, params) as ``urlparse`` splits them: last segment only, param schemes only."""
    def body(v):
        last = F.regexp_extract(v["p"], r"([^/]*)$", 1)
        has = v["s"].isin(USES_PARAMS) & last.contains(";")
        head = F.regexp_extract(v["p"], r"(?s)^(.*/)?[^/]*$", 1)
        return F.struct(
            F.when(has, F.concat(head, F.substring_index(last, ";", 1))).otherwise(v["p"]).alias("path"),
            F.when(has, F.regexp_extract(last, r"(?s)^[^;]*;(.*)$", 1)).otherwise(F.lit("")).alias("params"),
        )
    return bind(body, p=path, s=scheme)


def url_path(u: Column | str) -> Column:
    """``urlparse(u).path``: the path without the last segment's ``;params``."""
    return let(url_parts(u), lambda p: _split_params(p["path"], p["scheme"])["path"])


def _netloc_ok(net: Column) -> Column:
    def body(n):
        has_open, has_close = n.contains("["), n.contains("]")
        host = F.regexp_extract(n, r"\[([^\]]*)\]", 1)
        good_host = host.rlike(r"^v[0-9A-Fa-f]+\..+$") | (host.rlike(r"^[0-9A-Fa-f:.]+$") & host.contains(":"))
        return (~has_open & ~has_close) | (has_open & has_close & good_host)
    return let(net, body)


def url_valid(u: Column | str) -> Column:
    """False where ``urlsplit`` raises: unbalanced IPv6 brackets or a bad bracketed host."""
    return _netloc_ok(url_netloc(u))


def _unsplit(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    """``urlunsplit``: drops empty query and fragment, adds '//' where the scheme needs it."""
    def body(v):
        s, n, p, q, f = v["s"], v["n"], v["p"], v["q"], v["f"]
        lead = F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
        slashes = (
            F.when(n != "", F.concat(F.lit("//"), n))
            .when(p.startswith("//") | ((s != "") & s.isin(USES_NETLOC) & ((p == "") | p.startswith("/"))),
                  F.lit("//"))
            .otherwise(F.lit(""))
        )
        return F.concat(
            F.when(s != "", F.concat(s, F.lit(":"))).otherwise(F.lit("")),
            slashes,
            F.when(n != "", lead).otherwise(p),
            F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")),
            F.when(f != "", F.concat(F.lit("#"), f)).otherwise(F.lit("")),
        )
    return bind(body, s=scheme, n=netloc, p=path, q=query, f=fragment)


def _join_params(path: Column, params: Column) -> Column:
    return F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)


def _remove_dot_segments(segments: Column) -> Column:
    """Walk the segments: '..' pops (if anything is left), '.' is skipped, others are pushed."""
    def body(seg):
        walked = F.aggregate(
            seg,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        return F.when(F.element_at(seg, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return let(segments, body)


def _merge_path(bpath: Column, hpath: Column) -> Column:
    """RFC 3986 merge of a relative path into the base path, then dot-segment removal."""
    def body(v):
        base_parts = F.split(v["b"], "/", -1)
        base_dir = let(base_parts, lambda bp: F.when(
            F.element_at(bp, -1) != "", F.slice(bp, 1, F.size(bp) - 1)).otherwise(bp))
        rel = let(F.concat(base_dir, F.split(v["h"], "/", -1)), lambda ra: F.filter(
            ra, lambda x, i: (i == 0) | (i == F.size(ra) - 1) | (x != "")))
        segments = F.when(v["h"].startswith("/"), F.split(v["h"], "/", -1)).otherwise(rel)
        joined = F.array_join(_remove_dot_segments(segments), "/")
        return F.when(joined == "", F.lit("/")).otherwise(joined)
    return bind(body, b=bpath, h=hpath)


# a root-relative href that urljoin returns as scheme://netloc + href unchanged:
# no netloc, query, fragment, params, dot segments, blanks to strip or tab/CR/LF to drop
_FAST_HREF = r"^/(?:[^/?#;\t\r\n][^?#;\t\r\n]*)?$"
_DOT_SEGMENT = r"(^|/)\.\.?(/|$)"
_FAST_BASE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\[\]\t\r\n\x00-\x20]+)(?:[/?#][^\t\r\n]*)?$"


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """``urljoin(base, href)`` as one Column expression.

    Null where Python raises ``ValueError`` (malformed netloc); such a link is
    dropped instead of aborting its whole page. Plain root-relative hrefs (the
    common case) take a short path of two regex tests; everything else runs
    the full resolver (``CASE`` evaluates only the branch it needs).
    """
    b0, h0 = _s(base), _s(href)
    scheme = F.lower(F.regexp_extract(b0, _FAST_BASE, 1))
    fast = (h0.rlike(_FAST_HREF) & ~h0.rlike(_DOT_SEGMENT) & b0.rlike(_FAST_BASE)
            & scheme.isin(USES_RELATIVE) & (scheme != ""))
    short = F.concat(scheme, F.lit("://"), F.regexp_extract(b0, _FAST_BASE, 2), h0)
    return F.when(fast, short).otherwise(_resolve_full(b0, h0))


def _resolve_full(base: Column, href: Column) -> Column:
    def body(io):
        def inner(p):
            B, Hh = p["B"], p["H"]

            def with_scheme(v):
                sch = v["scheme"]
                bsplit, hsplit = v["bsplit"], v["hsplit"]
                absolute = _unsplit(sch, Hh["netloc"], _join_params(hsplit["path"], hsplit["params"]),
                                    Hh["query"], Hh["fragment"])
                same_doc = _unsplit(sch, B["netloc"], _join_params(bsplit["path"], bsplit["params"]),
                                    F.when(Hh["query"] != "", Hh["query"]).otherwise(B["query"]), Hh["fragment"])
                merged = _unsplit(sch, B["netloc"],
                                  _join_params(_merge_path(bsplit["path"], hsplit["path"]), hsplit["params"]),
                                  Hh["query"], Hh["fragment"])
                return (
                    F.when((sch != B["scheme"]) | ~sch.isin(USES_RELATIVE), io["h0"])
                    .when(Hh["netloc"] != "", absolute)
                    .when((hsplit["path"] == "") & (hsplit["params"] == ""), same_doc)
                    .otherwise(merged)
                )

            sch_expr = F.when(Hh["scheme"] != "", Hh["scheme"]).otherwise(B["scheme"])
            resolved = let(sch_expr, lambda sch: bind(
                with_scheme, scheme=sch,
                bsplit=_split_params(B["path"], B["scheme"]), hsplit=_split_params(Hh["path"], sch)))
            ok = _netloc_ok(B["netloc"]) & _netloc_ok(Hh["netloc"])
            return F.when(ok, resolved)

        parsed = bind(inner, B=_parts(clean_url(io["b0"])), H=_parts(clean_url(io["h0"])))
        return (
            F.when(io["b0"].isNull() | io["h0"].isNull(), F.lit(None).cast("string"))
            .when(io["b0"] == "", io["h0"])
            .when(io["h0"] == "", io["b0"])
            .otherwise(parsed)
        )
    return bind(body, b0=_s(base), h0=_s(href))


# ---------------------------------------------------------------- local file paths

def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def dirname(p: Column) -> Column:
    """``posixpath.dirname``: head without trailing slashes (unless it is all slashes)."""
    def body(head):
        stripped = F.regexp_replace(head, r"/+$", "")
        return F.when((head != "") & (stripped == ""), head).otherwise(stripped)
    return let(F.regexp_extract(p, r"(?s)^(.*/)?[^/]*$", 1), body)


def split_ext(p: Column) -> Column:
    """``posixpath.splitext`` as struct(stem, ext): last dot of the base name, leading dots ignored."""
    def body(v):
        ext = F.regexp_extract(basename(v), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
        return let(ext, lambda e: F.struct(
            F.when(e == "", v).otherwise(F.substring(v, F.lit(1), F.length(v) - F.length(e))).alias("stem"),
            e.alias("ext"),
        ))
    return let(p, body)


def name_hash(text: Column, hash_algo: str = "md5", hash_len: int | None = None) -> Column:
    """Hex digest used in file names (JVM built-ins, checkable in DuckDB).

    The whole digest by default, so that two URLs do not share a file;
    ``hash_len`` cuts it to short names that may collide on large sites.
    """
    if hash_algo not in ("md5", "sha256"):
        raise ValueError(f"unknown name hash {hash_algo!r}")
    data = F.encode(text, "UTF-8")
    digest = F.md5(data) if hash_algo == "md5" else F.sha2(data, 256)
    return digest if hash_len is None else F.substring(digest, 1, hash_len)


def _name_len(x: Column, unit: str) -> Column:
    if unit == "chars":
        return F.length(x)
    if unit == "bytes":
        return F.octet_length(x)
    raise ValueError(f"unknown name length unit {unit!r}")


def _path_steps(u: Column, qhash, lhash, max_name: int, final: bool, name_unit: str = "chars") -> Column:
    """Rules U3a-U3e; ``qhash``/``lhash`` give the hash of the query / of the long path."""
    def body(p):
        path = _split_params(p["path"], p["scheme"])["path"]
        step1 = let(path, lambda x: (
            F.when((x == "") | x.endswith("/"), F.concat(x, F.lit(INDEX_FILE)))
            .when(~basename(x).contains(".") | x.rlike(SCRIPT_SUFFIX_RE), F.concat(x, F.lit(HTML_SUFFIX)))
            .otherwise(x)))
        step2 = let(step1, lambda x: F.when(p["query"] != "", let(split_ext(x), lambda se: F.concat(
            se["stem"], F.lit("_"), qhash(p["query"]), se["ext"]))).otherwise(x))
        if not final:
            return step2
        step3 = let(step2, lambda x: F.when(
            _name_len(basename(x), name_unit) > max_name, F.concat(lhash(x), split_ext(x)["ext"])).otherwise(x))
        rel = F.regexp_replace(step3, r"^/+", "")
        return F.when(p["netloc"] != "", F.concat(p["netloc"], F.lit("/"), rel)).otherwise(rel)
    return F.when(u.isNotNull(), let(url_parts(u), body))


def local_name(u: Column | str, hash_algo: str = "md5", hash_len: int | None = None) -> Column:
    """The file path inside its host folder before the long-name rule."""
    h = lambda x: name_hash(x, hash_algo, hash_len)
    return _path_steps(_s(u), h, h, MAX_NAME_CHARS, False)


def local_path(
    u: Column | str,
    hash_algo: str = "md5",
    hash_len: int | None = None,
    max_name: int = MAX_NAME_CHARS,
    name_unit: str = "chars",
) -> Column:
    """Where a URL is saved, relative to the output folder (rules U3a-U3e).

    1. empty path or trailing '/' -> ``index.html`` appended;
    2. no '.' in the base name, or ending ``.php``/``.pl`` -> ``.html`` appended;
    3. a query -> ``_<hash(query)>`` inserted before the extension;
    4. a base name over ``max_name`` characters -> ``<hash(path)><ext>``, folders dropped;
    5. prefixed by the netloc, leading slashes removed.

    Names use a JVM built-in digest (``md5`` default, or ``sha256``) instead
    of xxh32, which Spark lacks; only the hex digits differ.
    ``name_unit="bytes"`` applies the name limit to UTF-8 bytes (what most
    file systems count) instead of characters.
    """
    h = lambda x: name_hash(x, hash_algo, hash_len)
    return _path_steps(_s(u), h, h, max_name, True, name_unit)


def _components(p: Column) -> Column:
    """``normpath`` of a relative path as an array: drop '' and '.', '..' pops a real component."""
    parts = F.filter(F.split(p, "/", -1), lambda x: (x != "") & (x != "."))
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def norm_path(p: Column | str) -> Column:
    """``posixpath.normpath`` for relative paths ('.' when nothing is left)."""
    return let(F.array_join(_components(_s(p)), "/"), lambda j: F.when(j == "", F.lit(".")).otherwise(j))


def relative_path(to_path: Column | str, start_dir: Column | str) -> Column:
    """``os.path.relpath(to_path, start_dir)`` for two paths under one root."""
    def body(v):
        a, b = v["a"], v["b"]
        n = F.least(F.size(a), F.size(b))
        common = F.when(n == 0, F.lit(0)).otherwise(F.aggregate(
            F.sequence(F.lit(1), n), F.lit(0),
            lambda acc, i: F.when((acc == i - 1) & (F.element_at(a, i) == F.element_at(b, i)), i).otherwise(acc),
        ))

        def finish(c):
            up = F.array_repeat(F.lit(".."), F.size(a) - c)
            rest = F.slice(b, c + 1, F.greatest(F.size(b) - c, F.lit(0)))
            return let(F.array_join(F.concat(up, rest), "/"), lambda j: F.when(j == "", F.lit(".")).otherwise(j))
        return let(common, finish)
    return bind(body, a=_components(_s(start_dir)), b=_components(_s(to_path)))


def link_target_path(from_url: Column | str, to_url: Column | str, **path_opts) -> Column:
    """New href for a link: relpath(path(to), dirname(path(from)))."""
    return relative_path(local_path(to_url, **path_opts), dirname(local_path(from_url, **path_opts)))


def state_relative_path(from_path: Column | str, to_path: Column | str) -> Column:
    """Relative path between two recorded paths; null unless both are non-empty.

    A ``from`` path whose base name has no '.' is taken as a folder itself.
    """
    def body(v):
        fp, tp = v["f"], v["t"]
        start = F.when(basename(fp).contains("."), dirname(fp)).otherwise(fp)
        ok = fp.isNotNull() & (fp != "") & tp.isNotNull() & (tp != "")
        return F.when(ok, relative_path(tp, start))
    return bind(body, f=_s(from_path), t=_s(to_path))


def script_link(href: Column | str) -> Column:
    """``.php``/``.pl`` at the end of an href becomes ``.html`` (last extension only)."""
    return F.regexp_replace(_s(href), SCRIPT_SUFFIX_RE, HTML_SUFFIX)


def url_priority(u: Column | str, weights: Sequence[str]) -> Column:
    """Index of the first weight contained in the URL, else ``len(weights)``."""
    u = _s(u)
    expr = F.lit(len(weights))
    for i in reversed(range(len(weights))):
        expr = F.when(u.contains(weights[i]), F.lit(i)).otherwise(expr)
    return expr


def url_priority_by(u: Column | str, weights: Column | str) -> Column:
    """U5 with per-row weights (``array<string>``, e.g. one list per crawl)."""
    w = _s(weights)
    hit = F.array_position(F.transform(w, lambda x: F.instr(_s(u), x) > 0), True)
    return F.when(hit > 0, hit - 1).when(w.isNull(), F.lit(0)).otherwise(F.size(w)).cast("int")


def is_excluded_by(u: Column | str, excluded: Column | str) -> Column:
    """P2 with per-row exclusions (``array<string>``)."""
    return F.coalesce(F.exists(_s(excluded), lambda x: F.instr(_s(u), x) > 0), F.lit(False))


def is_excluded(u: Column | str, excluded: Sequence[str]) -> Column:
    """True when any exclusion string is a substring of the URL."""
    u = _s(u)
    out = F.lit(False)
    for x in excluded:
        out = out | u.contains(x)
    return out


def in_domain(u: Column | str, domain: Column | str, strict: bool = False) -> Column:
    """The start URL's netloc is a substring of the URL (``strict``: netloc equality)."""
    u, d = _s(u), _s(domain)
    return (url_netloc(u) == d) if strict else u.contains(d)


def crawl_key(start_url: Column | str) -> Column:
    """Crawl id: hex SHA-256 of the start URL."""
    return F.sha2(F.encode(_s(start_url), "UTF-8"), 256)


def content_kind(content_type: Column | str, u: Column | str) -> tuple[Column, Column, Column]:
    """(kind, is_html, write_mode) for a fetched resource (rules U7, U8)."""
    ct = F.substring_index(F.coalesce(_s(content_type), F.lit("")), ";", 1)
    kind = F.when(ct.startswith("text") | _s(u).rlike(SCRIPT_SUFFIX_RE), F.lit("text/html")).otherwise(ct)
    is_html = kind.contains("text/html")
    mode = F.when(kind.contains("text"), F.lit("text")).otherwise(F.lit("binary"))
    return kind, is_html, mode


def escapes_root(p: Column | str) -> Column:
    """True when a relative path climbs above its root (a '..' that cannot pop)."""
    comps = _components(_s(p))
    return F.coalesce(F.try_element_at(comps, F.lit(1)) == "..", F.lit(False)) | _s(p).startswith("/")
