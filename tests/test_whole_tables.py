"""Queries and oracles agree on pages with hrefs of every form and on hosts with more pages than links."""

import duckdb
import pytest

import __spark_entry__ as entry

URL_KEYS = ["resolve_url", "unsafe_paths", "relative_path", "script_links", "path_conflicts", "extract_images", "image_routing"]
SITE_KEYS = ["crawl_summary", "relative_path_state", "has_path", "cycle_check", "mirror_site", "state_upsert", "replay_crawl"]
HREFS = ["/the", "word", "sub/page.html", "?q=1", "#top", "//other.example.org/x", "https://abs.example.org/y/z.css", "mailto:a@b.c", "/a.b", ""]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pages")
    rows = [(i, f"https://h{i % 3}.example.net/d{i % 2}/{i}" + ("?p=1" if i % 4 == 0 else ""),
             "".join(f'<a href="{h}">x</a>' for h in HREFS[i % 4:])) for i in range(12)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(out / "any/pages.parquet"))
    few = [(i, f"http://{'big' if i % 4 else 'small'}.example.net/{i}", '<a href="/one">1</a> <a href="/two.css">2</a>') for i in range(40)]
    spark.createDataFrame(few, "page_id long, url string, html string").coalesce(1).write.parquet(str(out / "few/pages.parquet"))
    return out


def _agree(spark, path, key):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{path}/pages.parquet/*.parquet')")
    df, res = entry.queries()[key](spark, str(path)), con.sql(entry.oracle_sql()[key])
    names = sorted(df.columns)
    assert names == sorted(res.columns)

    def norm(cols, rows):
        return sorted((tuple(r[cols.index(c)] for c in names) for r in rows), key=repr)

    got = norm(df.columns, [tuple(r) for r in df.collect()])
    assert got == norm(res.columns, res.fetchall())
    return [dict(zip(names, r, strict=True)) for r in got]


@pytest.mark.parametrize("key", URL_KEYS)
def test_every_href_form(spark, folder, key):
    rows = _agree(spark, folder / "any", key)
    if key == "resolve_url":
        assert {"word", "?q=1", "#top", "mailto:a@b.c", "https://abs.example.org/y/z.css"} <= {r["href"] for r in rows}
    if key == "relative_path":
        assert any(r["rel_path"].startswith("../") for r in rows)


@pytest.mark.parametrize("key", SITE_KEYS)
def test_every_page_of_a_host_is_on_its_site(spark, folder, key):
    rows = _agree(spark, folder / "few", key)
    if key == "mirror_site":  # every page is reached, its links lead up
        assert len(rows) == 40 and sum("/p/" in r["url"] for r in rows) == 34
        assert all(('href="../one' in r["html"]) == ("/p/" in r["url"]) for r in rows)
    if key == "relative_path_state":
        assert any((r["rel_path"] or "").startswith("../") for r in rows)
