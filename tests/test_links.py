"""Links of pages: all of them with their text, those that can't be resolved too, and pages that are taken apart once for all fields."""

from __future__ import annotations

import random

import duckdb
import pytest

from tests.oracle import connect, same_rows
from weftline import queries
from weftline.functions import html


def test_extracted_links_same_as_duckdb(spark, sf_dir):
    """Not only their number: URL and text of every link of every page, in order."""
    rows = queries.queries()["html_extract"](spark, sf_dir).collect()
    sql = """SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || h),
        list_transform(regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1), lambda t: replace(t, '&amp;', '&')) FROM pages"""
    theirs = {key: list(zip(hrefs, texts, strict=True)) for key, hrefs, texts in connect(sf_dir).execute(sql).fetchall()}
    assert {r["page_id"]: [(x["url"], x["text"]) for x in r["anchors"]] for r in rows} == theirs
    assert all(r["links"] == len(r["anchors"]) for r in rows) and sum(r["links"] for r in rows) > len(rows)


@pytest.fixture(scope="module")
def bad_dir(spark, tmp_path_factory):
    """Pages with an address that can't be read, as their own or as a link's."""
    folder = tmp_path_factory.mktemp("bad")
    page = '<html><body><p><a href="/x">x</a><p><a href="http://[bad" title="T">b <i>i</i></a></body></html>'
    rows = [(1, "http://a.example.com/d/", page), (2, "http://[bad/", page), (3, None, page)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def test_links_that_cannot_be_resolved_stay(spark, bad_dir):
    found = {r["page_id"]: [tuple(x) for x in r["anchors"]] for r in queries.queries()["html_extract"](spark, bad_dir).collect()}
    bad = ("http://[bad", "b i", "T")
    assert found == {1: [("http://a.example.com/x", "x", ""), bad], 2: [("/x", "x", ""), bad], 3: [("/x", "x", ""), bad]}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{bad_dir}/pages.parquet/*.parquet'")
    same_rows(queries.queries()["html_text"](spark, bad_dir), con, queries.oracle_sql()["html_text"])


def test_texts_of_links_are_whole():
    """A text goes on to the next link or end of one."""
    texts = lambda page: [x["text"] for x in html.parse_links(page, "http://h/")]
    assert texts("<p><a href=x>one</p><p> two</a> three") == ["one two"]
    assert texts("<a href=x />one</a> two") == ["one"]
    assert texts("<div><a href=x>one <a href=y>two</div> more") == ["one", "two more"]
    assert texts("<a href=x>one <a>two</a><a href='#f'>three</a>") == ["one"]
    assert texts("<a href=x>" + "a <br>" * 100_000) == [" ".join("a" * 100_000)]


def test_fields_at_once_equal_fields_apart():
    rng = random.Random(5)
    pieces = ["<", ">", "</", "<!--", "-->", "<p>", "</p>", "<a href=x>", "<a href='http://[b'>", "<a href=y />", "</a>", "<b>", "</b>", "<title>", "</title>", "<head>", "<script>", "</script>", "<br/>", "<div/>", "<li>", "text. ", "&amp", "\n"]
    for _ in range(2000):
        made = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        apart = {"title": html.parse_title(made), "text": html.parse_text(made), "markdown": html.parse_markdown(made), "links": html.parse_links(made, "http://h/", unresolved=True)}
        assert html.parse_page(made, "http://h/") == apart
    assert html.parse_page(None, None) == {"title": "", "text": "", "markdown": "", "links": []}
