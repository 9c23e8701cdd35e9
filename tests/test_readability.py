"""Main content: precision and recall on pages with known chrome, hand-written pages, and the edges."""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

import pytest
from pyspark.sql import functions as F

from weftline.functions import html, readability
from weftline.plans import corpus

PARAGRAPHS = [
    "The river rose by two metres in the night, and by morning the lower streets were under water. Nobody was hurt.",
    "Officials said that the dam had held; engineers will look at it again once the level has fallen below four metres.",
    "Shops on the market square opened later than usual, but most of them had power again before noon.",
]
TEXT = " ".join(PARAGRAPHS)
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
NAV = "<ul>" + "".join(f'<li><a href="/{w}">{w} news</a></li>' for w in ("world", "local", "sports", "weather", "culture")) + "</ul>"
#: Pages that hold TEXT as their content: each says what stands around it.
PAGES = {
    "article": f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{NAV}</nav><article>{BODY}</article><footer>All rights reserved. Contact us, or read our terms of use.</footer></body></html>",
    "named divs": f'<body><div id="header">{NAV}</div><div class="content">{BODY}</div><div class="sidebar"><p>Subscribe to our letter today. You will love it, we promise you that.</p></div></body>',
    "no names": f"<body><div>{NAV}</div><div><div>{BODY}</div></div><div>{NAV}</div></body>",
    "open paragraphs": f"<body>{NAV}<div class=post>" + "".join(f"<p>{p}" for p in PARAGRAPHS) + "</div><div class=footer>Footer text that is long enough. It has two sentences.</div>",
    "table": f"<body><table><tr><td>{NAV}</td><td>{BODY}</td></tr></table></body>",
    "chrome inside": f'<body><main>{BODY.replace("</p><p>", "</p><div class=ad>Buy now. It is the very best thing that you can buy.</div><p>", 1)}<div class="share-buttons"><a href="/x">Share this</a></div></main></body>',
    "comments": f'<body><div class="entry">{BODY}</div><div class="comments"><p>First! This is a comment of some length, and it is not content.</p><p>Second. So is this one, which goes on for a while.</p></div></body>',
    "breaks": "<body><div class=menu>" + NAV + "</div><div class=text>" + "<br><br>".join(PARAGRAPHS) + "</div></body>",
    "scripts": f"<body><script>var a = '<p>no</p>';</script><div>{BODY}<script>document.write('x')</script></div><noscript>Please turn scripts on. Thank you very much for it.</noscript></body>",
    "links in text": "<body><nav>" + NAV + "</nav><section>" + BODY.replace("river", '<a href="/r">river</a>').replace("dam", '<a href="/d">dam</a>') + "</section></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(name):
    assert readability.parse_main_text(PAGES[name]) == TEXT


def test_markdown_of_the_content():
    page = f"<body><nav>{NAV}</nav><article><h1>High water</h1>{BODY.replace('dam', '<a href=/d>dam</a>')}<ul><li>one <b>bold</b> item, which is content too.</li><li>two</li></ul></article></body>"
    made = readability.parse_main_markdown(page)
    assert made.startswith("# High water") and "[dam](/d)" in made and "**bold**" in made and "- two" in made and "world" not in made
    assert html.extractor("readability") is readability.main_markdown


def words(text):
    return Counter(re.findall(r"\w+", text))


def test_precision_and_recall_on_pages(spark, sf_dir):
    """Words of the pages' articles against those that are kept; everything else on them is chrome."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html", readability.main_text("html").alias("kept")).collect()
    both = kept = wanted = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        a, b = words(unescape(re.sub(r"<[^>]*>", " ", inner))), words(r["kept"])
        both, kept, wanted = both + (a & b).total(), kept + b.total(), wanted + a.total()
    assert both >= 0.99 * kept and both >= 0.99 * wanted


def test_noise_around_changes_nothing():
    """Whatever chrome stands around the article, in whatever order, its text is what comes out."""
    rng = random.Random(13)
    chrome = [f"<nav>{NAV}</nav>", "<aside>Aside that says something. It is not short at all.</aside>", "<div class='ad banner'>Buy it. Now, please, or never.</div>", "<form>Search <input name=q></form>", f"<div id=related>{NAV}</div>", "<header><h2>Site name</h2></header>", "<!-- <p>no</p> -->", "<div><img src=x></div>", "<p>"]
    for _ in range(200):
        before, after = ("".join(rng.choices(chrome, k=rng.randint(0, 5))) for _ in range(2))
        assert readability.parse_main_text(f"<html><body>{before}<div>{BODY}</div>{after}</body></html>") == TEXT


def test_edges(spark):
    assert [readability.parse_main_text(x) for x in (None, "", "<p>short</p>", f"<nav>{NAV}</nav>", "<script>x. y. z.</script>" * 50)] == [""] * 5
    assert readability.parse_main_text(TEXT) == TEXT  # no block at all
    assert readability.parse_main_text(f"<nav>{NAV}</nav><article><h1>A b</h1><p>c.</article><footer>All rights reserved. Ask us.</footer>") == "A b c."
    long = "<body><div class=content>" + "<p>A sentence that goes on and on. " * 30_000 + "</div>"
    assert len(readability.parse_main_text(long).split()) == 7 * 30_000
    deep = "<div>" * 3000 + BODY + "</div>" * 3000
    assert readability.parse_main_text(deep) == TEXT
    rng = random.Random(14)
    pieces = ["<", ">", "</", "<!", "]]>", "<!--", "-->", "<p>", "</div>", "<div class=ad>", "<a href=x>", "<table>", "text. ", "&amp;", "<li>", "</p>", "<script>", "</body>"]
    for _ in range(2000):
        made = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        readability.parse_main_text(made), readability.parse_main_markdown(made)
    frame = spark.createDataFrame([(PAGES["article"], 1), (None, 2), (PAGES["article"], 1)], "html string, main int")
    assert [r[0] for r in frame.orderBy("main").select(readability.main_text("html")).collect()] == [TEXT, TEXT, ""]
    assert frame.limit(0).select(readability.main_text("html")).count() == 0


def test_corpus_by_the_extractor(spark):
    pages = spark.createDataFrame([("http://a/", PAGES["article"])], "url string, html string")
    assert " ".join(corpus.documents(pages, "readability").first()["markdown"].split()) == TEXT
