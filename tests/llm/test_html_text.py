from __future__ import annotations

import html
import os
import re
import time

import pytest

from plumbline.llm import html_text
from plumbline.llm.queries import op7_html_text

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


def article_of(page: str) -> str:
    """What stands in the only article of a page whose paragraphs are flat: its blocks, parted by tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|table|tr|td|pre|blockquote)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_whole_table_equals_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = op7_html_text(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


def test_blocks_and_references():
    page = "<body><p>a&amp;b &#233;<b>x</b> \n y&nbsp;z<br>w<div class='ad-box'>buy</div><!-- <p>no --><p id=c>1 &lt; 2</p>tail"
    assert [b[0] for b in html_text.blocks(page)] == ["a&b éx y z w", "buy", "1 < 2", "tail"]
    assert [b[3] for b in html_text.blocks(page)] == [0, 1, 0, 0]
    assert html_text.blocks('<a href="x>y">link</a> text')[0][0] == "link text"
    assert html_text.blocks("<script>if (a<b) '<p>'</script><style>p{}") == []


def test_pages_of_other_shapes(spark, tree):
    long = "word " * 60
    pages = [
        f"<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><header><h1>Title</h1></header><p>{long}</p>"
        f"<p>Short.</p><aside>{long}</aside><form><label>Mail</label></form></main>"
        f"<section class='comments'><p>{long}</p></section><footer>{long}</footer>",
        f"<div id=menu><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></div><div class=content><h2>A title of some words</h2><p>{long}"
        f"<p>{long}</div><div class='cookie-notice'>We use cookies</div><div id=footer>All rights</div>",
    ]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(frame, tree).collect()}
    assert got[0] == ["Title", long.strip(), "Short."]
    assert got[1] == ["A title of some words", long.strip(), long.strip()]


LONG = "word " * 60


@pytest.mark.parametrize(
    "page",
    [
        f"<div style='overflow:hidden' aria-hidden=false data-id=sidebar><article><p>{LONG}</article></div>",
        f"<div class='layout has-sidebar'><div class=no-comments><p>{LONG}<p>{LONG}</div></div>",
        f"<div id=related-layout><main><p>{LONG}</main></div><div class=comments><article><p>{LONG}</article></div>",
        f"<div class=share><article><p>{LONG}</article></div>",
        f"<div class=social><p>{LONG}<p>{LONG}</div><p><a href=/>Home</a>",
        f"<head><title>T</title><meta charset=utf-8><p>{LONG}<p>{LONG}",
        f"<head><title>T</head><body><article><p>{LONG}</article>",
        f"<div><select><option>One</div><article><p>{LONG}</article>",
        f"<div><textarea>One</div><article><p>{LONG}</article>",
        f"<head><noscript>x</noscript><style>p{{}}</style></head><div><svg><text>s</div><article><p>{LONG}</article>",
    ],
)
def test_loose_pages_keep_their_article(spark, tree, page):
    frame = spark.createDataFrame([(1, page)], "page_id long, html string")
    text = html_text.extract(frame, tree).head().text
    assert text and set(text.split("\n")) == {LONG.strip()}


def test_neighbours_decide_where_a_page_says_nothing(spark, tree):
    def asked(node) -> set[str]:
        return set() if isinstance(node, int) else {node[0]} | asked(node[2]) | asked(node[3])

    def left_of(node, **known) -> set[int]:
        """Answers still possible where these features are known."""
        if isinstance(node, int):
            return {node}
        name, threshold, low, high = node
        sides = (low, high) if name not in known else (low,) if known[name] <= threshold else (high,)
        return set().union(*(left_of(side, **known) for side in sides))

    assert left_of(tree, place=-1) == {0} and left_of(tree, place=1) == {1} and left_of(tree, place=0) == {0, 1}
    assert {"links", "words_before", "links_before", "words_after", "links_after"} & asked(tree) > {"links"}
    link = lambda text: f"<p><a href=/>{text}</a></p>"
    menu = link("Home") + link("All news") + link("About us")
    inside = link("the full report of the committee on this year of work")
    page = f"{menu}<h1>A title of five words</h1><p>{LONG}</p>{inside}<p>{LONG}</p>{menu}<p>All rights reserved</p>"
    listed = f"<nav>{menu}</nav><article><p>{LONG}</p>{inside}{inside}{inside}</article>{menu}<p>Read next</p><p>{LONG}</p>"
    frame = spark.createDataFrame([(1, page), (2, listed)], "page_id long, html string")
    got = {r.page_id: r.text.split("\n") for r in html_text.extract(frame, tree).collect()}
    report = "the full report of the committee on this year of work"
    assert got[1] == ["A title of five words", LONG.strip(), report, LONG.strip()]
    assert got[2] == [LONG.strip(), report, report, report]


def test_attributes_are_read_by_their_whole_names():
    apart = lambda page: [b[3] for b in html_text.blocks(page + "<p>" + LONG * 9)]
    assert apart("<div hidden>a</div>") == apart("<div class='my comments'>a</div>") == [1, 0]
    assert apart("<div data-class=comments aria-hidden=true>a</div>") == apart("<div title='a hidden one'>a</div>") == [0, 0]


def test_odd_rows(spark, tree):
    rows = [(1, None, "k"), (2, "", "k"), (3, "<", "k"), (3, "<", "k"), (None, "<p>" * 50_000, None), (4, "<article><p>one<p>two", "k")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract(frame, tree)
    assert sorted(got.columns) == ["html", "page_id", "text"]
    assert {(r.page_id, r.text) for r in got.collect()} >= {(1, ""), (2, ""), (None, ""), (4, "one\ntwo")}
    assert got.count() == len(rows) and html_text.extract(frame.limit(0), tree).count() == 0


def test_apostrophes_comment_ends_and_stray_tags_lose_no_article():
    said = lambda page: [b[0] for b in html_text.blocks(page)]
    assert said("<article><p title=it's>long</p><p>don't stop</p></article>") == ["long", "don't stop"]
    assert said("<article><!-- x --!><p>long</p></article>") == said("<!--><p>long</p>") == said("<!---><p>long</p>") == ["long"]
    assert said("""<p title="a>b" data-x='c>d' class=a'b"c>one</p><p a = 'x>y'>two</p>""") == ["one", "two"]
    assert said("3 < 4 and <b>5</b> > 2<br>") == ["3 < 4 and 5 > 2"]
    assert said("<div><p>a</x></div></p></div>b") == ["a", "b"]


@pytest.mark.parametrize("part", ["<a ", '<a x="', "<a x='", "<a b=c ", "<!--", "</x>", "<script ", "<div ='", "<div></x>", "<p<"])
def test_hostile_pages_take_linear_time(part):
    start = time.perf_counter()
    html_text.blocks(part * (600_000 // len(part)))
    html_text.blocks("<div>" * 60_000 + "</x>" * 60_000)
    assert time.perf_counter() - start < 5
