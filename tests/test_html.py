"""Blocks, links, fields and listing entries, of the pages table and of broken markup."""

import html as entities
import re
import time

import pytest

from tessera.operators import html as H
from tests.conftest import DATA

LISTING = """
<body><div id=other><div class="block"><div class="download"><a href="/no.pdf">no</a></div></div></div>
<div class='x' id='investigation_reports'>
 <div class="odd block"><div class=desc><p><a href="/r/1">First &amp; <b>best</b></a></p><p class='location'>Reno,
   NV</p><p class="data">Accident Date: 1/2/2024<br/>Report Date: 11/30/2025</p><p class=report>Report Number: AIR-25-07 </p></div>
   <div class="download"><span><a target=_blank href='https://host/docs/AIR2507.pdf'>PDF</a></span></div></div>
 <div class="block"><div class="desc"><p><a>No document</a></p></div></div>
 <div class="block"><div class="download"><a href="page.html">x</a><a href="b/AIR1.pdf">y</a></div></div>
"""


def test_entries_of_a_listing():
    first, second = H.entries_of(LISTING)
    assert first == {
        "filename": "AIR2507.pdf", "title": "First & best", "location": "Reno, NV", "accident_date": "2024-01-02", "report_date": "2025-11-30",
        "report_number": "AIR-25-07", "url": "https://host/docs/AIR2507.pdf",
    }
    assert second["url"] == "b/AIR1.pdf" and {v for k, v in second.items() if k not in ("url", "filename")} == {""}


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("only text", [("", "only text")]),
        ("<p>one<p>two<b>bold<p>three", [("p", "one"), ("p", "twobold"), ("p", "three")]),
        ("<div>a<p>b</p>c</div>d", [("", "d"), ("div", "a c"), ("p", "b")]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("li", "a"), ("li", "b"), ("li", "c")]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", [("td", "1"), ("td", "2"), ("th", "3")]),
        ("</div></p>x<script>var t='<p>no</p>'</script><!-- <p>no --><style>p{}</style>", [("", "x")]),
        ("<p title='a>b'>a&lt;b&nbsp;c<br>d</P>", [("p", "a<b c\nd")]),
        ("<p>a < b <i>c", [("p", "a < b c")]),
    ],
)
def test_blocks_of_broken_markup(page, blocks):
    assert [(b["tag"], b["text"]) for b in H.blocks_of(page)] == blocks


def plain_words(page):
    """All words in the order of their tags' ends cut away: no scripts, comments or tags."""
    page = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)\b.*?</\1\s*>", "", page, flags=re.DOTALL | re.IGNORECASE)
    page = re.sub(r"</?([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>", lambda m: " " if m[1].lower() in H.BLOCKS | {"br"} else "", page)
    return sorted(entities.unescape(page).split())


def test_blocks_hold_every_word_of_the_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got: dict[int, list] = {}
    for r in H.html_blocks(pages).collect():
        got.setdefault(r.page_id, []).extend(r.text.split())
    assert {k: sorted(v) for k, v in got.items()} == {r.page_id: plain_words(r.html) for r in pages.collect() if plain_words(r.html)}


def test_fields_and_links_of_the_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    fields = {r.page_id: (r.title, r.lang, r.links) for r in H.html_fields(pages).collect()}

    def plain(page):
        title, lang = re.search(r"<title>(.*?)</title>", page, re.DOTALL), re.search(r'<html lang="([^"]*)"', page)
        return title and " ".join(entities.unescape(title[1]).split()), lang and lang[1], len(re.findall("<a href=", page))

    assert fields == {r.page_id: plain(r.html) for r in pages.collect()}


def test_attributes_in_any_order_and_quoting():
    page = "<html class=x lang='de'><head><title>T &amp; U</title><meta content=words name=Description></head><h1>H</h1><a class='c' href=/one>1</a><a href>none</a><a href='2&amp;3'>2</a>"
    assert next(H.fields_of(page)) == {"title": "T & U", "heading": "H", "lang": "de", "description": "words", "links": 2}
    assert [(r["href"], r["text"]) for r in H.links_of(page)] == [("/one", "1"), ("2&3", "2")]


def test_awkward_pages(spark):
    rows = [(1, None, 7), (1, "", 7), (None, "<p>x", 7), (2, "<p>y", None), (2, "<p>y", None), (3, "<b>" * 3000 + "<div>" * 3000 + "deep" + "</i>" * 3000, 1)]
    got = H.html_blocks(spark.createDataFrame(rows, "page_id int, html string, place int")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "x"), (2, "y"), (2, "y"), (3, "deep")]
    assert H.html_fields(spark.createDataFrame(rows, "page_id int, html string, place int")).count() == len(rows)
    assert H.html_links(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_long_pages_take_linear_time():
    took = []
    for n in (5_000, 40_000):
        page, began = "<div><p>word <b>bold</i></li>" * n, time.process_time()
        assert sum(1 for _ in H.blocks_of(page)) > 0
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02), took
