"""Blocks, links and fields of raw web pages.

One tolerant scan of tags with a stack of open elements runs inside Arrow batches: void elements
never open, an end tag closes up to the nearest element of its name and is ignored if there is
none, a block closes an open paragraph, list items and table parts close their like, and what is
open at the end is closed there. Attributes count in any order and quoting; entities are decoded;
scripts, styles and comments hold no text.

Defined cases: null, empty and tagless pages have no blocks but their text; repeated rows give
their rows again; pages of any length count whole; other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from tessera.operators.chunking import per_document
from tessera.plans.registry import query
from tessera.sources.tables import table

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset(("script", "style"))
#: What an opening tag closes, and the element up to which it looks.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    depth: int = 0
    children: list[Element] = field(default_factory=list)
    parts: list[str | Element] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set(self.attributes.get("class", "").split())

    def walk(self) -> Iterator[Element]:
        """The elements below, in document order, without recursion."""
        left = self.children[::-1]
        while left:
            element = left.pop()
            yield element
            left.extend(reversed(element.children))

    def text(self, blocks: bool = True) -> str:
        """The text, words apart by one space, a line for each ``br``; without ``blocks``, that
        of blocks below is left out."""
        out, left = [], [self]
        while left:
            part = left.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag == "br":
                out.append("\n")
            elif not blocks and part is not self and part.tag in BLOCKS:
                out.append(" ")
            elif part.tag not in SILENT:
                own = part is not self and part.tag in BLOCKS
                left.extend([" "] * own + part.parts[::-1] + [" "] * own)
        lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
        return "\n".join(filter(None, lines))


class _Scanner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: Counter[str] = Counter()

    def _leave(self, element: Element) -> None:
        """Close all open elements down to this one."""
        last = element.parent
        while self.at is not last:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags: set[str], until: set[str] | frozenset[str]) -> None:
        """Leave the outermost open element of ``tags`` below the nearest of ``until``."""
        if not any(self.open[t] for t in tags):
            return
        at, found = self.at, None
        while at.parent is not None and at.tag not in until:
            if at.tag in tags:
                found = at
            at = at.parent
        if found is not None:
            self._leave(found)

    def handle_starttag(self, tag, attributes):
        if tag in BLOCKS:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        own: dict[str, str] = {}
        for name, value in attributes:  # the first of a name counts
            own.setdefault(name, value or "")
        element = Element(tag, own, self.at, self.at.depth + 1)
        self.at.children.append(element)
        self.at.parts.append(element)
        if tag not in VOID:
            self.at = element
            self.open[tag] += 1

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag):
        if self.open[tag]:
            at = self.at
            while at.tag != tag:
                at = at.parent
            self._leave(at)

    def handle_data(self, data):
        self.at.parts.append(data.replace("\n", " "))


def parsed(html: str) -> Element:
    """The root above all elements of a page."""
    scanner = _Scanner()
    scanner.feed(html)
    scanner.close()
    return scanner.root


def blocks_of(html: str) -> Iterator[dict]:
    """Each block that has text of its own, outside blocks below it, in order."""
    root, place = parsed(html), 0
    for element in (root, *root.walk()):
        if (element is root or element.tag in BLOCKS) and (text := element.text(blocks=False)):
            yield {"place": place, "tag": element.tag, "depth": element.depth, "classes": " ".join(sorted(element.classes)), "text": text}
            place += 1


def links_of(html: str) -> Iterator[dict]:
    anchors = (e for e in parsed(html).walk() if e.tag == "a" and e.attributes.get("href"))
    for place, e in enumerate(anchors):
        yield {"place": place, "href": e.attributes["href"].strip(), "text": e.text()}


def fields_of(html: str) -> Iterator[dict]:
    """The page's first title and heading, its language, description and number of links."""
    elements, out = list(parsed(html).walk()), {"title": None, "heading": None, "lang": None, "description": None}
    for e in elements:
        if e.tag in ("title", "h1"):
            name = "title" if e.tag == "title" else "heading"
            out[name] = out[name] if out[name] is not None else e.text()
        elif e.tag == "html":
            out["lang"] = out["lang"] or e.attributes.get("lang") or None
        elif e.tag == "meta" and e.attributes.get("name", "").lower() == "description":
            out["description"] = out["description"] or e.attributes.get("content") or None
    links = sum(e.tag == "a" and bool(e.attributes.get("href")) for e in elements)
    yield out | {"links": links}


#: Where a listing keeps its entries, and how an entry names its dates and number.
CONTAINER, ENTRY, DOWNLOAD, SUFFIX = "investigation_reports", "block", "download", ".pdf"
ENTRY_DATE = re.compile(r"(Accident|Report) Date:\s*(\d{1,2})/(\d{1,2})/(\d{4})")
ENTRY_NUMBER = re.compile(r"Report Number:\s*(.+)")


def _first(elements: list[Element], tag: str, name: str) -> str:
    return next((e.text() for e in elements if e.tag == tag and name in e.classes), "")


def _title(elements: list[Element]) -> str:
    """The link directly in a description's first paragraph."""
    for e in elements:
        p = e.parent
        if e.tag == "a" and p.tag == "p" and p.parent.tag == "div" and "desc" in p.parent.classes and p.parent.children[0] is p:
            return e.text()
    return ""


def _within(element: Element, top: Element, name: str) -> bool:
    at = element.parent
    while at is not None and at is not top:
        if at.tag == "div" and name in at.classes:
            return True
        at = at.parent
    return False


def entries_of(html: str) -> Iterator[dict]:
    """Entries of a listing that link a document: file name, title, location, dates as ISO,
    number and link. What an entry lacks is empty; one without a document is left out."""
    for entry in parsed(html).walk():
        if entry.tag != "div" or ENTRY not in entry.classes or entry.parent.attributes.get("id") != CONTAINER:
            continue
        below = list(entry.walk())
        links = (e.attributes.get("href", "") for e in below if e.tag == "a" and _within(e, entry, DOWNLOAD))
        url = next((u for u in links if u.endswith(SUFFIX)), None)
        if url:
            dates: dict[str, str] = {}
            for kind, month, day, year in ENTRY_DATE.findall(_first(below, "p", "data")):
                dates.setdefault(kind, f"{year}-{month:0>2}-{day:0>2}")
            number = ENTRY_NUMBER.search(_first(below, "p", "report"))
            yield {
                "filename": url.rsplit("/", 1)[-1], "title": _title(below), "location": _first(below, "p", "location"), "accident_date": dates.get("Accident", ""),
                "report_date": dates.get("Report", ""), "report_number": number[1].strip() if number else "", "url": url,
            }


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, place, tag, depth, classes, text) of every block of every page."""
    return per_document(pages, id_col, {"place": "bigint", "tag": "string", "depth": "bigint", "classes": "string", "text": "string"}, blocks_of, html_col)


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, place, href, text) of every link."""
    return per_document(pages, id_col, {"place": "bigint", "href": "string", "text": "string"}, links_of, html_col)


def html_fields(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, heading, lang, description, links), one row a page."""
    return per_document(pages, id_col, {"title": "string", "heading": "string", "lang": "string", "description": "string", "links": "bigint"}, fields_of, html_col)


def listing_entries(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, filename, title, location, accident_date, report_date, report_number, url) of listings."""
    names = ("filename", "title", "location", "accident_date", "report_date", "report_number", "url")
    return per_document(pages, id_col, dict.fromkeys(names, "string"), entries_of, html_col)


@query()
def html_page_blocks(spark, sf_dir):
    return html_blocks(table(spark, sf_dir, "pages"))


@query(r"""SELECT page_id, u.i - 1 AS place, hrefs[u.i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages) AS t, unnest(range(1, len(hrefs) + 1)) AS u(i)""")
def html_page_links(spark, sf_dir):
    return html_links(table(spark, sf_dir, "pages")).select("page_id", "place", "href")


@query()
def html_page_fields(spark, sf_dir):
    return html_fields(table(spark, sf_dir, "pages"))
