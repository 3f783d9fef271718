"""Sections, footnotes and overlapping chunks of documents.

Match positions and greedy packing need a text in order, so one function a document runs
inside Arrow batches; texts that come whole aren't shuffled. A document of many pages is read page by page
in order, and a task holds a section of it at a time. What needs no positions is in ``functions.text``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions.text import FOOTNOTE_REFERENCE, footnote_references, normalized, page_quality, skip_reason
from tessera.operators.assemble import SEPARATOR, source_quality
from tessera.plans.registry import query
from tessera.sources.tables import stored, table

#: Known section names; earlier ones are tried first.
SECTION_NAMES = (
    "SYNOPSIS", "INVESTIGATION", "HISTORY OF FLIGHT", "HISTORY OF THE FLIGHT", "INJURIES TO PERSONS", "DAMAGE TO AIRCRAFT", "OTHER DAMAGE",
    "CREW INFORMATION", "PILOT INFORMATION", "AIRCRAFT INFORMATION", "METEOROLOGICAL INFORMATION", "AIDS TO NAVIGATION", "COMMUNICATIONS",
    "AERODROME AND GROUND FACILITIES", "AIRPORT INFORMATION", "FLIGHT RECORDERS", "WRECKAGE", "WRECKAGE AND IMPACT INFORMATION", "FIRE",
    "SURVIVAL ASPECTS", "TESTS AND RESEARCH", "MEDICAL AND PATHOLOGICAL INFORMATION", "ORGANIZATIONAL AND MANAGEMENT INFORMATION",
    "MAINTENANCE RECORDS", "COMPANY INFORMATION", "ANALYSIS AND CONCLUSIONS", "ANALYSIS", "CONCLUSIONS", "FINDINGS", "PROBABLE CAUSE",
    "PROBABLE CAUSE AND FINDINGS", "RECOMMENDATIONS", "SAFETY RECOMMENDATIONS", "APPENDIX", "APPENDICES", "THE ACCIDENT", "FACTUAL INFORMATION",
    "ADDITIONAL INFORMATION", "USEFUL OR EFFECTIVE INVESTIGATION TECHNIQUES",
)
_NAMES = "|".join(map(re.escape, SECTION_NAMES))
#: A header line, with or without a number, and a lettered one.
HEADER = re.compile(rf"^\s*(?:(?P<number>\d+(?:\s*\.\s*\d+)*)\s*\.?\s*(?P<numbered>{_NAMES})|(?P<alone>{_NAMES}))\s*$", re.MULTILINE | re.IGNORECASE)
LETTERED = re.compile(r"^\s*\((?P<letter>[a-z])\)\s*(?P<name>Findings|Probable Cause|Recommendations|Analysis|Conclusions)\s*$", re.MULTILINE | re.IGNORECASE)
BLANK_LINES = re.compile(r"\n\s*\n")
#: A parent's header is merged if so little text follows it; the least mean and
#: single length of paragraphs.
MERGE_GAP, PARAGRAPH_MEAN, PARAGRAPH_LEAST = 50, 100, 50
#: Footnote definitions by number or symbol, and by word.
DEFINITION = re.compile(r"^\s*(\d+|[!*])/\s*(.+?)(?=\n\s*\d+/|\n\s*$|\Z)", re.MULTILINE | re.DOTALL)
WORD_DEFINITION = re.compile(r"^\s*([a-zA-Z]+\d*)/\s*(.+?)(?=\n\s*[a-zA-Z]+\d*/|\n\s*$|\Z)", re.MULTILINE | re.DOTALL)
_STOP, _REFERENCE = re.compile(r"[.!?]\s+(?=[A-Z])"), re.compile(FOOTNOTE_REFERENCE)
#: Tokens of a chunk at least, as aimed at, and at most; tokens of the overlap.
LEAST_TOKENS, AIM_TOKENS, MOST_TOKENS, OVERLAP_TOKENS = 400, 600, 800, 100


#: Counts the tokens of a text, such as ``lambda t: len(tokenizer.encode(t).ids)``.
Counter = Callable[[str], int]


def token_count(text: str) -> int:
    """A stand-in for a tokenizer: four characters a token, one at least."""
    return max(1, len(text) // 4)


@dataclass(frozen=True)
class Section:
    name: str
    number: str | None
    start: int
    end: int
    method: str


def is_child(parent: str | None, child: str | None) -> bool:
    """Whether a dotted number lies anywhere under another."""
    return bool(parent and child) and child.startswith(parent + ".")


def _headers(text: str) -> list[Section]:
    found = []
    for m in HEADER.finditer(text):
        number = re.sub(r"\s+", "", m["number"]) if m["number"] else None
        found.append(Section((m["numbered"] or m["alone"]).upper(), number, m.start(), len(text), "pattern_match"))
    for m in LETTERED.finditer(text):
        found.append(Section(f"({m['letter'].lower()}) {m['name'].upper()}", None, m.start(), len(text), "pattern_match"))
    return sorted(found, key=lambda s: s.start)


def _merged(headers: list[Section], text: str) -> list[Section]:
    """Parents that are directly followed by a child give it their name and vanish."""
    out: list[Section] = []
    for section in headers:
        if out and is_child(out[-1].number, section.number):
            line_end = text.find("\n", out[-1].start)
            between = text[line_end if line_end >= 0 else len(text) : section.start]
            if len(between.strip()) < MERGE_GAP:
                section = replace(section, name=f"{out[-1].name} > {section.name}")
                out.pop()
        out.append(section)
    return out


def _paragraphs(text: str) -> list[Section]:
    edges = [0, *[m.end() for m in BLANK_LINES.finditer(text)], len(text)]
    if len(text) < PARAGRAPH_MEAN * (len(edges) - 1):
        return []
    spans = enumerate(zip(edges[:-1], edges[1:], strict=True), 1)
    return [Section(f"PARAGRAPH_{i}", None, a, b, "paragraph_fallback") for i, (a, b) in spans if b - a >= PARAGRAPH_LEAST]


def sections_of(text: str) -> list[Section]:
    """Sections by headers, else paragraphs, else the document. Text before the first header
    belongs to none; a blank text has none."""
    if not text.strip():
        return []
    headers = _merged(_headers(text), text)
    if headers:
        ends = [s.start for s in headers[1:]] + [len(text)]
        return [replace(s, end=e) for s, e in zip(headers, ends, strict=True)]
    paragraphs = _paragraphs(text)
    return paragraphs if len(paragraphs) > 1 else [Section("DOCUMENT", None, 0, len(text), "no_structure")]


def footnotes_of(text: str) -> list[tuple[str, str]]:
    """Definitions: numbers and symbols as often as they occur, then words once each."""
    clean = lambda s: " ".join(s.split())
    found = [(m[1], clean(m[2])) for m in DEFINITION.finditer(text)]
    have = {m for m, _ in found}
    for m in WORD_DEFINITION.finditer(text):
        if m[1] not in have:
            have.add(m[1])
            found.append((m[1], clean(m[2])))
    return found


def references_in(text: str) -> list[str]:
    """Markers in order of appearance, each once."""
    return list(dict.fromkeys(m for m in _REFERENCE.findall(text) if m))


def with_footnotes(text: str, references: list[str], notes: dict[str, str]) -> str:
    """The text and, below it, the notes that it refers to, in order of reference."""
    lines = [f"[{m}/ {notes[m]}]" for m in dict.fromkeys(references) if m in notes]
    return text + "\n\n---\nFootnotes:\n" + "\n".join(lines) if lines else text


@dataclass
class Sentence:
    text: str
    start: int
    end: int
    tokens: int
    section: Section


def _pieces(text: str) -> Iterator[str]:
    begin = 0
    for m in _STOP.finditer(text):
        at = m.start()
        before = text[max(0, at - 2) : at]
        last = before[-1:]
        if (last.isascii() and last.isalpha()) or (len(before) == 2 and before.isdecimal()):
            yield text[begin : at + 1]
            begin = m.end()
    yield text[begin:]


def pieces_of(text: str) -> list[str]:
    """The text cut at SENTENCE_BREAK. Stops are searched first, as they are rare, and then what
    stands before them is looked at."""
    return list(_pieces(text))


#: Sentences of a section whose places are kept to be looked up.
KNOWN_SENTENCES = 20_000


def _sentences(section: Section, text: str, count: Counter) -> Iterator[Sentence]:
    """Sentences of a section by its text. A repeated one is placed at its first occurrence there."""
    known: dict[str, tuple[int, int]] = {}
    for piece in _pieces(text):
        if piece := piece.strip():
            if piece not in known:
                if len(known) >= KNOWN_SENTENCES:
                    known.clear()
                known[piece] = section.start + text.find(piece), count(piece)
            at, tokens = known[piece]
            yield Sentence(piece, at, at + len(piece), tokens, section)


def sentences_in(text: str, sections: list[Section], count: Counter = token_count) -> list[Sentence]:
    """Sentences of all sections. A repeated sentence is placed at its first occurrence."""
    return [x for s in sections for x in _sentences(s, text[s.start : s.end], count)]


def chunks_of(text: str, count: Counter = token_count, notes: dict[str, str] | None = None) -> Iterator[dict]:
    """Greedy chunks: whole sentences up to AIM_TOKENS once LEAST_TOKENS are there, never
    over MOST_TOKENS unless one sentence is. Each later chunk begins with the last sentences
    of the one before, up to OVERLAP_TOKENS, and all with their first section's name. Below
    stand the ``notes`` that a chunk refers to. ``count`` counts the tokens of a text."""
    sentences = (x for s in sections_of(text) for x in _sentences(s, text[s.start : s.end], count))
    return _chunks(sentences, count, notes or {})


def _chunks(sentences: Iterator[Sentence], count: Counter, notes: dict[str, str]) -> Iterator[dict]:
    """``chunks_of`` sentences in order, of which those of one chunk and the next are held."""
    overlap, overlap_tokens, sequence = "", 0, 0
    for own in _packed(sentences):
        names = list(dict.fromkeys(s.section.name for s in own))
        body = " ".join(filter(None, [f"[{names[0]}]", overlap, *[s.text for s in own]]))
        used = [m for m in references_in(body) if m in notes] if notes else []
        body = with_footnotes(body, used, notes)
        yield {
            "chunk_sequence": sequence, "section_name": names[0], "section_number": own[0].section.number, "method": own[0].section.method,
            "char_start": own[0].start, "char_end": own[-1].end, "n_sentences": len(own), "packed_tokens": sum(s.tokens for s in own),
            "token_count": count(body), "overlap_tokens": overlap_tokens, "spans_sections": len(names) > 1,
            "sections_spanned": ",".join(sorted(names)) if len(names) > 1 else None, "footnotes": ",".join(used), "chunk_text": body,
        }
        kept, overlap_tokens = len(own), 0
        while kept and overlap_tokens + own[kept - 1].tokens <= OVERLAP_TOKENS:
            kept -= 1
            overlap_tokens += own[kept].tokens
        overlap, sequence = " ".join(s.text for s in own[kept:]), sequence + 1


def _packed(sentences: Iterator[Sentence]) -> Iterator[list[Sentence]]:
    own, total = [], 0
    for s in sentences:
        more = total + s.tokens
        if own and (more > MOST_TOKENS or (total >= LEAST_TOKENS and more > AIM_TOKENS)):
            yield own
            own, more = [], s.tokens
        own.append(s)
        total = more
    if own:
        yield own


#: Rows of results that are sent together, and rows that are read at once.
SENT_ROWS, READ_ROWS = 5_000, 128


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, READ_ROWS) for at in range(0, batch.num_rows, READ_ROWS))


def per_document(docs: DataFrame, id_col: str, columns: dict[str, str], rows_of: Callable[..., Iterator[dict]], *inputs: str) -> DataFrame:
    """Rows of each document with its id, from the columns ``inputs``; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c) for c in inputs])
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{n} {k}" for n, k in columns.items()]])

    def run(batches):
        for batch in batches:
            # any other kind is that of the input of the same name
            kinds = pa.schema([("id", batch.schema.field(0).type), *((n, _KIND[k] if k in _KIND else batch.schema.field(n).type) for n, k in columns.items())])
            out: dict[str, list] = {n: [] for n in kinds.names}
            rows = (r for some in _slices(batch) for r in zip(*(c.to_pylist() for c in some.columns), strict=True))
            for i, text, *more in rows:
                for row in rows_of(text or "", *more):
                    out["id"].append(i)
                    for n in columns:
                        out[n].append(row[n])
                if len(out["id"]) >= SENT_ROWS:
                    yield pa.RecordBatch.from_pydict(out, schema=kinds)
                    out = {n: [] for n in kinds.names}
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_KIND = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
SECTION_COLUMNS = {"name": "string", "number": "string", "start": "bigint", "end": "bigint", "method": "string"}
CHUNK_COLUMNS = {
    "chunk_sequence": "bigint", "section_name": "string", "section_number": "string", "method": "string", "char_start": "bigint", "char_end": "bigint",
    "n_sentences": "bigint", "packed_tokens": "bigint", "token_count": "bigint", "overlap_tokens": "bigint", "spans_sections": "boolean",
    "sections_spanned": "string", "footnotes": "string", "chunk_text": "string",
}


def section_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return per_document(docs, id_col, SECTION_COLUMNS, lambda t: (vars(s) for s in sections_of(t)), text_col)


def footnote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows_of = lambda t: ({"marker": m, "note": n} for m, n in footnotes_of(t))
    return per_document(docs, id_col, {"marker": "string", "note": "string"}, rows_of, text_col)


def _touched(chunks: Iterator[dict], name: str, pages: list[dict]) -> Iterator[dict]:
    """``chunks`` with the ``pages`` (start, stop), in order, that each overlaps, as ``name``."""
    starts, stops = [p["start"] for p in pages], [p["stop"] for p in pages]
    for chunk in chunks:
        yield chunk | {name: pages[bisect_right(stops, chunk["char_start"]) : bisect_left(starts, chunk["char_end"])]}


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: Counter = token_count, notes_col: str | None = None, pages_col: str | None = None, *kept: str) -> DataFrame:
    """Chunks of all documents. ``count`` counts tokens, ``notes_col`` maps footnote markers to notes,
    ``pages_col`` has a document's pages in order, of which each chunk gets those that it overlaps.
    Each also gets the document's columns ``kept``."""
    inputs = [c for c in (notes_col, pages_col, *kept) if c]
    columns = CHUNK_COLUMNS | {c: docs.schema[c].dataType.simpleString() for c in (pages_col, *kept) if c}

    def rows_of(text, *more):
        given = dict(zip(inputs, more, strict=True))
        chunks, own = chunks_of(text, count, dict(given.get(notes_col) or [])), {c: given[c] for c in kept}
        return (c | own for c in (_touched(chunks, pages_col, given[pages_col] or []) if pages_col else chunks))

    out = per_document(docs, id_col, columns, rows_of, text_col, *inputs)
    return out.withColumn("chunk_id", F.format_string("%s_chunk_%04d", F.col(id_col).cast("string"), "chunk_sequence"))


def footnote_maps(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, notes): each document's notes by marker, the first definition by page."""
    found = per_document(pages.select(F.struct(key, page).alias("at"), text).select("at", text).withColumn("id", F.to_json("at")), "id", {"place": "bigint", "marker": "string", "note": "string"}, _placed_notes, text)
    at = F.from_json("id", f"struct<{key}: {pages.schema[key].dataType.simpleString()}, {page}: {pages.schema[page].dataType.simpleString()}>")
    first = found.select(at.alias("at"), "place", "marker", "note").groupBy(f"at.{key}", "marker").agg(F.min_by("note", F.struct(f"at.{page}", "place")).alias("note"))
    return first.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("marker", "note")))).alias("notes"))


def _placed_notes(text: str) -> Iterator[dict]:
    return ({"place": i, "marker": m, "note": n} for i, (m, n) in enumerate(footnotes_of(text)))


#: A line that a header may go on from: figures and stops, or a letter.
_OPEN = re.compile(r"[\s\d.]*|\s*\([a-z]\)\s*", re.IGNORECASE)
#: How the sections of a document are told.
HEADERS, PARAGRAPHS, WHOLE = "headers", "paragraphs", "whole"


#: A number at a page's end that a header may begin with.
_NUMBER_LAST = re.compile(r"^\s*\d+(?:\s*\.\s*\d+)*\s*\Z", re.MULTILINE)
#: What ``page_marks`` tells, in order.
MARKS = {"header": "boolean", "goes_on": "boolean", "number_last": "boolean", "runs": "bigint", "blank": "boolean", "before": "bigint", "after": "bigint"}


def page_marks(text: str) -> tuple[bool, bool, bool | None, int, bool, int, int]:
    """Of a page: whether it has a header, whether it has one if the page before ends with a number,
    and whether it ends with one (null if blank); runs of blank lines within it; whether it is
    blank; and line feeds before and after what stands on it."""
    inner = text.strip()
    left = len(text) - len(text.lstrip()) if inner else len(text)
    header = bool(HEADER.search(text) or LETTERED.search(text))
    goes_on = not header and inner.startswith(".") and bool(HEADER.search("0\n\n" + text))
    number = bool(_NUMBER_LAST.search(text[text.rfind("\n", 0, len(text.rstrip())) + 1 :])) if inner else None
    return header, goes_on, number, sum(1 for _ in BLANK_LINES.finditer(inner)), not inner, text.count("\n", 0, left), text.count("\n", left + len(inner))


def section_stream(pages: Iterator[str], mode: str) -> Iterator[tuple[Section, str]]:
    """``sections_of`` the joined pages, in order, each with its text. By headers and paragraphs a
    section and a page are held at a time."""
    if mode == HEADERS:
        yield from _header_stream(pages)
        return
    if mode == PARAGRAPHS:
        early: list[tuple[Section, str]] | None = []  # until there are two
        parts: list[str] = []
        for section, text in _paragraph_stream(pages, parts):
            if early is None:
                yield section, text
            else:
                early.append((section, text))
                if len(early) > 1:
                    yield from early
                    early = None
                    parts.clear()
        if early is None:
            return
        pages = iter(parts)
    text = SEPARATOR.join(pages)
    if text.strip():
        yield Section("DOCUMENT", None, 0, len(text), "no_structure"), text


def _paragraph_stream(pages: Iterator[str], parts: list[str]) -> Iterator[tuple[Section, str]]:
    """Paragraphs of PARAGRAPH_LEAST; pages are kept in ``parts`` till two are found."""
    base, left, n, found = 0, "", 0, 0
    pages = iter(pages)
    page = next(pages, None)
    while page is not None:
        if found < 2:
            parts.append(page)
        after = next(pages, None)
        left += page + ("" if after is None else SEPARATOR)
        # blank lines at the end may go on
        ends = [m.end() for m in BLANK_LINES.finditer(left) if after is None or m.start() < len(left.rstrip())]
        begin = 0
        for end in [*ends, len(left)] if after is None else ends:
            n += 1
            if end - begin >= PARAGRAPH_LEAST:
                found += 1
                yield Section(f"PARAGRAPH_{n}", None, base + begin, base + end, "paragraph_fallback"), left[begin:end]
            begin = end
        base, left, page = base + begin, left[begin:], after


def _header_stream(pages: Iterator[str]) -> Iterator[tuple[Section, str]]:
    """Sections by headers. Headers are looked for up to a page's end whose last line none can hold or
    go on from. A section waits for the one after the next, as a parent that vanishes leaves its text to it."""
    waiting: list[tuple[Section, str]] = []  # the one before the section at hand
    current, text, base, window = None, [], 0, ""  # the section at hand, its text, and what comes after it

    def taken(end: int) -> Iterator[tuple[Section, str]]:
        nonlocal current, text, base, window
        at = 0
        for h in _headers(window[:end]):
            text.append(window[at : h.start])
            at, h = h.start, replace(h, start=base + h.start)
            if current:
                whole = "".join(text)
                line_end = whole.find("\n")
                # as _merged
                if is_child(current.number, h.number) and len((whole[line_end:] if line_end >= 0 else "").strip()) < MERGE_GAP:
                    h = replace(h, name=f"{current.name} > {h.name}")
                    waiting[:] = [(replace(s, end=h.start), before + whole) for s, before in waiting]
                else:
                    yield from waiting
                    waiting[:] = [(replace(current, end=h.start), whole)]
            current, text = h, []
        if current:
            text.append(window[at:end])
        base, window = base + end, window[end:]

    pages = iter(pages)
    page = next(pages, None)
    while page is not None:
        after = next(pages, None)
        window += page + ("" if after is None else SEPARATOR)
        line = page[page.rfind("\n") + 1 :]
        if after is None or not (_OPEN.fullmatch(line) or HEADER.search(line) or LETTERED.search(line)):
            yield from taken(len(window) - (0 if after is None else 1))
        page = after
    yield from waiting
    if current:
        whole = "".join(text)
        yield replace(current, end=current.start + len(whole)), whole


#: Pages behind that are held, and tasks that documents are dealt to at least.
HELD_PAGES, LEAST_TASKS = 1_000, 256


def _paged_chunks(first: dict, rows: Iterator[dict], count: Counter) -> Iterator[dict]:
    """Chunks of a document from its first row (mode, source, notes) and its pages in order, each
    with the pages (page, start, stop, source, ratio, confidence) that it overlaps."""
    pages: list[dict] = []  # without their texts

    def texts() -> Iterator[str]:
        before = 0
        for i, row in enumerate(rows):
            stop = before + len(row["text"])
            pages.append({"page": row["page"], "start": before - len(SEPARATOR) if i else 0, "stop": stop, "source": row["source"], "ratio": row["ratio"], "confidence": row["confidence"]})
            before = stop + len(SEPARATOR)
            yield row["text"]

    latest = 0

    def sentences() -> Iterator[Sentence]:
        nonlocal latest
        for section, text in section_stream(texts(), first["mode"]):
            for x in _sentences(section, text, count):
                latest = section.start
                yield x

    for own in _chunks(sentences(), count, dict(first["notes"] or [])):
        near = pages[bisect_right(pages, own["char_start"], key=lambda p: p["stop"]) : bisect_left(pages, own["char_end"], key=lambda p: p["start"])]
        yield own | {"pages": near, "primary_source": first["source"]}
        # the sentence read last begins the next chunk, and lies in its section
        if (gone := bisect_right(pages, latest, key=lambda p: p["stop"])) > HELD_PAGES:
            del pages[:gone]


def page_chunks(pages: DataFrame, key: str, page: str, text: str, source: str, ratio: Column, confidence: Column, count: Counter = token_count) -> DataFrame:
    """From pages to chunks: pages that have text and are no cover or contents are joined to
    documents, whose chunks get their page range, their pages' sources and quality (least
    ``ratio`` and mean ``confidence``; nulls and zeros don't count), and the notes defined on
    any page. A document's pages are read in order and never put together; a task holds a
    section's text, a document's notes and a few numbers a page."""
    notes = footnote_maps(pages, key, page, text)
    kept = pages.where(skip_reason(F.col(text)).isNull()).select(
        F.col(key).alias("id"), F.col(page).alias("page"), normalized(F.col(text)).alias("text"), F.col(source).alias("source"), ratio.alias("ratio"), confidence.alias("confidence")
    )
    def marked(batches):
        for batch in (some for b in batches for some in _slices(b)):
            found = [page_marks(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], _KIND[kind]) for i, kind in enumerate(MARKS.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *MARKS])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    held = stored(kept.mapInArrow(marked, ", ".join([shape, *[f"{n} {k}" for n, k in MARKS.items()]])), "pages")
    ends = F.struct("blank", "before", "after")
    earlier = Window.partitionBy("id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    small = held.select("id", "page", "source", F.length("text").alias("size"), *MARKS).withColumn("number", F.last("number_last", ignorenulls=True).over(earlier))
    docs = small.groupBy("id").agg(
        F.bool_or(F.col("header") | (F.col("goes_on") & F.coalesce("number", F.lit(False)))).alias("header"), F.sum("runs").alias("runs"), F.count_if(~F.col("blank")).alias("filled"), (F.sum(F.col("size") + len(SEPARATOR)) - len(SEPARATOR)).alias("size"),
        F.min_by(ends, "page").alias("first"), F.max_by(ends, "page").alias("last"), F.count("*").alias("n"), F.count_if(F.col("source") == "user").alias("user"),
    )
    # runs of blank lines of the joined pages: within pages, between those with text, and at both ends
    edge = lambda end, c: F.when(F.col(f"{end}.blank") | (F.col(f"{end}.{c}") > 1), 1).otherwise(0)
    runs = F.col("runs") + F.col("filled") - 1 + edge("first", "before") + edge("last", "after")
    mode = F.when(F.col("header"), HEADERS).when(F.col("size") >= PARAGRAPH_MEAN * (runs + 1), PARAGRAPHS).otherwise(WHOLE)
    main = F.when((F.col("user") > 0) & (F.col("user") < F.col("n")), "mixed").when(F.col("user") > 0, "user").otherwise("other")
    heads = docs.where("filled > 0").join(notes.withColumnRenamed(key, "id"), "id", "left").select("id", F.lit(0).alias("turn"), mode.alias("mode"), main.alias("source"), "notes")
    rows = heads.unionByName(held.drop(*MARKS).withColumn("turn", F.lit(1)), allowMissingColumns=True)
    of_page = StructType([StructField("page", kept.schema["page"].dataType), StructField("start", LongType()), StructField("stop", LongType()), *(kept.schema[c] for c in ("source", "ratio", "confidence"))])
    columns = CHUNK_COLUMNS | {"pages": f"array<{of_page.simpleString()}>", "primary_source": "string"}

    def run(batches):
        out = None
        for batch in (first := iter(batches)):
            given = {f.name: f.type for f in batch.schema}
            of = pa.list_(pa.struct([("page", given["page"]), ("start", pa.int64()), ("stop", pa.int64()), *((c, given[c]) for c in ("source", "ratio", "confidence"))]))
            schema = pa.schema([("id", given["id"]), *((n, _KIND.get(k, of)) for n, k in columns.items())])
            for i, own in groupby((r for b in chain([batch], first) for some in _slices(b) for r in some.to_pylist()), key=lambda r: r["id"]):
                head = next(own)
                if head["turn"]:  # a document of blank pages
                    continue
                for chunk in _paged_chunks(head, own, count):
                    out = out or {n: [] for n in schema.names}
                    for n, v in (chunk | {"id": i}).items():
                        out[n].append(v)
                    if len(out["id"]) >= SENT_ROWS:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out = None
        if out:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    # a document is one task's, so few share one
    tasks = max(LEAST_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = rows.repartition(tasks, "id").sortWithinPartitions("id", "turn", "page")
    chunks = in_order.mapInArrow(run, ", ".join([f"id {kept.schema['id'].dataType.simpleString()}", *[f"{n} {k}" for n, k in columns.items()]]))
    joined = chunks.withColumn("chunk_id", F.format_string("%s_chunk_%04d", F.col("id").cast("string"), "chunk_sequence")).withColumnRenamed("id", key)
    sources = F.array_distinct(F.transform("pages", lambda p: p["source"]))
    numbers = F.transform("pages", lambda p: p["page"])
    return joined.select(
        key, "chunk_id", "chunk_sequence", "section_name", "section_number", "method", "char_start", "char_end", "token_count", "overlap_tokens",
        F.array_min(numbers).alias("page_start"), F.array_max(numbers).alias("page_end"), F.array_join(F.array_sort(numbers).cast("array<string>"), ",").alias("page_list"),
        F.when(F.size(sources) > 1, "mixed").otherwise(F.coalesce(F.get(sources, F.lit(0)), "primary_source")).alias("text_source"),
        *[q.alias(n) for n, q in source_quality(F.col("pages")).items()], "footnotes", "sections_spanned", "chunk_text",
    )


def section_statistics(sections: DataFrame, key: str) -> DataFrame:
    """How many sections a document has, numbered, lettered and others, and how they were found."""
    lettered = F.startswith(F.col("name"), F.lit("("))
    numbered, subsections = F.count_if(F.col("number").isNotNull()), F.count_if(lettered)
    return sections.groupBy(key).agg(
        F.count("*").alias("total_sections"), numbered.alias("numbered_sections"), subsections.alias("subsections"),
        (F.count("*") - numbered - subsections).alias("standalone_sections"), F.min_by("method", "start").alias("detection_method"),
    )


def section_at(sections: DataFrame, positions: DataFrame, key: str, position: str) -> DataFrame:
    """``positions`` with the name of the first section that holds each, or null. An open end
    holds all that follows."""
    lists = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", F.coalesce("end", F.lit((1 << 63) - 1)).alias("end"), "name"))).alias("sections"))
    found = F.filter("sections", lambda s: (s["start"] <= F.col(position)) & (F.col(position) < s["end"]))
    return positions.join(lists, key, "left").withColumn("section", F.get(found, F.lit(0))["name"]).drop("sections")


@query()
def txt_sections(spark, sf_dir):
    return section_table(table(spark, sf_dir, "documents"))


@query()
def txt_section_stats(spark, sf_dir):
    return section_statistics(section_table(table(spark, sf_dir, "documents")), "doc_id")


@query()
def txt_section_at(spark, sf_dir):
    """The section in the middle of each document."""
    docs = table(spark, sf_dir, "documents")
    middle = docs.select("doc_id", F.expr("length(coalesce(text, '')) div 2").alias("position"))
    return section_at(section_table(docs), middle, "doc_id", "position")


@query()
def txt_footnotes(spark, sf_dir):
    """How many footnote references and definitions each document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    defined = footnote_table(docs).groupBy("doc_id").agg(F.count("*").alias("n_definitions"))
    referred = docs.select("doc_id", F.size(footnote_references(F.col("text"))).cast("bigint").alias("n_references"))
    both = referred.join(defined, "doc_id", "left")
    return both.select("doc_id", "n_references", F.coalesce("n_definitions", F.lit(0).cast("bigint")).alias("n_definitions"))


@query()
def txt_chunks(spark, sf_dir):
    return chunk_table(table(spark, sf_dir, "documents"))


@query()
def txt_page_chunks(spark, sf_dir):
    """Pages to chunks; documents of one source and remainder are the pages of a document."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.concat_ws("-", "source", (F.col("doc_id") % 20).cast("string")).alias("report_id"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    return page_chunks(pages, "report_id", "page", "text", "lang", page_quality(F.col("text"))["alphabetic_ratio"], F.when(F.col("page") % 3 != 0, F.col("page") % 100))
