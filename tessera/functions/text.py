"""Text functions of page processing, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the page quality tests, in the order of the tests.
MIN_CHARS, MIN_ALPHA, MAX_GARBAGE, MIN_WORDS = 50, 0.50, 0.15, 10
#: What makes a table of contents.
MIN_LEADERS, MIN_PAGE_REFERENCES, MIN_TOGETHER, MIN_CONTENTS_CHARS = 5, 8, 10, 50
CONTENTS_HEADER = r"(?dmi)^\s*(TABLE\s+OF\s+CONTENTS|CONTENTS|INDEX)\s*$"
DOTTED_LEADER = r"\.{5,}\s*\d+"
PAGE_REFERENCE = r"(?dm)^[A-Z][A-Za-z\s]+\s+\d{1,3}\s*$"
#: What makes a cover page.
COVER_PATTERNS = (
    r"(?i)NATIONAL\s+TRANSPORTATION\s+SAFETY\s+BOARD",
    r"(?i)AIRCRAFT\s+ACCIDENT\s+REPORT",
    r"(?i)ADOPTED\s+\w+\s+\d+,\s+\d{4}",
    r"(?i)REPORT\s+NUMBER",
)
COVER_CHARS, COVER_PATTERN_CHARS, LOW_DENSITY_CHARS = 200, 1000, 100
#: Fixed value: white space before a capital, after a letter or two to four digits with a stop.
SENTENCE_BREAK = r"(?<=[a-zA-Z][.!?])\s+(?=[A-Z])|(?<=\d\d[.!?])\s+(?=[A-Z])|(?<=\d\d\d[.!?])\s+(?=[A-Z])|(?<=\d\d\d\d[.!?])\s+(?=[A-Z])"
FOOTNOTE_REFERENCE = r"(?<!\w)([a-zA-Z]*\d*[!*]?)/(?!\w)"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def letters(c: Column) -> Column:
    """How many letters: what their runs take away, so that a run is one match."""
    return F.length(c) - F.length(F.regexp_replace(c, r"\p{L}++", ""))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def page_quality(c: Column) -> Column:
    """Struct of char_count, alphabetic_ratio, garbage_ratio, word_count, reason (null if the
    page passes). Ratios are rounded half to even, after the tests."""
    text = F.coalesce(c, F.lit(""))
    chars = F.length(text)
    alpha = share(letters(text), chars)
    garbage = share(F.length(F.regexp_replace(text, r"[\x09-\x0d\x20-\x7e]++", "")), chars)
    words = F.regexp_count(text, F.lit("[a-zA-Z]{3,}"))
    reason = F.when(chars == 0, "empty_text").when(chars < MIN_CHARS, "too_short").when(alpha < MIN_ALPHA, "low_alpha_ratio")
    reason = reason.when(garbage > MAX_GARBAGE, "high_garbage_ratio").when(words < MIN_WORDS, "few_words")
    return F.struct(
        chars.alias("char_count"),
        F.bround(alpha, 4).alias("alphabetic_ratio"),
        F.bround(garbage, 4).alias("garbage_ratio"),
        words.alias("word_count"),
        reason.alias("reason"),
    )


def normalized(c: Column) -> Column:
    """Hyphenated line breaks joined, blanks and blank lines squeezed, page number lines
    dropped, bars read as I, ends stripped."""
    steps = ((r"(\w)-\n(\w)", "$1$2"), (" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(?dm)^\s*-\s*\d+\s*-\s*$", ""))
    text = reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, F.coalesce(c, F.lit("")))
    return strip(F.replace(text, F.lit("|"), F.lit("I")))


def is_contents(c: Column) -> Column:
    leaders, references = F.regexp_count(c, F.lit(DOTTED_LEADER)), F.regexp_count(c, F.lit(PAGE_REFERENCE))
    marked = c.rlike(CONTENTS_HEADER) | (leaders >= MIN_LEADERS) | (references >= MIN_PAGE_REFERENCES) | (leaders + references >= MIN_TOGETHER)
    return F.coalesce((F.length(strip(c)) >= MIN_CONTENTS_CHARS) & marked, F.lit(False))


def contents_score(c: Column) -> Column:
    """Confidence that a page is a table of contents: 0.5 for a header, up to 0.3 for
    leaders and 0.2 for page references, at most 1."""
    leaders, references = F.regexp_count(c, F.lit(DOTTED_LEADER)), F.regexp_count(c, F.lit(PAGE_REFERENCE))
    header = F.when(c.rlike(CONTENTS_HEADER), 0.5).otherwise(0.0)
    dotted = F.when(leaders >= MIN_LEADERS, 0.3).otherwise(0.1 * leaders / MIN_LEADERS)
    numbered = F.when(references >= MIN_PAGE_REFERENCES, 0.2).otherwise(0.05 * references / MIN_PAGE_REFERENCES)
    return F.when(F.length(strip(c)) >= MIN_CONTENTS_CHARS, F.least(F.lit(1.0), header + dotted + numbered)).otherwise(0.0)


#: Fixed value: from this confidence on, a page is a table of contents.
CONTENTS_CONFIDENCE = 0.4
#: Fixed value: up to this page, contents are told by all signs; later ones need a header.
EARLY_PAGES = 3


def contents_analysis(c: Column) -> Column:
    """Struct of is_toc, confidence, has_toc_header, dotted_leader_count, page_reference_count
    and reasons; short pages have no signs."""
    text = F.coalesce(c, F.lit(""))
    enough = F.length(strip(text)) >= MIN_CONTENTS_CHARS
    leaders, references = (F.when(enough, F.regexp_count(text, F.lit(p))).otherwise(0) for p in (DOTTED_LEADER, PAGE_REFERENCE))
    header = enough & text.rlike(CONTENTS_HEADER)
    confidence = contents_score(text)
    reasons = F.filter(
        F.array(
            F.when(header, "header"),
            F.when(leaders >= MIN_LEADERS, F.format_string("%d dotted leaders", leaders)),
            F.when(references >= MIN_PAGE_REFERENCES, F.format_string("%d page references", references)),
        ),
        lambda r: r.isNotNull(),
    )
    none = F.array(F.when(enough, "no signs").otherwise("too short"))
    return F.struct(
        ((confidence >= CONTENTS_CONFIDENCE) | header).alias("is_toc"), confidence.alias("confidence"), header.alias("has_toc_header"),
        leaders.cast("bigint").alias("dotted_leader_count"), references.cast("bigint").alias("page_reference_count"), F.when(F.size(reasons) > 0, reasons).otherwise(none).alias("reasons"),
    )


def is_contents_at(page: Column, c: Column) -> Column:
    """Whether the text of a page, by its number, is a table of contents."""
    return F.when(page <= EARLY_PAGES, is_contents(c)).otherwise(F.coalesce(c.rlike(CONTENTS_HEADER), F.lit(False)))


def is_cover(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    marks = reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in COVER_PATTERNS))
    return (F.length(text) < COVER_CHARS) | ((marks >= 2) & (F.length(text) < COVER_PATTERN_CHARS))


def skip_reason(c: Column) -> Column:
    """Why a page is left out of its document; null if it stays."""
    text = F.coalesce(c, F.lit(""))
    out = F.when(F.length(strip(text)) == 0, "empty_page").when(is_cover(text), "cover_page").when(is_contents(text), "toc_page")
    return out.when(F.length(strip(text)) < LOW_DENSITY_CHARS, "low_text_density")


def sentences(c: Column) -> Column:
    """Array of non-empty sentences; numbers of one digit don't end one."""
    pieces = F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK, -1)
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) > 0)


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(chars / 4).cast("bigint"))


def section_number(c: Column) -> Column:
    """``1. 8`` and ``1 .8`` as ``1.8``."""
    return F.regexp_replace(c, r"\s+", "")


def is_subsection_of(child: Column, parent: Column) -> Column:
    return F.coalesce(F.startswith(section_number(child), F.concat(section_number(parent), F.lit("."))), F.lit(False))


def footnote_references(c: Column) -> Column:
    """Distinct markers in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FOOTNOTE_REFERENCE), F.lit(1))
    return F.array_distinct(F.filter(found, lambda m: m != ""))


def iso_date(c: Column) -> Column:
    """Month/day/year as ISO date text; anything else unchanged."""
    part = lambda i: F.lpad(F.regexp_extract(c, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i), 2, "0")
    year = F.regexp_extract(c, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3)
    return F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat_ws("-", year, part(1), part(2))).otherwise(c)


def preview(c: Column, size: int = 500) -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def html_escaped(c: Column) -> Column:
    """Markup characters escaped, braces doubled."""
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("{", "{{"), ("}", "}}"))
    return reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, c)


def signals_found(c: Column, signals: list[str], least: int = 2) -> Column:
    """Whether at least ``least`` of the signals occur, in any case."""
    low = F.lower(c)
    return reduce(lambda a, b: a + b, (F.coalesce(F.contains(low, F.lit(s.lower())), F.lit(False)).cast("int") for s in signals)) >= least
