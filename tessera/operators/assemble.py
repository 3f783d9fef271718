"""Pages to documents: order, skip, join, boundaries, and which pages a span touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contents_analysis, is_contents, is_contents_at, is_cover, normalized, page_quality, sentences, skip_reason
from tessera.plans.registry import query
from tessera.sources.tables import table

SEPARATOR = "\n\n"


def page_starts(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """``pages`` with (start, stop): each page's place in its document's text. The start of a
    later page comes before the separator that joins it to the one before."""
    w = Window.partitionBy(key).orderBy(page)
    size = F.length(text)
    before = F.coalesce(F.sum(size + len(SEPARATOR)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.greatest(F.lit(0), before - len(SEPARATOR))
    return pages.withColumns({"start": start, "stop": before + size})


def documents_of(pages: DataFrame, key: str, page: str, text: str, source: str, *more: str) -> DataFrame:
    """One row a document: joined text, boundaries (with the source and columns ``more`` of
    each page), counts by source and the main source."""
    placed = page_starts(pages, key, page, text)
    found = placed.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(page, "start", "stop", text, source, *more))).alias("pages"),
        F.count("*").alias("n_pages"),
        F.count_if(F.col(source) == "user").alias("n_user"),
    )
    main = F.when((F.col("n_user") > 0) & (F.col("n_user") < F.col("n_pages")), "mixed").when(F.col("n_user") > 0, "user").otherwise("other")
    return found.withColumns({"full_text": F.array_join(F.transform("pages", lambda p: p[text]), SEPARATOR), "primary_source": main})


def touched_pages(pages: Column, start: Column, stop: Column, page: str) -> Column:
    """Sorted numbers of the pages that overlap [start, stop)."""
    return F.array_sort(F.transform(F.filter(pages, lambda p: (p["stop"] > start) & (p["start"] < stop)), lambda p: p[page]))


def source_quality(pages: Column, ratio: str = "ratio", confidence: str = "confidence") -> dict[str, Column]:
    """Least ratio and mean confidence of an array of pages; nulls and zeros don't count, and
    without any value the result is null."""
    ratios, sure = (F.filter(F.transform(pages, lambda p: p[c]), lambda x: x.isNotNull() & (x != 0)) for c in (ratio, confidence))  # noqa: B023
    mean = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure)
    return {"min_alphabetic_ratio": F.array_min(ratios), "avg_confidence": F.when(F.size(sure) > 0, mean)}


BOUNDARIES = """SELECT conv_id, turn, text, role, greatest(0, before - 2) AS start, before + length(text) AS stop FROM (SELECT conv_id, turn, text, role,
    coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations)"""


@query(f"""SELECT conv_id, string_agg(turn || ':' || start || '-' || stop, ',' ORDER BY turn) AS boundaries, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest,
    count(*) AS n_pages, CASE WHEN count(*) FILTER (WHERE role = 'user') BETWEEN 1 AND count(*) - 1 THEN 'mixed' WHEN count(*) FILTER (WHERE role = 'user') > 0 THEN 'user' ELSE 'other' END AS primary_source
    FROM ({BOUNDARIES}) GROUP BY conv_id""")
def txt_assemble_boundaries(spark, sf_dir):
    docs = documents_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")
    show = F.transform("pages", lambda p: F.format_string("%d:%d-%d", p["turn"], p["start"], p["stop"]))
    return docs.select("conv_id", F.array_join(show, ",").alias("boundaries"), F.md5("full_text").alias("digest"), "n_pages", "primary_source")


@query(f"""SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS touched, min(turn) AS page_start, max(turn) AS page_end FROM ({BOUNDARIES}) WHERE stop > 500 AND start < 1500 GROUP BY conv_id""")
def rng_page_overlap(spark, sf_dir):
    docs = documents_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")
    found = docs.select("conv_id", touched_pages(F.col("pages"), F.lit(500), F.lit(1500), "turn").alias("p")).where(F.size("p") > 0)
    return found.select("conv_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("touched"), F.array_min("p").alias("page_start"), F.array_max("p").alias("page_end"))


@query(f"""SELECT conv_id, min(r) FILTER (WHERE r <> 0) AS min_alphabetic_ratio, round(avg(c) FILTER (WHERE c <> 0), 6) AS avg_confidence FROM (SELECT conv_id,
    CASE WHEN role = 'user' THEN turn / 8.0::DOUBLE END AS r, (stop - start) % 5 AS c FROM ({BOUNDARIES}) WHERE stop > 500 AND start < 1500) GROUP BY conv_id""")
def rng_source_quality(spark, sf_dir):
    """Quality of the pages that a span touches, by conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("ratio", F.when(F.col("role") == "user", F.col("turn") / 8.0))
    pages = page_starts(rows, "conv_id", "turn", "text").withColumn("confidence", (F.col("stop") - F.col("start")) % 5)
    found = pages.where("stop > 500 and start < 1500").groupBy("conv_id").agg(F.collect_list(F.struct("ratio", "confidence")).alias("p"))
    quality = source_quality(F.col("p"))
    return found.select("conv_id", quality["min_alphabetic_ratio"].alias("min_alphabetic_ratio"), F.round(quality["avg_confidence"], 6).alias("avg_confidence"))


@query(f"""SELECT conv_id, arg_min(turn, start) AS turn, arg_min(role, start) AS role FROM ({BOUNDARIES}) WHERE start <= 700 AND stop > 700 GROUP BY conv_id""")
def rng_point_in_interval(spark, sf_dir):
    """The first page that holds a position."""
    docs = documents_of(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "role")
    held = F.filter("pages", lambda p: (p["start"] <= 700) & (p["stop"] > 700))
    return docs.select("conv_id", F.get(held, F.lit(0)).alias("p")).where("p is not null").select("conv_id", "p.turn", "p.role")


@query(r"""WITH q AS (SELECT doc_id, length(text) AS char_count, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\pL]', '', 'g'))::DOUBLE / length(text) ELSE 0 END AS a,
    CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\x09-\x0d\x20-\x7e]', '', 'g'))::DOUBLE / length(text) ELSE 0 END AS g, len(regexp_extract_all(text, '[a-zA-Z]{3,}')) AS word_count FROM documents)
    SELECT doc_id, char_count, round_even(a, 4) AS alphabetic_ratio, round_even(g, 4) AS garbage_ratio, word_count, CASE WHEN char_count = 0 THEN 'empty_text' WHEN char_count < 50 THEN 'too_short'
    WHEN a < 0.5 THEN 'low_alpha_ratio' WHEN g > 0.15 THEN 'high_garbage_ratio' WHEN word_count < 10 THEN 'few_words' END AS reason,
    CASE WHEN char_count >= 50 AND a >= 0.5 AND g <= 0.15 AND word_count >= 10 THEN 'passed' ELSE 'failed' END AS status FROM q""")
def txt_quality_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", page_quality(F.col("text")).alias("q")).select("doc_id", "q.*")
    return rows.withColumns({"word_count": F.col("word_count").cast("bigint"), "char_count": F.col("char_count").cast("bigint"), "status": F.when(F.col("reason").isNull(), "passed").otherwise("failed")})


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_TOC = rf"""(length({_STRIPPED}) >= 50 AND (regexp_matches(text, '(?mi)^\s*(TABLE\s+OF\s+CONTENTS|CONTENTS|INDEX)\s*$') OR len(regexp_extract_all(text, '\.{{5,}}\s*\d+')) >= 5
    OR len(regexp_extract_all(text, '(?m)^[A-Z][A-Za-z\s]+\s+\d{{1,3}}\s*$')) >= 8
    OR len(regexp_extract_all(text, '\.{{5,}}\s*\d+')) + len(regexp_extract_all(text, '(?m)^[A-Z][A-Za-z\s]+\s+\d{{1,3}}\s*$')) >= 10))"""


@query(rf"""SELECT doc_id, {_TOC} AS is_toc, length({_STRIPPED}) < 200 AS is_cover, CASE WHEN length({_STRIPPED}) = 0 THEN 'empty_page' WHEN length({_STRIPPED}) < 200 THEN 'cover_page' WHEN {_TOC} THEN 'toc_page' END AS reason FROM documents""")
def txt_toc_cover_skip(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", is_contents(c).alias("is_toc"), is_cover(c).alias("is_cover"), skip_reason(c).alias("reason"))


@query(r"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(\w)-\n(\w)', '\1\2', 'g'), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^\s*-\s*\d+\s*-\s*$', '', 'g'), '|', 'I'), '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def txt_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


_BREAKS = r"""regexp_replace({}, '([a-zA-Z][.!?]|\d\d[.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g')"""


@query(rf"""SELECT doc_id, unnest(range(len(l)))::INTEGER AS n, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split({_BREAKS.format(_BREAKS.format('text'))}, chr(1)),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS l FROM documents)""")
def txt_sentences(spark, sf_dir):
    """Sentences with their numbers. SQL has no lookbehind: it marks the breaks in two passes,
    as one match ends with the letter that the next may begin with."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))


_HEADER = r"regexp_matches(text, '(?mi)^\s*(TABLE\s+OF\s+CONTENTS|CONTENTS|INDEX)\s*$')"
_LEADERS = r"len(regexp_extract_all(text, '\.{5,}\s*\d+'))"
_REFERENCES = r"len(regexp_extract_all(text, '(?m)^[A-Z][A-Za-z\s]+\s+\d{1,3}\s*$'))"


@query(f"""WITH s AS (SELECT doc_id, length({_STRIPPED}) >= 50 AS enough, {_HEADER} AS h, {_LEADERS} AS d, {_REFERENCES} AS p FROM documents),
    c AS (SELECT doc_id, enough, enough AND h AS h, CASE WHEN enough THEN d ELSE 0 END AS d, CASE WHEN enough THEN p ELSE 0 END AS p FROM s),
    f AS (SELECT *, CASE WHEN enough THEN least(1.0::DOUBLE, CASE WHEN h THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN d >= 5 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE * d / 5 END
    + CASE WHEN p >= 8 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE * p / 8 END) ELSE 0 END AS confidence FROM c)
    SELECT doc_id, confidence >= 0.4 OR h AS is_toc, round(confidence, 6) AS confidence, h AS has_toc_header, d AS dotted_leader_count, p AS page_reference_count,
    CASE WHEN h OR d >= 5 OR p >= 8 THEN concat_ws(',', CASE WHEN h THEN 'header' END, CASE WHEN d >= 5 THEN d || ' dotted leaders' END, CASE WHEN p >= 8 THEN p || ' page references' END)
    WHEN enough THEN 'no signs' ELSE 'too short' END AS reasons FROM f""")
def txt_toc_analysis(spark, sf_dir):
    """Signs of a table of contents, their confidence, and the decision."""
    rows = table(spark, sf_dir, "documents").select("doc_id", contents_analysis(F.col("text")).alias("a")).select("doc_id", "a.*")
    return rows.withColumns({"confidence": F.round("confidence", 6), "reasons": F.array_join("reasons", ",")})


_PAGES = """SELECT doc_id // 8 AS report, doc_id % 8 AS page, CASE doc_id % 3 WHEN 0 THEN 'Table of Contents' || chr(10) WHEN 1 THEN repeat('Scope ........ 12' || chr(10), 5) ELSE '' END || text AS text FROM documents"""


@query(f"""SELECT report, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages, count(*) AS n FROM ({_PAGES})
    WHERE CASE WHEN page <= 3 THEN {_TOC} ELSE {_HEADER} END GROUP BY report""")
def txt_toc_by_position(spark, sf_dir):
    """Contents pages of each report of eight pages, told more strictly after the first pages.
    Every third page begins with a contents header, every third with dotted leaders alone."""
    d = F.col("doc_id")
    top = F.when(d % 3 == 0, "Table of Contents\n").when(d % 3 == 1, "Scope ........ 12\n" * 5).otherwise("")
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("report"), (d % 8).alias("page"), F.concat(top, "text").alias("text"))
    found = rows.where(is_contents_at(F.col("page"), F.col("text"))).groupBy("report").agg(F.sort_array(F.collect_list("page")).alias("pages"), F.count("*").alias("n"))
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))
