"""Evaluation of retrieval by category: by expected items, by signals in the text, or by section.

A category says how its queries are judged. Each mode gives the same columns, so the rows of
all modes stand in one table and one grouping gives means of the queries that a measure
applies to.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import BOTH, DEPTH, HITS, both_runs
from tessera.operators.statistics import LEAST_PAIRS
from tessera.operators.vectors import NEIGHBOURS, nearest
from tessera.plans.registry import query
from tessera.sources.tables import table

#: Categories by how they are judged; others have no ground truth.
BY_ITEMS = ("incident_lookup", "conceptual_queries")
BY_SECTIONS = ("section_queries",)
BY_SIGNALS = ("comparative_queries", "aircraft_queries", "phase_queries")
#: Fixed value: signals that a relevant text holds at least.
LEAST_SIGNALS = 2


def mode_of(category: Column, n_expected: Column, n_signals: Column) -> Column:
    """``items``, ``signals``, ``sections`` or ``none``; the signals only count where no items
    are expected."""
    either = F.when(n_expected > 0, "items").when(n_signals > 0, "signals").otherwise("none")
    out = F.when(category.isin(*BY_SECTIONS), "sections").when(category.isin(*BY_ITEMS), "items")
    return out.when(category.isin(*BY_SIGNALS), either).otherwise("none")


def has_signals(text: Column, signals: Column, least: int = LEAST_SIGNALS) -> Column:
    """Whether at least ``least`` of an array of signals are in the text, in any case."""
    found = F.filter(signals, lambda s: F.contains(F.lower(text), F.lower(s)))
    return F.coalesce(F.size(found) >= least, F.lit(False))


def section_matches(section: Column, expected: Column) -> Column:
    """Whether a section's name holds one of the expected ones or is part of one, in upper case;
    an empty or missing name matches none."""
    name = F.upper(section)
    return F.coalesce((F.length(name) > 0) & F.exists(expected, lambda e: F.contains(name, F.upper(e)) | F.contains(F.upper(e), name)), F.lit(False))


def evaluated(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: mode and measures.

    ``results`` has (query, rank, item, section, text), ``queries`` (query, category,
    difficulty, expected_items, expected_sections, signals), the last three arrays. Signals
    have no known number of relevant texts: their ideal gain is that of those found, and
    their recall is 0. Queries by sections only get their section accuracy.
    """
    asked = queries.withColumn("mode", mode_of(F.col("category"), F.size("expected_items"), F.size("signals")))
    rows = asked.join(results, "query", "left")
    relevant = F.when(F.col("mode") == "items", F.array_contains("expected_items", F.col("item"))).when(F.col("mode") == "signals", has_signals(F.col("text"), F.col("signals")))
    in_section = (F.col("mode") == "sections") & (F.col("rank") <= DEPTH) & section_matches(F.col("section"), F.col("expected_sections"))
    rows = rows.withColumns({"relevant": F.coalesce(relevant, F.lit(False)), "in_section": F.coalesce(in_section, F.lit(False))})
    # gain and recall count an item once; a text found by signals counts wherever it stands
    once = F.row_number().over(Window.partitionBy("query", "item").orderBy("rank")) == 1
    rows = rows.withColumn("counts", F.col("relevant") & ((F.col("mode") == "signals") | once))
    least = F.min(F.when(F.col("relevant"), F.col("rank")))
    near = F.col("counts") & (F.col("rank") <= DEPTH)
    sums = rows.groupBy("query", "category", "difficulty", "mode", F.size("expected_items").alias("n_expected")).agg(
        F.coalesce(1.0 / least, F.lit(0.0)).alias("mrr"),
        *[F.coalesce(least <= k, F.lit(False)).alias(f"hit_{k}") for k in HITS],
        (F.count_if(F.col("relevant") & (F.col("rank") <= DEPTH)) / float(DEPTH)).alias("precision_10"),
        F.count_if(near).alias("found"), F.count_if("relevant").alias("n_relevant"),
        F.sum(F.when(near, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
        (F.count_if("in_section") / float(DEPTH)).alias("section_accuracy"),
    )
    size = F.when(F.col("mode") == "items", F.col("n_expected")).otherwise(F.col("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(size, F.lit(DEPTH))).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return sums.select(
        "query", "category", "difficulty", "mode", "n_expected", "mrr", *[f"hit_{k}" for k in HITS], "precision_10",
        F.when((F.col("mode") == "items") & (F.col("n_expected") > 0), F.col("found") / F.col("n_expected")).otherwise(0.0).alias("recall_10"),
        F.when(size > 0, F.col("gain") / ideal).otherwise(0.0).alias("ndcg_10"), "section_accuracy",
    ).withColumn("hit_10", F.when(F.col("mode") == "sections", F.col("section_accuracy") > 0).otherwise(F.col("hit_10")))


def means(rows: DataFrame, *by: str) -> DataFrame:
    """Means over the queries that a measure applies to, by each of ``by`` and overall:
    ranks for queries with expected items or judged by signals, accuracy for those by sections."""
    ranked = (F.col("n_expected") > 0) & (F.col("mode") != "sections") | F.col("category").isin(*BY_SIGNALS)
    sectioned = F.col("mode") == "sections"
    sets = [[F.col(c)] for c in by] + [[]]
    return rows.groupingSets(sets, *by).agg(
        *[F.grouping(c).alias(f"no_{c}") for c in by], F.count("*").alias("n"), F.count_if(ranked).alias("n_ranked"),
        *[F.round(F.avg(F.when(ranked, F.col(m).cast("double"))), 6).alias(m) for m in ("mrr", "hit_10", "precision_10", "recall_10", "ndcg_10")],
        F.round(F.avg(F.when(sectioned, F.col("section_accuracy"))), 6).alias("section_accuracy"),
    )


_SIGNALS = ("the", "der", "el", "license")


def provided(spark, sf_dir, reverse: bool = False, found: DataFrame | None = None) -> DataFrame:
    """The provided vectors as a search: the document of a vector's id is its text, its source
    the section, its label the item; queries take turns in the categories. ``reverse`` ranks
    the same items the other way round, as a second run; ``found`` is the search, if it is done."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    found = (nearest(spark, sf_dir) if found is None else found).withColumn("rank", 21 - F.col("rank") if reverse else F.col("rank")).join(vectors, "vec_id").join(docs, "vec_id", "left")
    results = found.select("query", "rank", F.col("label").alias("item"), F.col("source").alias("section"), "text")
    turn = (F.col("vec_id") / 50).cast("bigint") % 4
    category = F.when(turn == 0, "incident_lookup").when(turn == 1, "section_queries").when(turn == 2, "phase_queries").otherwise("unknown")
    strings = lambda *x: F.array(*[F.lit(s) for s in x])
    none = F.array().cast("array<string>")
    queries = vectors.where("vec_id % 50 = 0").select(
        F.col("vec_id").alias("query"), category.alias("category"), F.when(F.col("vec_id") % 100 == 0, "easy").otherwise("hard").alias("difficulty"),
        F.when(turn == 0, F.array("label")).otherwise(F.array().cast("array<bigint>")).alias("expected_items"),
        F.when(turn == 1, strings("b", "WEB CRAWL")).otherwise(none).alias("expected_sections"), F.when(turn == 2, strings(*_SIGNALS)).otherwise(none).alias("signals"),
    )
    return evaluated(results, queries)


_FOUND = " + ".join(f"contains(lower(text), '{s}')::INTEGER" for s in _SIGNALS)
_MATCH = " OR ".join(f"contains(upper(source), upper('{e}')) OR contains(upper('{e}'), upper(source))" for e in ("b", "WEB CRAWL"))
_HIT_SQL = ", ".join(f"coalesce(min(rank) FILTER (WHERE relevant) <= {k}, false) AS hit_{k}" for k in HITS)

def evaluated_sql(rank: str = "n.rank") -> str:
    return f"""(WITH q AS (SELECT vec_id AS query, label AS asked, CASE (vec_id // 50) % 4 WHEN 0 THEN 'incident_lookup' WHEN 1 THEN 'section_queries' WHEN 2 THEN 'phase_queries' ELSE 'unknown' END AS category,
    CASE (vec_id // 50) % 4 WHEN 0 THEN 'items' WHEN 1 THEN 'sections' WHEN 2 THEN 'signals' ELSE 'none' END AS mode, CASE WHEN vec_id % 100 = 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM embeddings WHERE vec_id % 50 = 0),
    r AS (SELECT q.*, {rank} AS rank, e.label AS item, coalesce(CASE mode WHEN 'items' THEN e.label = asked WHEN 'signals' THEN {_FOUND} >= 2 END, false) AS relevant,
    coalesce(mode = 'sections' AND {rank} <= 10 AND length(source) > 0 AND ({_MATCH}), false) AS in_section FROM q LEFT JOIN {NEIGHBOURS} AS n USING (query) LEFT JOIN embeddings AS e ON e.vec_id = n.vec_id LEFT JOIN documents AS d ON d.doc_id = n.vec_id),
    o AS (SELECT *, relevant AND (mode = 'signals' OR row_number() OVER (PARTITION BY query, item ORDER BY rank) = 1) AS counts FROM r),
    s AS (SELECT query, category, difficulty, mode, CASE WHEN mode = 'items' THEN 1 ELSE 0 END AS n_expected, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE relevant), 0) AS mrr, {_HIT_SQL},
    count(*) FILTER (WHERE relevant AND rank <= 10) / 10.0::DOUBLE AS precision_10, count(*) FILTER (WHERE counts AND rank <= 10) AS found, count(*) FILTER (WHERE relevant) AS n_relevant,
    coalesce(sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) FILTER (WHERE counts AND rank <= 10), 0) AS gain, count(*) FILTER (WHERE in_section) / 10.0::DOUBLE AS section_accuracy FROM o GROUP BY ALL),
    z AS (SELECT *, CASE WHEN mode = 'items' THEN n_expected ELSE n_relevant END AS size FROM s)
    SELECT query, category, difficulty, mode, n_expected, mrr, hit_1, hit_3, hit_5, CASE WHEN mode = 'sections' THEN section_accuracy > 0 ELSE hit_10 END AS hit_10, hit_20, precision_10,
    CASE WHEN n_expected > 0 THEN found / n_expected::DOUBLE ELSE 0 END AS recall_10,
    CASE WHEN size > 0 THEN gain / list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) FOR i IN range(1, least(size, 10) + 1)]) ELSE 0 END AS ndcg_10, section_accuracy FROM z)"""


EVALUATED = evaluated_sql()


@query(f"""SELECT query, category, difficulty, mode, n_expected, round(mrr, 6) AS mrr, hit_1, hit_3, hit_5, hit_10, hit_20, round(precision_10, 6) AS precision_10, round(recall_10, 6) AS recall_10,
    round(ndcg_10, 6) AS ndcg_10, round(section_accuracy, 6) AS section_accuracy FROM {EVALUATED}""")
def ir_modes_per_query(spark, sf_dir):
    """Queries judged by expected items, by signals or by sections, as their category says."""
    real = ("mrr", "precision_10", "recall_10", "ndcg_10", "section_accuracy")
    return provided(spark, sf_dir).withColumns({c: F.round(c, 6) for c in real})


_RANKED = "(n_expected > 0 AND mode <> 'sections') OR category IN ('comparative_queries', 'aircraft_queries', 'phase_queries')"
_MEANS = ", ".join(f"round(avg({m}::DOUBLE) FILTER (WHERE {_RANKED}), 6) AS {m}" for m in ("mrr", "hit_10", "precision_10", "recall_10", "ndcg_10"))


@query(f"""SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'overall' END AS level, coalesce(category, difficulty, 'all') AS name,
    count(*) AS n, count(*) FILTER (WHERE {_RANKED}) AS n_ranked, {_MEANS}, round(avg(section_accuracy) FILTER (WHERE mode = 'sections'), 6) AS section_accuracy
    FROM {EVALUATED} GROUP BY GROUPING SETS ((category), (difficulty), ())""")
def ir_modes_means(spark, sf_dir):
    """Means by category, by difficulty and overall, each over the queries it applies to."""
    rows = means(provided(spark, sf_dir), "category", "difficulty")
    level = F.when(F.col("no_category") == 0, "category").when(F.col("no_difficulty") == 0, "difficulty").otherwise("overall")
    return rows.select(level.alias("level"), F.coalesce("category", "difficulty", F.lit("all")).alias("name"), *[c for c in rows.columns if c not in ("category", "difficulty", "no_category", "no_difficulty")])


def signed_ranks(pairs: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """(n, w_plus, w_minus, z, and ``ties`` if it is in ``more``) of the signed-rank test: pairs without difference are left out,
    ties share their mean rank. Differences are counted by size first, so that one row a
    distinct size is ranked. The score has the variance corrected for ties."""
    d = F.round(F.col(a) - F.col(b), 9)
    sizes = pairs.where(d != 0).groupBy(F.abs(d).alias("size")).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("plus"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("plus")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("n") - F.col("plus"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")), F.lit(0)).alias("ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0
    return sums.select("n", "w_plus", "w_minus", F.when(variance > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"), *more)


#: Pairs up to which the signed-rank test is exact.
MOST_EXACT = 50


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p value of the smaller rank sum of n differences without ties: the share of all
    sign patterns with a sum as small, counted rank by rank."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / d
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d or 1e-300)
            c = 1.0 + top / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, n: int) -> float:
    """Two-sided p value of a t statistic over n pairs."""
    a, x = (n - 1) / 2.0, (n - 1) / (n - 1 + t * t)
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5) + a * math.log(x) + 0.5 * math.log1p(-x))
    if x < (a + 1) / (a + 2.5):
        return front * _beta_fraction(a, 0.5, x) / a
    return 1.0 - front * _beta_fraction(0.5, a, 1 - x) / 0.5


def paired_tests(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, means, t statistic and signed ranks with their two-sided p values; null
    below LEAST_PAIRS pairs, or where a test has no variance. Ranks are judged exactly up to
    MOST_EXACT pairs without ties or pairs that are equal, else by the normal score."""
    d = F.col(a) - F.col(b)
    sums = pairs.agg(F.count(d).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("sd"))
    ranks = signed_ranks(pairs, a, b, "ties").select(F.least("w_plus", "w_minus").alias("w"), "z", "ties", F.col("n").alias("unlike"))
    both = sums.crossJoin(ranks)  # one row each
    enough = F.col("n") >= LEAST_PAIRS
    both = both.select("n", "mean_a", "mean_b", "difference", F.when(enough & (F.col("sd") > 0), F.col("difference") / (F.col("sd") / F.sqrt("n"))).alias("t"), F.when(enough, F.col("w")).alias("w"), F.when(enough, F.col("z")).alias("z"), "ties", "unlike")

    def run(batches):
        for batch in batches:
            n, t, z, w, ties, unlike = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "t", "z", "w", "ties", "unlike"))
            p_t = [None if x is None else t_two_sided(x, k) for x, k in zip(t, n, strict=True)]
            exact = [x is not None and u == k <= MOST_EXACT and not tied for x, u, k, tied in zip(z, unlike, n, ties, strict=True)]
            p_w = [signed_rank_exact(v, k) if e else None if x is None else math.erfc(abs(x) / math.sqrt(2)) for x, v, k, e in zip(z, w, n, exact, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p_t, pa.float64()), pa.array(p_w, pa.float64())], names=[*batch.schema.names, "t_p_value", "w_p_value"])

    return both.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema) + ", t_p_value double, w_p_value double").drop("ties", "unlike")


@query()
def stat_paired_tests(spark, sf_dir):
    """Both tests of two runs with p values, which SQL lacks; tests compare them with the JVM's."""
    found = paired_tests(both_runs(spark, sf_dir), "ndcg_a", "ndcg_b")
    return found.withColumns({"significant_t": F.col("t_p_value") < 0.05, "significant_w": F.col("w_p_value") < 0.05})


@query(f"""WITH s AS (SELECT abs(d) AS size, count(*) AS n, count(*) FILTER (WHERE d > 0) AS plus FROM (SELECT round(ndcg_a - ndcg_b, 9) AS d FROM {BOTH}) WHERE d <> 0 GROUP BY 1),
    r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS rank FROM s),
    t AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(rank * plus), 0) AS w_plus, coalesce(sum(rank * (n - plus)), 0) AS w_minus, coalesce(sum(n * n * n - n), 0)::DOUBLE AS ties FROM r)
    SELECT n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, CASE WHEN v > 0 THEN round((w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(v), 6) END AS z
    FROM (SELECT *, n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48.0 AS v FROM t)""")
def stat_signed_ranks(spark, sf_dir):
    return signed_ranks(both_runs(spark, sf_dir), "ndcg_a", "ndcg_b").withColumns({c: F.round(c, 6) for c in ("w_plus", "w_minus", "z")})
