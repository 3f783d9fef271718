"""Retrieval metrics of ranked results, per query and by group, and run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import NEIGHBOURS, nearest
from tessera.plans.registry import query
from tessera.sources.tables import stored, table

#: Ranks that count, and hits that are reported.
DEPTH, HITS = 10, (1, 3, 5, 10, 20)


def metrics(ranked: DataFrame, totals: DataFrame, key: str = "query") -> DataFrame:
    """Per query: reciprocal rank, precision@5 and @10, recall@10, nDCG@10 and hits.

    ``ranked`` has (query, item, rank, relevant), ``totals`` (query, n_relevant). Precision
    divides by k and counts repeats; recall and gain count an item's first place only.
    """
    first = Window.partitionBy(key, "item").orderBy("rank")
    rows = ranked.withColumn("first", F.row_number().over(first) == 1)
    hit, once = F.col("relevant"), F.col("relevant") & F.col("first")
    least = F.min(F.when(hit, F.col("rank")))
    sums = rows.groupBy(key).agg(
        F.coalesce(1.0 / least, F.lit(0.0)).alias("mrr"),
        *[(F.count_if(hit & (F.col("rank") <= k)) / float(k)).alias(f"precision_{k}") for k in (5, DEPTH)],
        F.count_if(once & (F.col("rank") <= DEPTH)).alias("found"),
        F.sum(F.when(once & (F.col("rank") <= DEPTH), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
        *[F.coalesce((least <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in HITS],
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_relevant", F.lit(DEPTH))).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    some = F.col("n_relevant") > 0
    return sums.join(totals, key).select(
        key, "mrr", "precision_5", f"precision_{DEPTH}", F.when(some, F.col("found") / F.col("n_relevant")).otherwise(0.0).alias("recall_10"),
        F.when(some, F.col("gain") / ideal).otherwise(0.0).alias("ndcg_10"), *[f"hit_{k}" for k in HITS],
    )


def judged(spark, sf_dir, reverse: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Metrics of the neighbour search, an item being relevant if it has the query's label.
    ``reverse`` ranks the same items the other way round; ``found`` is the search, if it is done."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("asked"))
    rank = (21 - F.col("rank")) if reverse else F.col("rank")
    found = nearest(spark, sf_dir) if found is None else found
    ranked = found.withColumn("rank", rank).join(labels, "vec_id").join(asked, "query")
    ranked = ranked.select("query", F.col("vec_id").alias("item"), "rank", (F.col("label") == F.col("asked")).alias("relevant"))
    sizes = labels.groupBy(F.col("label").alias("asked")).agg((F.count("*") - 1).alias("n_relevant"))
    return metrics(ranked, asked.join(sizes, "asked").select("query", "n_relevant"))


def judged_sql(rank: str = "n.rank") -> str:
    hits = ", ".join(f"coalesce((min(rank) FILTER (WHERE rel) <= {k})::INTEGER, 0) AS hit_{k}" for k in HITS)
    return f"""(WITH r AS (SELECT query, vec_id, {rank} AS rank, e.label = q.label AS rel, q.label FROM {NEIGHBOURS} AS n JOIN embeddings AS e USING (vec_id)
        JOIN (SELECT vec_id AS query, label FROM embeddings) AS q USING (query)), t AS (SELECT label, count(*) - 1 AS total FROM embeddings GROUP BY label),
        m AS (SELECT query, any_value(label) AS label, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0) AS mrr, count(*) FILTER (WHERE rel AND rank <= 5) / 5.0::DOUBLE AS precision_5,
        count(*) FILTER (WHERE rel AND rank <= 10) / 10.0::DOUBLE AS precision_10, count(*) FILTER (WHERE rel AND rank <= 10) AS found,
        coalesce(sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) FILTER (WHERE rel AND rank <= 10), 0) AS gain, {hits} FROM r GROUP BY query)
        SELECT query, mrr, precision_5, precision_10, found / total::DOUBLE AS recall_10,
        gain / list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) FOR i IN range(1, least(total, 10) + 1)]) AS ndcg_10, {', '.join(f'hit_{k}' for k in HITS)} FROM m JOIN t USING (label))"""


def _rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_REAL = ("mrr", "precision_5", "precision_10", "recall_10", "ndcg_10")
_ROUND = ", ".join(f"round({n}, 6) AS {n}" for n in _REAL)


@query(f"SELECT query, {_ROUND}, {', '.join(f'hit_{k}' for k in HITS)} FROM {judged_sql()}")
def ir_metrics_per_query(spark, sf_dir):
    return _rounded(judged(spark, sf_dir), _REAL)


@query(f"""SELECT CASE WHEN grouping(c) = 1 THEN 'overall' ELSE c END AS category, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(hit_10), 6) AS hit_10,
    round(quantile_cont(mrr, 0.95), 6) AS p95 FROM (SELECT *, CASE WHEN query % 100 = 0 THEN 'even' ELSE 'odd' END AS c FROM {judged_sql()}) GROUP BY GROUPING SETS ((c), ())""")
def ir_metrics_agg(spark, sf_dir):
    """Means by category and overall, in one pass."""
    rows = judged(spark, sf_dir).withColumn("c", F.when(F.col("query") % 100 == 0, "even").otherwise("odd"))
    return rows.rollup("c").agg(
        F.grouping("c").alias("g"), F.count("*").alias("n"), *[F.round(F.avg(x), 6).alias(x) for x in ("mrr", "ndcg_10", "hit_10")], F.round(F.percentile("mrr", 0.95), 6).alias("p95")
    ).select(F.when(F.col("g") == 1, "overall").otherwise(F.col("c")).alias("category"), "n", "mrr", "ndcg_10", "hit_10", "p95")


#: Differences no larger than this are ties.
TIE = 0.01


def both_runs(spark, sf_dir) -> DataFrame:
    found = stored(nearest(spark, sf_dir), "near")
    a, b = (judged(spark, sf_dir, r, found).select("query", F.col("mrr").alias(f"mrr_{n}"), F.col("ndcg_10").alias(f"ndcg_{n}")) for n, r in (("a", False), ("b", True)))
    return a.join(b, "query")


BOTH = f"(SELECT query, a.mrr AS mrr_a, b.mrr AS mrr_b, a.ndcg_10 AS ndcg_a, b.ndcg_10 AS ndcg_b FROM {judged_sql()} AS a JOIN {judged_sql('21 - n.rank')} AS b USING (query))"


@query(f"""SELECT query, round(mrr_a, 6) AS mrr_a, round(mrr_b, 6) AS mrr_b, round(mrr_a - mrr_b, 6) AS difference,
    CASE WHEN mrr_a - mrr_b > {TIE} THEN 'a' WHEN mrr_b - mrr_a > {TIE} THEN 'b' ELSE 'tie' END AS winner FROM {BOTH}""")
def ir_compare(spark, sf_dir):
    d = F.col("mrr_a") - F.col("mrr_b")
    winner = F.when(d > TIE, "a").when(-d > TIE, "b").otherwise("tie")
    return both_runs(spark, sf_dir).select("query", F.round("mrr_a", 6).alias("mrr_a"), F.round("mrr_b", 6).alias("mrr_b"), F.round(d, 6).alias("difference"), winner.alias("winner"))


@query(f"""SELECT count(*) FILTER (WHERE mrr_a - mrr_b > {TIE}) AS wins, count(*) FILTER (WHERE mrr_b - mrr_a > {TIE}) AS losses,
    count(*) FILTER (WHERE abs(mrr_a - mrr_b) <= {TIE}) AS ties, round(avg(mrr_a - mrr_b), 6) AS mean_difference FROM {BOTH}""")
def ir_win_loss(spark, sf_dir):
    d = F.col("mrr_a") - F.col("mrr_b")
    return both_runs(spark, sf_dir).agg(
        F.count_if(d > TIE).alias("wins"), F.count_if(-d > TIE).alias("losses"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.round(F.avg(d), 6).alias("mean_difference")
    )
