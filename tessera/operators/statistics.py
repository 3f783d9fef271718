"""Paired tests of two runs, bootstrap intervals, recommendation rules and topics."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.cells import nearest_of_all
from tessera.operators.density import LEAST_CLUSTER, LEAST_SAMPLES, clusters
from tessera.operators.retrieval import BOTH, both_runs
from tessera.operators.spectral import DIMENSIONS, embedded
from tessera.plans.registry import query
from tessera.sources.tables import stored, table

#: Pairs that a paired test needs.
LEAST_PAIRS = 10


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, t_statistic) from moments; null below LEAST_PAIRS pairs or
    without variance."""
    d = F.col(a) - F.col(b)
    sums = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    t = F.when((F.col("n") >= LEAST_PAIRS) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return sums.select("n", F.round("mean", 6).alias("mean_difference"), F.round(t, 6).alias("t_statistic"))


def t_p_value(spark: SparkSession, t: float, n: int) -> float:
    """Two-sided p value of a paired t statistic."""
    dist = spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 1))
    return 2.0 * dist.cumulativeProbability(-abs(float(t)))


def signed_rank_p_value(spark: SparkSession, a: list[float], b: list[float]) -> float:
    """P value of the Wilcoxon signed-rank test of a bounded set of query scores."""
    gateway = spark.sparkContext._gateway
    x, y = (gateway.new_array(gateway.jvm.double, len(v)) for v in (a, b))
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i], y[i] = float(p), float(q)
    return spark.sparkContext._jvm.org.apache.commons.math3.stat.inference.WilcoxonSignedRankTest().wilcoxonSignedRankTest(x, y, False)


#: Draws of a bootstrap, and rows that a task weighs at once.
DRAWS, WEIGHED_ROWS = 1000, 256


def bootstrap_interval(df: DataFrame, value: str, draws: int = DRAWS, seed: int = 7, low: float = 0.025, high: float = 0.975, key: str | None = None, group: str | None = None) -> DataFrame:
    """Percentile interval of the mean, by ``group``: each row gets, in each of ``draws``
    resamples, a Poisson(1) weight, so rows need no index and no collecting. Weights follow
    from the row's ``key`` (by default all its columns) and the seed alone, whatever tasks the
    rows are in; rows of one key are drawn together. Tasks add up weighted sums in batches and send one array a group."""
    rows = df.select((F.col(group) if group else F.lit("all")).cast("string").alias("g"), F.col(value).cast("double").alias("x"), F.xxhash64(*([key] if key else df.columns), F.lit(seed)).alias("h"))
    rows = rows.where("g is not null and x is not null")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
        steps = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code, x, h = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for c, name in enumerate(coded.dictionary.to_pylist()):
                own = np.flatnonzero(code == c)
                total = sums.setdefault(name, np.zeros((2, draws)))
                for at in range(0, len(own), WEIGHED_ROWS):
                    some = own[at : at + WEIGHED_ROWS]
                    u = (h[some, None] + steps) * np.uint64(0xBF58476D1CE4E5B9)
                    u = (u ^ (u >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    weight = np.searchsorted(edges, (u >> np.uint64(11)).astype(np.float64) / (1 << 53), "right").astype(np.float64)
                    total[0] += x[some] @ weight
                    total[1] += weight.sum(0)
        if sums:
            yield pa.RecordBatch.from_pydict({"g": list(sums), "s": [v[0] for v in sums.values()], "w": [v[1] for v in sums.values()]})

    parts = rows.mapInArrow(run, "g string, s array<double>, w array<double>")
    cells = parts.select("g", F.posexplode(F.arrays_zip("s", "w")).alias("draw", "c")).groupBy("g", "draw").agg(F.sum("c.s").alias("s"), F.sum("c.w").alias("w"))
    drawn = cells.where("w > 0").select("g", (F.col("s") / F.col("w")).alias("mean")).groupBy(*([F.col("g").alias(group)] if group else []))
    return drawn.agg(F.percentile("mean", low).alias("low"), F.percentile("mean", high).alias("high"), F.avg("mean").alias("middle"))


@query(f"""SELECT n, round(m, 6) AS mean_difference, CASE WHEN n >= {LEAST_PAIRS} AND sd > 0 THEN round(m / (sd / sqrt(n)), 6) END AS t_statistic
    FROM (SELECT count(*) AS n, avg(ndcg_a - ndcg_b) AS m, stddev_samp(ndcg_a - ndcg_b) AS sd FROM {BOTH})""")
def stat_ttest(spark, sf_dir):
    return paired_t(both_runs(spark, sf_dir), "ndcg_a", "ndcg_b")


@query()
def stat_bootstrap(spark, sf_dir):
    """Interval of the mean order price by priority class; tests check what must hold."""
    return bootstrap_interval(table(spark, sf_dir, "orders"), "o_totalprice", key="o_orderkey", group="o_orderpriority")


@query(f"""SELECT CASE WHEN avg(mrr_a) - avg(mrr_b) > 0.02 THEN 'a' WHEN avg(mrr_b) - avg(mrr_a) > 0.02 THEN 'b' WHEN avg(ndcg_a) - avg(ndcg_b) > 0.05 THEN 'a'
    WHEN avg(ndcg_b) - avg(ndcg_a) > 0.05 THEN 'b' ELSE 'either' END AS recommended, round(avg(mrr_a), 6) AS mrr_a, round(avg(mrr_b), 6) AS mrr_b FROM {BOTH}""")
def ir_recommendation(spark, sf_dir):
    """Which run to use: by reciprocal rank if it differs clearly, else by gain."""
    means = both_runs(spark, sf_dir).agg(*[F.avg(c).alias(c) for c in ("mrr_a", "mrr_b", "ndcg_a", "ndcg_b")])
    m, g = F.col("mrr_a") - F.col("mrr_b"), F.col("ndcg_a") - F.col("ndcg_b")
    choice = F.when(m > 0.02, "a").when(-m > 0.02, "b").when(g > 0.05, "a").when(-g > 0.05, "b").otherwise("either")
    return means.select(choice.alias("recommended"), F.round("mrr_a", 6).alias("mrr_a"), F.round("mrr_b", 6).alias("mrr_b"))


def topics(docs: DataFrame, id_col: str, text_col: str, k: int = 8, features: int = 1 << 12, seed: int = 7) -> DataFrame:
    """(id, topic) by k-means over hashed term frequencies: an approximation of density
    clustering over learned vectors, which is not available here."""
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 1)
    rows = HashingTF(inputCol="words", outputCol="features", numFeatures=features).transform(docs.select(F.col(id_col), words.alias("words")))
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic", maxIter=10).fit(rows).transform(rows).select(id_col, "topic", "words")


def topic_words(assigned: DataFrame, top: int = 10, least: int = 2) -> DataFrame:
    """(topic, word, weight, rank): words by class-based tf-idf, those in ``least`` rows."""
    words = assigned.select("topic", F.explode("words").alias("word"))
    counts = words.groupBy("topic", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("word").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    per_topic = counts.groupBy("topic").agg(F.sum("n").alias("size"))
    mean = per_topic.agg(F.avg("size")).first()[0] or 0.0  # one number
    weighted = counts.join(totals, "word").join(per_topic, "topic")
    weight = F.col("n") / F.col("size") * F.log(1 + F.lit(mean) / F.col("total"))
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "word")
    return weighted.withColumn("weight", weight).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("topic", "word", "weight", "rank")


@query()
def topics_approx(spark, sf_dir):
    return topics(table(spark, sf_dir, "documents"), "doc_id", "text").drop("words")


WORDS = re.compile(r"[^\W\d_]{2,}")
#: Neighbours of the graph that topics are found in.
TOPIC_NEIGHBOURS = 15


def density_topics(vectors: DataFrame, key: str, embedding: str, least: int = LEAST_CLUSTER, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, topic, probability) of all vectors: their graph of nearest neighbours by cosine is laid
    out in a few dimensions, and clustered there by density. Vectors that can't be compared are
    outliers."""
    rows = stored(vectors.select(F.col(key).cast("bigint").alias(key), embedding).where(F.col(key).isNotNull()), "vectors")
    placed = embedded(stored(nearest_of_all(rows, key, embedding, TOPIC_NEIGHBOURS), "near"), dimensions)
    near = stored(nearest_of_all(placed, "node", "v", TOPIC_NEIGHBOURS, cosine=False), "near")
    return clusters(rows.select(key), near, key, LEAST_SAMPLES, least)


def text_vectors(docs: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """(key, v): words of a text hashed to signed places, each by the root of its count. Texts
    without words have no vector."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))

    def run(batches):
        for batch in batches:
            vectors = []
            for t in batch.column(1).to_pylist():
                counts = Counter(WORDS.findall((t or "").lower()))
                v = np.zeros(width)
                for word, n in counts.items():
                    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                    v[h % width] += (n if n < 2 else math.sqrt(n)) * (1 if h & (1 << 31) else -1)
                vectors.append(v.tolist() if counts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "v"])

    return rows.mapInArrow(run, "id bigint, v array<double>").withColumnRenamed("id", key)


@query()
def topics_density(spark, sf_dir):
    """Topics of all documents by their words, with outliers; tests compare with the plain way."""
    vectors = text_vectors(table(spark, sf_dir, "documents"), "doc_id", "text")
    return density_topics(vectors, "doc_id", "v")
