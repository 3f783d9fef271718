"""Comparison of two evaluated runs as the small tables of a dashboard, and report sinks.

All tables have one row a query, category or run at most. Sinks that format on the driver
refuse larger inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import html_escaped
from tessera.operators.evaluation import evaluated_sql, means, provided
from tessera.operators.retrieval import TIE
from tessera.operators.vectors import nearest
from tessera.plans.registry import query
from tessera.sources.tables import stored

MEASURES = ("mrr", "hit_10", "precision_10", "recall_10", "ndcg_10", "section_accuracy")
#: Differences of lift and of reciprocal rank that decide between two runs.
CLEAR_LIFT, CLEAR_MRR = 0.05, 0.02
#: Rows that the driver formats at most.
MOST_ROWS = 10_000


def winner(a: Column, b: Column, tie: float = TIE) -> Column:
    return F.when(b > a + tie, "b").when(a > b + tie, "a").otherwise("tie")


def query_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries of both runs side by side, with the difference in reciprocal rank."""
    one, two = (r.select("query", "category", "difficulty", *[F.col(m).cast("double").alias(f"{m}_{n}") for m in MEASURES]) for r, n in ((a, "a"), (b, "b")))
    both = one.join(two.drop("category", "difficulty"), "query")
    return both.withColumns({"mrr_diff": F.col("mrr_b") - F.col("mrr_a"), "winner": winner(F.col("mrr_a"), F.col("mrr_b"))})


def group_metrics(runs: dict[str, DataFrame], by: str) -> DataFrame:
    """Means of each run by ``by``; an empty ``by`` gives the means of the whole run."""
    parts = []
    for name, rows in runs.items():
        found = means(rows, by) if by else means(rows)
        found = found.where(f"no_{by} = 0").drop(f"no_{by}") if by else found
        parts.append(found.select(F.lit(name).alias("run"), "*"))
    return reduce(DataFrame.unionByName, parts)


def decision(a: DataFrame, b: DataFrame, lift_a: float | None = None, lift_b: float | None = None) -> DataFrame:
    """One row: which run to use. A clearly better lift of reviewed results decides for b, then
    a clearly better reciprocal rank for either; else a, the smaller model, stays."""
    mrr = [means(r).select(F.col("mrr").alias(f"mrr_{n}")) for r, n in ((a, "a"), (b, "b"))]
    both = mrr[0].crossJoin(mrr[1])  # one row each
    d = F.col("mrr_b") - F.col("mrr_a")
    lift = F.lit(None if lift_a is None or lift_b is None else lift_b - lift_a).cast("double")
    lifted, ranked = F.coalesce(lift > CLEAR_LIFT, F.lit(False)), F.coalesce(d > CLEAR_MRR, F.lit(False))
    choice = F.when(lifted, "b: higher lift").when(ranked, "b: better ranks").when(d < -CLEAR_MRR, "a: better ranks").otherwise("a: similar, smaller")
    return both.select("mrr_a", "mrr_b", F.round(d, 6).alias("mrr_difference"), lift.alias("lift_difference"), ranked.alias("rank_advantage"), lifted.alias("lift_advantage"), choice.alias("recommendation"))


def dashboard_tables(a: DataFrame, b: DataFrame, reviews: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a dashboard by name; ``reviews`` are reviewed results by run and query."""
    runs = {"a": a, "b": b}
    tables = {
        "query_comparison": query_comparison(a, b), "aggregate_metrics": group_metrics(runs, ""), "category_metrics": group_metrics(runs, "category"),
        "difficulty_metrics": group_metrics(runs, "difficulty"), "benchmark_decision": decision(a, b),
        "results": reduce(DataFrame.unionByName, [r.select(F.lit(n).alias("run"), "*") for n, r in runs.items()]),
    }
    return tables | ({"human_review_details": reviews} if reviews is not None else {})


def run_each(names: Iterable[str], run: Callable[[str], object]) -> dict[str, tuple[str, object]]:
    """``run`` for each name: (``ok``, result) or (``failed``, message); one that fails doesn't
    stop the others."""
    out: dict[str, tuple[str, object]] = {}
    for name in names:
        try:
            out[name] = "ok", run(name)
        except Exception as e:  # noqa: BLE001
            out[name] = "failed", str(e).splitlines()[0] if str(e) else type(e).__name__
    return out


def export_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, tuple[str, object]]:
    """Each table as one Parquet file in its own folder."""

    def write(name: str) -> str:
        path = f"{folder.rstrip('/')}/{name}"
        tables[name].coalesce(1).write.mode("overwrite").parquet(path)
        return path

    return run_each(tables, write)


def _bounded(df: DataFrame, most: int) -> list:
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a report")
    return found


def markdown_table(df: DataFrame, most: int = MOST_ROWS) -> str:
    """A Markdown table; bars and line ends inside values don't break it."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in _bounded(df, most)]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def html_cards(df: DataFrame, title: str, most: int = MOST_ROWS) -> str:
    """A card for each row: its title, and all other columns as a list. Values are escaped, but
    braces are single again, as nothing is formatted after."""
    safe = lambda c: F.replace(F.replace(html_escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    rows = _bounded(df.select(*[safe(c).alias(c) for c in df.columns]), most)
    card = lambda r: f"<article><h2>{r[title]}</h2><ul>{''.join(f'<li>{c}: {r[c]}</li>' for c in df.columns if c != title)}</ul></article>"
    return "<!doctype html>\n<meta charset=\"utf-8\">\n" + "\n".join(map(card, rows)) + "\n"


def write_review_csv(df: DataFrame, path: str, *blank: str) -> None:
    """CSV with a header and empty columns for reviewers to fill in."""
    df.withColumns({c: F.lit("") for c in blank}).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_text(df_or_text: str, spark, path: str) -> None:
    """One text, written as a file of a folder on any file system."""
    spark.createDataFrame([(df_or_text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = stored(nearest(spark, sf_dir), "near")
    return provided(spark, sf_dir, False, found), provided(spark, sf_dir, True, found)


_SIDES = f"(SELECT a.*, b.mrr AS mrr_b, b.ndcg_10 AS ndcg_b FROM {evaluated_sql()} AS a JOIN {evaluated_sql('21 - n.rank')} AS b USING (query))"


@query(f"""SELECT query, category, round(mrr, 6) AS mrr_a, round(mrr_b, 6) AS mrr_b, round(ndcg_10, 6) AS ndcg_10_a, round(ndcg_b, 6) AS ndcg_10_b, round(mrr_b - mrr, 6) AS mrr_diff,
    CASE WHEN mrr_b > mrr + {TIE} THEN 'b' WHEN mrr > mrr_b + {TIE} THEN 'a' ELSE 'tie' END AS winner FROM {_SIDES}""")
def dash_query_comparison(spark, sf_dir):
    rows = query_comparison(*both(spark, sf_dir))
    return rows.select("query", "category", *[F.round(c, 6).alias(c) for c in ("mrr_a", "mrr_b", "ndcg_10_a", "ndcg_10_b", "mrr_diff")], "winner")


_APPLIES = "(n_expected > 0 AND mode <> 'sections') OR category IN ('comparative_queries', 'aircraft_queries', 'phase_queries')"


@query(f"""SELECT run, category, count(*) AS n, round(avg(mrr) FILTER (WHERE {_APPLIES}), 6) AS mrr, round(avg(hit_10::INTEGER) FILTER (WHERE {_APPLIES}), 6) AS hit_10,
    round(avg(section_accuracy) FILTER (WHERE mode = 'sections'), 6) AS section_accuracy
    FROM (SELECT 'a' AS run, * FROM {evaluated_sql()} UNION ALL SELECT 'b' AS run, * FROM {evaluated_sql('21 - n.rank')}) GROUP BY run, category""")
def dash_category_metrics(spark, sf_dir):
    a, b = both(spark, sf_dir)
    return group_metrics({"a": a, "b": b}, "category").select("run", "category", "n", "mrr", "hit_10", "section_accuracy")


@query(f"""SELECT mrr_a, mrr_b, round(mrr_b - mrr_a, 6) AS mrr_difference, coalesce(mrr_b - mrr_a > {CLEAR_MRR}, false) AS rank_advantage,
    CASE WHEN mrr_b - mrr_a > {CLEAR_MRR} THEN 'b: better ranks' WHEN mrr_b - mrr_a < -{CLEAR_MRR} THEN 'a: better ranks' ELSE 'a: similar, smaller' END AS recommendation
    FROM (SELECT round(avg(mrr) FILTER (WHERE {_APPLIES}), 6) AS mrr_a, round(avg(mrr_b) FILTER (WHERE {_APPLIES}), 6) AS mrr_b FROM {_SIDES})""")
def dash_decision(spark, sf_dir):
    return decision(*both(spark, sf_dir)).select("mrr_a", "mrr_b", "mrr_difference", "rank_advantage", "recommendation")
