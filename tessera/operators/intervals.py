"""Interval joins without lists: intervals meet in bins, so that one entity's rows are dealt over
tasks and nothing is gathered by entity.

An interval of length up to 2^l lies in at most two bins of that width: its own level. It is also
put into its bins (at most two again) of each higher level that occurs. Two intervals that overlap
meet on the level of the longer one: the join is an equality on entity, level and bin, followed by
the exact condition. A pair that shares two bins counts in the first alone.

Intervals are half open. A null stop is open-ended; a null entity or start, and an interval that ends
before it starts or is empty, meet nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.assemble import BOUNDARIES, page_starts
from tessera.plans.registry import query
from tessera.sources.tables import table

#: What an open end counts as.
OPEN = 1 << 61


def _level(start: Column, stop: Column) -> Column:
    """The least l with 2^l of at least the length."""
    zeros = F.length(F.regexp_extract(F.lpad(F.bin(stop - start - 1), 64, "0"), "^0*", 0))
    return (64 - zeros).cast("int")


def _binned(df: DataFrame, entity: Sequence[str], start: str, stop: str, levels: list[int], tag: str) -> DataFrame:
    """Rows as a struct ``tag`` with their entity's columns, place, level and bin."""
    first, end = F.col(start).cast("bigint"), F.coalesce(F.col(stop).cast("bigint"), F.lit(OPEN))
    rows = df.select(F.struct(*df.columns).alias(tag), *[F.col(e).alias(f"__e{i}") for i, e in enumerate(entity)], first.alias(f"{tag}_start"), end.alias(f"{tag}_stop"))
    a, b = F.col(f"{tag}_start"), F.col(f"{tag}_stop")
    rows = rows.where(b > a).withColumn(f"{tag}_own", _level(a, b))
    rows = rows.withColumn("__level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col(f"{tag}_own"))))
    at = lambda place: F.expr(f"{place} div shiftleft(1L, __level)")
    rows = rows.withColumn("__first", at(f"{tag}_start"))
    return rows.withColumn("__bin", F.explode(F.sequence("__first", at(f"({tag}_stop - 1)"))))


def levels_of(df: DataFrame, start: str, stop: str) -> list[int]:
    """Levels that occur: 62 at most."""
    first, end = F.col(start).cast("bigint"), F.coalesce(F.col(stop).cast("bigint"), F.lit(OPEN))
    return sorted(r[0] for r in df.where(end > first).select(_level(first, end)).distinct().collect())


def overlapping(left: DataFrame, right: DataFrame, entity: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """(left, right), structs of the rows: all pairs of one entity whose intervals overlap. Starts
    are not negative."""
    levels = sorted({*levels_of(left, *left_span), *levels_of(right, *right_span)}) or [0]
    x, y = _binned(left, entity, *left_span, levels, "left"), _binned(right, entity, *right_span, levels, "right")
    keys = [*[f"__e{i}" for i in range(len(entity))], "__level", "__bin"]
    both = x.withColumnRenamed("__first", "__x").join(y.withColumnRenamed("__first", "__y"), keys)
    meet = (F.col("left_start") < F.col("right_stop")) & (F.col("right_start") < F.col("left_stop"))
    once = (F.col("__level") == F.greatest("left_own", "right_own")) & (F.col("__bin") == F.greatest("__x", "__y"))
    return both.where(once & meet).select("left", "right")


SPAN, STEP = 400, 300
_SPANS = f"SELECT conv_id, n AS span, n * {STEP} AS start, n * {STEP} + {SPAN} AS stop FROM (SELECT conv_id, unnest(range(0, max(stop) // {STEP} + 1)) AS n FROM ({BOUNDARIES}) GROUP BY conv_id)"


def spans_and_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Overlapping spans of fixed size over each conversation, and its turns as pages."""
    pages = page_starts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "role", "start", "stop")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.expr(f"max(stop) div {STEP}"))
    spans = pages.groupBy("conv_id").agg(numbers.alias("n")).select("conv_id", F.explode("n").alias("span"))
    return spans.select("conv_id", "span", (F.col("span") * STEP).alias("start"), (F.col("span") * STEP + SPAN).alias("stop")), pages


@query(f"""SELECT s.conv_id, span, min(turn) AS page_start, max(turn) AS page_end, count(*) AS n_pages, sum(least(s.stop, p.stop) - greatest(s.start, p.start))::BIGINT AS shared
    FROM ({_SPANS}) AS s JOIN ({BOUNDARIES}) AS p ON s.conv_id = p.conv_id AND s.start < p.stop AND p.start < s.stop AND p.stop > p.start GROUP BY ALL""")
def rng_spans_pages(spark, sf_dir):
    """Pages that each span touches, by an interval join."""
    spans, pages = spans_and_pages(spark, sf_dir)
    both = overlapping(spans, pages, ["conv_id"], ("start", "stop"), ("start", "stop"))
    shared = F.least("left.stop", "right.stop") - F.greatest("left.start", "right.start")
    return both.groupBy("left.conv_id", "left.span").agg(F.min("right.turn").alias("page_start"), F.max("right.turn").alias("page_end"), F.count("*").alias("n_pages"), F.sum(shared).alias("shared"))


@query(f"""SELECT s.conv_id, span, min(struct_pack(start := p.start, turn := turn, role := role)).turn AS turn, min(struct_pack(start := p.start, turn := turn, role := role)).role AS role
    FROM ({_SPANS}) AS s JOIN (SELECT *, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN {OPEN} ELSE stop END AS till FROM ({BOUNDARIES})) AS p
    ON s.conv_id = p.conv_id AND p.start <= s.start AND s.start < p.till GROUP BY ALL""")
def rng_points_first_page(spark, sf_dir):
    """The first page that holds each span's start; the last page is open-ended."""
    spans, pages = spans_and_pages(spark, sf_dir)
    last = pages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    pages = pages.join(last, "conv_id").withColumn("stop", F.when(F.col("turn") != F.col("last"), F.col("stop"))).drop("last")
    points = spans.select("conv_id", "span", "start", (F.col("start") + 1).alias("stop"))
    both = overlapping(points, pages, ["conv_id"], ("start", "stop"), ("start", "stop"))
    first = F.min(F.struct("right.start", "right.turn", "right.role")).alias("p")
    return both.groupBy("left.conv_id", "left.span").agg(first).select("conv_id", "span", "p.turn", "p.role")
