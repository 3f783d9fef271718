"""Exact percentiles of groups of any size.

Rows are counted by (group, value) and dealt by ranges of both, so one hot group lies in many
partitions. A running sum of counts within each partition, begun where the partitions before it
end, gives every value's places; the values at the two places around a percentile are picked by a
plain aggregate. No task holds a group.

Defined cases: nulls don't count, and a group of nulls alone has null percentiles; NaN counts as
the largest value; a null group is a group; ties share their places; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import stored


def exact_percentiles(df: DataFrame, groups: dict[str, Column | str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, a column for each of ``shares``): the value at that share of a group's rows, by
    linear interpolation between neighbours. Without ``groups``, one row for all."""
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in groups.items()], F.lit(0).alias("#"))
    counts = df.select(key.alias("key"), F.col(value).cast("double").alias("v")).groupBy("key", "v").agg(F.count("v").alias("n"))
    # the partition is kept as it was dealt, so the counts are written once
    counts = stored(counts.repartitionByRange("key", "v").withColumn("part", F.spark_partition_id()), "counts")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = counts.groupBy("key", "part").agg(F.sum("n").alias("held"))
    parts = parts.select("key", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("key")).alias("total"))
    within = Window.partitionBy("key", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("end", F.sum("n").over(within)).join(parts, ["key", "part"])
    end = F.col("end") + F.col("before")
    begin = end - F.col("n")

    def at(place: Column) -> Column:
        return F.max(F.when((begin <= place) & (place < end), F.col("v")))

    found = []
    for name, share in shares.items():
        place = (F.col("total") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        found.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return placed.groupBy("key").agg(*found).select(*[f"key.{n}" for n in groups], *shares)
