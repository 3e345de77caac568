"""Ranks in groups of any size: a range exchange on (group, value) and counted offsets.

A window per group ranks all its rows in one task. Here equal values are merged and counted first, a range exchange
cuts the sorted table wherever it is long, a group's values included, and what lies in earlier parts is added as a
counted offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from freshet.operators.groups import join_groups, with_facts
from freshet.operators.long_series import number_rows
from freshet.session import durable


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, x, c): how often each known value occurs; map-side partials merge a value that is repeated a lot."""
    x = F.col(value).cast("double")
    known = df.select(*by, F.when(x == 0, 0.0).otherwise(x).alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return known.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))


def cumulated(counts: DataFrame, by: list[str]) -> DataFrame:
    """``counts`` (by, x, c) with ``before``, the number of the group's rows below x, and ``part``, where it was ranked.

    The layout of the range exchange is written down before it is read twice, as another run could cut elsewhere.
    """
    laid_out = durable(counts.repartitionByRange(*by, "x").withColumn("part", F.spark_partition_id()))
    totals = laid_out.groupBy(*by, "part").agg(F.sum("c").alias("_own"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has one row here for each part that it touches
    offsets = totals.select(*by, "part", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = laid_out.withColumn("_inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    before = (F.col("_offset") + F.col("_inside")).alias("before")
    return join_groups(ranked, offsets, [*by, "part"]).select(*by, "x", "c", before, "part")


def tiles(df: DataFrame, tiles: int, order: list[str], by: list[str], name: str = "tile") -> DataFrame:
    """Add the 1-based tile of a row where its group, in a total order, is cut into runs as equal as possible.

    The first runs take the rows that are left over, as ``ntile`` has it.
    """
    numbered = number_rows(df, by, order)
    counted = with_facts(numbered, [F.count(F.lit(1)).alias("_n")], by)
    at, size, left = F.col("position") - 1, F.floor(F.col("_n") / tiles), F.col("_n") % tiles
    longer = left * (size + 1)
    tile = F.when(at < longer, F.floor(at / (size + 1))).otherwise(left + F.floor((at - longer) / F.greatest(size, F.lit(1))))
    return counted.select(*df.columns, (tile + 1).cast("int").alias(name))
