"""Rolling features over series too long for one task, such as sub-daily readings.

Row-count frames need a row's neighbours, not its whole series. Rows get an exact position, the series is cut into
chunks of equal row count, each chunk borrows the few neighbour rows its frames reach into, and windows run per
chunk. One series that holds most of the table then spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.windows import SeriesWindow
from freshet.session import durable

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
_BROADCAST_ROWS = 200_000


def number_rows(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """Add ``position``, the 1-based rank of a row in its series.

    ``order`` must be a total order. A range shuffle cuts at sampled keys, so a long series spans many
    partitions; the sorted layout is written down before it is numbered, because a recomputed range shuffle could cut
    elsewhere.
    """
    keys = [*series, *order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid_out = durable(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS).alias("_part")
    row = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    placed = laid_out.select(*df.columns, part, row.alias("_row"))
    runs = placed.groupBy(*series, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *series, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    # one row per series and partition it touches: sent whole only when it was counted and is small
    if runs.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS:
        starts = F.broadcast(starts)
    joined = placed.join(starts, [*series, "_part"])
    position = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return joined.select(*df.columns, position.alias("position"))


def chunked_windows(
    df: DataFrame,
    features: Callable[[SeriesWindow], list[Column]],
    series: list[str],
    order: list[str],
    back: int,
    ahead: int = 0,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """``df`` plus the window features, each of which reaches at most ``back`` rows back and ``ahead`` rows on."""
    chunk_rows = max(chunk_rows, back, ahead, 1)
    numbered = number_rows(df, series, order)
    offset = (F.col("position") - 1) % chunk_rows
    home = F.floor((F.col("position") - 1) / chunk_rows)
    targets = F.array(
        home,
        F.when(offset >= chunk_rows - back, home + 1),
        F.when((offset < ahead) & (home > 0), home - 1),
    )
    spread = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(targets))
    spread = spread.where(F.col("_chunk").isNotNull())
    w = SeriesWindow([*series, "_chunk"], ["position"], position="position")
    return (
        spread.select("*", *features(w))
        .where(F.col("_chunk") == F.col("_home"))
        .drop("_chunk", "_home")
    )
