"""Grain changes: hours to days, days to months, months to climatology.

All are hash aggregations with map-side partials, so a hot series or day shrinks before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.calendar import floor_to_day, month_start, next_month_number

SERIES = ["series_id"]


def total(column: str) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def last_known(column: str, order: str) -> Column:
    """Value of the latest row that has one."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def with_month(df: DataFrame, date: str = "date_day") -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date)})


def monthly(
    df: DataFrame,
    sums: list[str] = (),
    means: list[str] = (),
    lasts: list[str] = (),
    series: list[str] = SERIES,
    date: str = "date_day",
) -> DataFrame:
    """One row per series and month with its first day as ``date``: sums (0 for none), means and last known values."""
    out = (
        with_month(df, date)
        .groupBy(*series, "year", "month")
        .agg(
            *[total(c).alias(c) for c in sums],
            *[F.avg(c).alias(c) for c in means],
            *[last_known(c, date).alias(c) for c in lasts],
        )
    )
    return out.withColumn("date", month_start(F.col("year"), F.col("month")))


def month_end_snapshot(df: DataFrame, columns: list[str], series: list[str] = SERIES, date="date_day") -> DataFrame:
    """Last known value of every column in every month."""
    return (
        with_month(df, date).groupBy(*series, "year", "month").agg(*[last_known(c, date).alias(c) for c in columns])
    )


def daily_mean(df: DataFrame, value: str, time: str = "time", series: list[str] = SERIES) -> DataFrame:
    return df.groupBy(*series, floor_to_day(F.col(time)).alias("date_day")).agg(F.avg(value).alias(value))


def monthly_mean_of_hours(df: DataFrame, value: str, time: str = "time", series: list[str] = SERIES) -> DataFrame:
    by_month = df.groupBy(*series, F.year(time).alias("year"), F.month(time).alias("month"))
    return by_month.agg(F.avg(value).alias(value))


def climatology(
    df: DataFrame, columns: list[str], series: list[str] = SERIES, fit: Column | None = None
) -> DataFrame:
    """Mean by calendar month over all years, or over the rows where ``fit`` holds."""
    pick = (lambda c: F.col(c)) if fit is None else (lambda c: F.when(fit, F.col(c)))
    return df.groupBy(*series, "month").agg(*[F.avg(pick(c)).alias(c) for c in columns])


def with_next_month_climatology(
    df: DataFrame,
    columns: list[str],
    series: list[str] = SERIES,
    fit: Column | None = None,
    suffix: str = "_next",
    source: DataFrame | None = None,
) -> DataFrame:
    """Add the climatological mean of the following calendar month.

    The lookup has twelve rows per series and is joined on the series, so it grows no faster than the table. It is
    computed from ``source`` where that is cheaper to read again than ``df``.
    """
    clim = climatology(df if source is None else source, columns, series, fit).withColumnsRenamed({c: c + suffix for c in columns})
    clim = clim.withColumnRenamed("month", "_next_month")
    return (
        df.withColumn("_next_month", next_month_number(F.col("month")))
        .join(clim, [*series, "_next_month"], "left")
        .drop("_next_month")
    )


def month_history(df: DataFrame, value: str, month: int, positive_only: bool = False) -> DataFrame:
    """Historical mean of one calendar month per series."""
    rows = df.where(F.col("month") == month)
    if positive_only:
        rows = rows.where(F.col(value) > 0)
    return rows.groupBy(*SERIES, "month").agg(F.avg(value).alias("historical_mean"))


def series_span(
    df: DataFrame, train_end: int, val_end: int, series: list[str] = SERIES, date: str = "date_day"
) -> DataFrame:
    """First and last date of a series with the two dates at which the split changes."""
    return df.groupBy(*series).agg(
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.make_date(F.lit(train_end + 1), F.lit(1), F.lit(1)).alias("val_from"),
        F.make_date(F.lit(val_end + 1), F.lit(1), F.lit(1)).alias("test_from"),
    )
