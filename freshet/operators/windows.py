"""Lag, lead and rolling features over one or many series.

All expressions of one ``SeriesWindow`` share partitioning and order, so a select with dozens of them costs one
shuffle and one sort. Frames count rows: calendar gaps do not widen or narrow them. ``calendar=True`` makes a
rolling frame count days instead.

A series holds one row per date, so a window partition is bounded by the calendar (36,525 rows per century).
Series finer than a day go through ``freshet.operators.long_series``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F


class SeriesWindow:
    def __init__(self, series: Iterable[str] = ("series_id",), order: Iterable[str] = ("date_day",), position=None):
        self.series = list(series)
        self.order = list(order)
        self._position = position

    @property
    def spec(self):
        return Window.partitionBy(*self.series).orderBy(*self.order)

    def position(self) -> Column:
        """1-based row number within the series."""
        return F.col(self._position) if self._position else F.row_number().over(self.spec)

    def rows(self, start: int, end: int):
        return self.spec.rowsBetween(start, end)

    def days(self, start: int, end: int):
        day_number = F.unix_date(F.col(self.order[0]))
        return Window.partitionBy(*self.series).orderBy(day_number).rangeBetween(start, end)

    def _frame(self, start: int, end: int, calendar: bool):
        return self.days(start, end) if calendar else self.rows(start, end)

    # single rows

    def lag(self, column: str, k: int = 1) -> Column:
        return F.lag(column, k).over(self.spec)

    def lead(self, column: str, k: int = 1) -> Column:
        return F.lead(column, k).over(self.spec)

    def lags(self, column: str, steps: Iterable[int], name: str | None = None) -> list[Column]:
        return [self.lag(column, k).alias(f"{name or column}_{k}") for k in steps]

    def lags_of(self, columns: Iterable[str], steps: Iterable[int]) -> list[Column]:
        steps = list(steps)
        return [lag for column in columns for lag in self.lags(column, steps)]

    def difference(self, column: str) -> Column:
        return F.col(column) - self.lag(column)

    # frames ending today

    def rolling_sum(self, column: str, n: int, calendar: bool = False) -> Column:
        return F.sum(column).over(self._frame(-(n - 1), 0, calendar))

    def rolling_mean(self, column: str, n: int, calendar: bool = False) -> Column:
        return F.avg(column).over(self._frame(-(n - 1), 0, calendar))

    def rolling_max(self, column: str, n: int, calendar: bool = False) -> Column:
        return F.max(column).over(self._frame(-(n - 1), 0, calendar))

    def strict_sum(self, column: str, n: int) -> Column:
        """Sum of the last n rows, null unless all n are present."""
        frame = self.rows(-(n - 1), 0)
        return F.when(F.count(column).over(frame) == n, F.sum(column).over(frame))

    # frames ending yesterday

    def prior_sum(self, column: str, n: int, calendar: bool = False) -> Column:
        return F.sum(column).over(self._frame(-n, -1, calendar))

    def prior_mean(self, column: str, n: int, calendar: bool = False) -> Column:
        return F.avg(column).over(self._frame(-n, -1, calendar))

    # targets

    def forward_sum(self, column: str, n: int = 30, warmup: bool = True) -> Column:
        """Sum of the next n rows, null unless all n are present.

        With ``warmup`` the first n - 1 rows of a series have no target either.
        """
        frame = self.rows(1, n)
        whole = F.count(column).over(frame) == n
        if warmup:
            whole = whole & (self.position() >= n)
        return F.when(whole, F.sum(column).over(frame))

    def shifted_sum(self, column: str, start: int = -28, end: int = 1) -> Column:
        """Sum over rows t+start .. t+end, null unless all are present and n rows have gone by."""
        frame = self.rows(start, end)
        n = end - start + 1
        whole = (F.count(column).over(frame) == n) & (self.position() >= n)
        return F.when(whole, F.sum(column).over(frame))

    # whole series, bounded by the calendar

    def over_series(self, aggregate: Column) -> Column:
        return aggregate.over(Window.partitionBy(*self.series))

    def sequence(self, column: str, n: int = 12, include_current: bool = False) -> Column:
        """The n values before this row as an array (up to and with this row on request), null when fewer."""
        frame = self.rows(-(n - 1), 0) if include_current else self.rows(-n, -1)
        values = F.collect_list(column).over(frame)
        return F.when(F.size(values) == n, values)


def training_sequences(df: DataFrame, column: str, n: int, w: SeriesWindow) -> DataFrame:
    """(n previous values, value) pairs in series order; rows with a null value are not part of the series."""
    whole = df.where(F.col(column).isNotNull())
    pairs = whole.select(*w.series, *w.order, w.sequence(column, n).alias("inputs"), F.col(column).alias("target"))
    return pairs.where(F.col("inputs").isNotNull())


def latest_rows(df: DataFrame, w: SeriesWindow, n: int = 1) -> DataFrame:
    """The last n rows of every series."""
    newest_first = Window.partitionBy(*w.series).orderBy(*[F.desc(c) for c in w.order])
    return df.withColumn("_newest", F.row_number().over(newest_first)).where(F.col("_newest") <= n).drop("_newest")


def append_future_rows(df: DataFrame, rows: int, position: str, series: list[str], keep: list[str]) -> DataFrame:
    """Add ``rows`` empty rows after the last position of every series, so lags run past the end.

    The last row of a series multiplies itself, which needs no second pass over the input.
    """
    last = F.max(position).over(Window.partitionBy(*series)) == F.col(position)
    steps = F.when(last, F.sequence(F.lit(0), F.lit(rows))).otherwise(F.array(F.lit(0)))
    spread = df.select(*series, position, *keep, steps.alias("_steps"))
    stepped = spread.select(*series, position, *keep, F.explode("_steps").alias("_step"))
    return stepped.select(
        *series,
        (F.col(position) + F.col("_step")).alias(position),
        *[F.when(F.col("_step") == 0, F.col(c)).alias(c) for c in keep],
    )
