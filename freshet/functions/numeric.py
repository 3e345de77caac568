"""Casts, clips, labels and the log transform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def to_double(column: Column) -> Column:
    """Number from any input; text that is no number, and NaN, become null."""
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0.0, subset=columns)


def strict_total(*columns: Column) -> Column:
    """Sum across columns that is null as soon as one term is null."""
    return reduce(lambda a, b: a + b, columns)


def at_least(column: Column, threshold: float | Column) -> Column:
    """1.0 where the value reaches the threshold, 0.0 below, null for null."""
    return (column >= threshold).cast("double")


def floor_at_zero(column: Column) -> Column:
    # a null must stay null, greatest() would skip it
    return F.when(column < 0, F.lit(0.0)).otherwise(column)


def round_half_even(column: Column, digits: int = 2) -> Column:
    return F.bround(column, digits)


def log_target(column: Column) -> Column:
    return F.log1p(column)


def from_log_target(column: Column) -> Column:
    return F.expm1(column)


def sigma_band(value: Column, mean: Column, sigma: Column, strict: bool = False) -> Column:
    """Distance from the mean in sigmas as a label: within_1, within_2 or beyond_2."""
    z = F.abs(F.try_divide(value - mean, sigma))
    within = (lambda k: z < k) if strict else (lambda k: z <= k)
    return F.when(z.isNull(), F.lit(None)).when(within(1), "within_1").when(within(2), "within_2").otherwise("beyond_2")


def interval_band(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.between(low, high), "inside").when(value.isNotNull(), "outside")


def normal_density(x: Column, mean: Column, sigma: Column) -> Column:
    scale = sigma * F.sqrt(2 * F.pi())
    return F.try_divide(F.exp(-F.try_divide((x - mean) * (x - mean), 2 * sigma * sigma)), scale)


def grid_point(low: Column, high: Column, step: Column, points: int) -> Column:
    """Value number ``step`` (0-based) of ``points`` evenly spaced values from low to high."""
    return low + (high - low) * step / F.lit(float(points - 1))
