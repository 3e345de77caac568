"""Imputation and scaling, fitted on chosen rows of a series and applied to all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.operators.groups import with_facts


def _on_fit(column: str, fit: Column | None) -> Column:
    return F.col(column) if fit is None else F.when(fit, F.col(column))


def mean_imputed(
    df: DataFrame, columns: list[str], fit: Column | None = None, series: list[str] = ("series_id",)
) -> DataFrame:
    """Fill nulls with the series' mean over the fit rows."""
    means = with_facts(df, [F.avg(_on_fit(c, fit)).alias(f"_mean_{c}") for c in columns], list(series))
    return means.select(*[F.coalesce(c, f"_mean_{c}").alias(c) if c in columns else c for c in df.columns])


def min_max_scaled(
    df: DataFrame, column: str, name: str, fit: Column | None = None, series: list[str] = ("series_id",)
) -> DataFrame:
    """Scale to [0, 1] over the fit rows; keeps ``{name}_low`` and ``{name}_high`` for the way back."""
    on_fit = _on_fit(column, fit)
    ends = with_facts(df, [F.min(on_fit).alias(f"{name}_low"), F.max(on_fit).alias(f"{name}_high")], list(series))
    span = F.col(f"{name}_high") - F.col(f"{name}_low")
    # a constant column scales to 0
    return ends.withColumn(name, (F.col(column) - F.col(f"{name}_low")) / F.when(span == 0, 1.0).otherwise(span))


def min_max_restored(value: Column, low: Column, high: Column) -> Column:
    return low + value * (high - low)
