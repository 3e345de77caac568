"""Forecast tables for reports and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.operators.windows import SeriesWindow, latest_rows


def latest_years(df: DataFrame, n: int = 12) -> DataFrame:
    """The newest n years of every series."""
    return latest_rows(df, SeriesWindow(["series_id"], ["year"]), n)


def prediction_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(column).alias("mean_predicted"), F.min(column).alias("min_predicted"), F.max(column).alias("max_predicted")
    )


def recent_months_with_forecast(monthly: DataFrame, value: str, summary: DataFrame, n: int = 12) -> DataFrame:
    """Last n known months followed by the forecast month with its mean, lowest and highest prediction."""
    recent = latest_rows(monthly.where(F.col(value).isNotNull()), SeriesWindow(["series_id"], ["date"]), n)
    last = monthly.where(F.col(value).isNotNull()).groupBy("series_id").agg(F.max("date").alias("_last"))
    forecast = last.join(summary, "series_id").select(
        "series_id",
        F.add_months("_last", 1).alias("date"),
        F.col("mean_predicted").alias("inflow"),
        F.col("min_predicted").alias("low"),
        F.col("max_predicted").alias("high"),
        F.lit("forecast").alias("kind"),
    )
    observed = recent.select("series_id", "date", F.col(value).alias("inflow"), F.lit("observed").alias("kind"))
    both = observed.unionByName(forecast, allowMissingColumns=True)
    return both.withColumn("label", F.date_format("date", "MMM"))


def sigma_intervals(fit: DataFrame) -> DataFrame:
    """Mean with one and two standard deviations on both sides."""
    at = lambda k: F.col("mean") + F.lit(float(k)) * F.col("sigma")
    return fit.select(
        "series_id",
        "month",
        "mean",
        at(-1).alias("low_1s"),
        at(1).alias("high_1s"),
        at(-2).alias("low_2s"),
        at(2).alias("high_2s"),
    )


def interval_offsets(fit: DataFrame, names: list[str]) -> DataFrame:
    """Distances from the fitted mean to the ends of its intervals, as error bars need them."""
    return fit.select(
        "series_id",
        "month",
        "mean",
        *[(F.col("mean") - F.col(f"lower{n}")).alias(f"down{n}") for n in names],
        *[(F.col(f"upper{n}") - F.col("mean")).alias(f"up{n}") for n in names],
    )
