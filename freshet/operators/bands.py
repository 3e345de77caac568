"""Prediction intervals from month-conditioned residual quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.functions.calendar import season
from freshet.operators.quantiles import quantile_name, quantile_table, winsorized
from freshet.session import durable

# Quantile levels of the 90 % and the 50 % band.
LEVELS = {"lo90": 0.05, "hi90": 0.95, "lo50": 0.25, "hi50": 0.75}

# Smallest samples of a month and of a season, the month size that needs no support from its
# season, and the share of residuals clipped at each end.
MIN_MONTH_ROWS = 10
MIN_SEASON_ROWS = 20
FULL_MONTH_ROWS = 30
CLIP_SHARE = 0.01


def residual_bands(df: DataFrame, residual: str, month: str = "month") -> DataFrame:
    """Band offsets per series and month, with the series-wide ones as month null.

    Residuals are clipped at their 1 % ends. A month of at least ten rows speaks with weight min(1, n / 30) and its
    season, when it has twenty, with the rest; weights are scaled to 1, and without either the series-wide quantiles
    stand. Quantiles are exact.
    """
    base = df.where(F.col(residual).isNotNull()).select(
        "series_id", F.col(month).alias("month"), season(F.col(month)).alias("season"), F.col(residual).alias("_r")
    )
    clipped = durable(winsorized(base, "_r", CLIP_SHARE, "_rw"))
    table = quantile_table(
        clipped,
        "_rw",
        list(LEVELS.values()),
        [["series_id", "season", "month"], ["series_id", "season"], ["series_id"]],
        ["series_id", "season", "month"],
    )
    names = {band: quantile_name(p) for band, p in LEVELS.items()}
    of_season, of_series = F.col("grouping") == 1, F.col("grouping") == 3
    same_season = Window.partitionBy("series_id", "season")
    same_series = Window.partitionBy("series_id")
    lifted = table.select(
        "series_id",
        "month",
        "grouping",
        "n",
        F.max(F.when(of_season, F.col("n"))).over(same_season).alias("_season_n"),
        *[F.col(q).alias(f"_m_{b}") for b, q in names.items()],
        *[F.max(F.when(of_season, F.col(q))).over(same_season).alias(f"_s_{b}") for b, q in names.items()],
        *[F.max(F.when(of_series, F.col(q))).over(same_series).alias(f"_g_{b}") for b, q in names.items()],
    ).where(F.col("grouping") != 1)
    w_month = F.when(F.col("n") >= MIN_MONTH_ROWS, F.least(F.lit(1.0), F.col("n") / FULL_MONTH_ROWS)).otherwise(0.0)
    w_season = F.when(F.col("_season_n") >= MIN_SEASON_ROWS, 1 - w_month).otherwise(0.0)

    def blended(b: str) -> Column:
        both = w_month * F.col(f"_m_{b}") + w_season * F.col(f"_s_{b}")
        mixed = F.when(w_month + w_season > 0, both / (w_month + w_season)).otherwise(F.col(f"_g_{b}"))
        return F.when(F.col("month").isNull(), F.col(f"_g_{b}")).otherwise(mixed).alias(b)

    return lifted.select("series_id", "month", F.when(F.col("month").isNotNull(), F.col("n")).alias("n"),
                         *[blended(b) for b in LEVELS])


def with_intervals(predictions: DataFrame, bands: DataFrame, yhat: str = "y_pred", month: str = "month") -> DataFrame:
    """Add y_lo90, y_hi90, y_lo50 and y_hi50; a month without its own band takes the series-wide one.

    The lookup is one row per series with a map of at most twelve months.
    """
    offsets = F.struct(*LEVELS)
    lookup = bands.groupBy("series_id").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", offsets)))
        ).alias("_by_month"),
        F.max(F.when(F.col("month").isNull(), offsets)).alias("_series_wide"),
    )
    joined = predictions.join(lookup, "series_id", "left")
    band = F.coalesce(F.try_element_at("_by_month", F.col(month)), F.col("_series_wide"))
    return joined.withColumn("_band", band).select(
        *predictions.columns, *[(F.col(yhat) + F.col("_band")[b]).alias(f"y_{b}") for b in LEVELS]
    )
