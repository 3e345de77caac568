"""CSV inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.calendar import date_from_parts, floor_to_day, month_number, parse_time
from freshet.functions.numeric import to_double
from freshet.sources import schemas
from freshet.sources.checks import require_columns


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column as text; casting is the caller's choice and never fails the read."""
    return spark.read.option("header", True).csv(path)


def daily_log(raw: DataFrame, series_id: str | None = "basin") -> DataFrame:
    """Typed daily rows from a combined log (file headers or our names).

    Every row gets ``series_id``, or its station when that is None.

    The month may be a number or a code; rows without a real date are dropped; measures that the file lacks are
    left out.
    """
    table = raw.withColumnsRenamed(schemas.LOG_RENAMES)
    require_columns(table, ["year", "month", "day", "inflow_adj", "rain_dam_in", "rain_bsn_in"], "daily log")
    measures = [c for c in schemas.MEASURES if c in table.columns]
    series = F.col("station") if series_id is None else F.lit(series_id)
    parts = table.select(
        series.alias("series_id"),
        F.col("year").try_cast("int").alias("year"),
        month_number(F.col("month")).alias("month"),
        F.col("day").try_cast("int").alias("day"),
        *[to_double(F.col(c)).alias(c) for c in measures],
    )
    dated = parts.withColumn("date_day", date_from_parts(F.col("year"), F.col("month"), F.col("day")))
    return dated.where(F.col("date_day").isNotNull()).select(
        "series_id", "date_day", "year", "month", "day", *measures
    )


def soil_hours(raw: DataFrame, series_id: str = "basin") -> DataFrame:
    """Hourly soil moisture as (series_id, time, soil)."""
    require_columns(raw, [schemas.SOIL_TIME, schemas.SOIL_VALUE], "soil moisture file")
    return raw.select(
        F.lit(series_id).alias("series_id"),
        parse_time(F.col(schemas.SOIL_TIME), strict=True).alias("time"),
        to_double(F.col(schemas.SOIL_VALUE)).alias("soil"),
    )


def subbasin_rows(raw: DataFrame, value_header: str, value: str, series_id: str = "basin") -> DataFrame:
    """Subbasin measurements as (series_id, date_day, area, value); rows lacking date or area are dropped."""
    require_columns(raw, [schemas.SUBBASIN_DATE, schemas.SUBBASIN_AREA, value_header], f"subbasin {value} file")
    return raw.select(
        F.lit(series_id).alias("series_id"),
        floor_to_day(parse_time(F.col(schemas.SUBBASIN_DATE))).alias("date_day"),
        to_double(F.col(schemas.SUBBASIN_AREA)).alias("area"),
        to_double(F.col(value_header)).alias(value),
    ).na.drop(subset=["date_day", "area"])


def literal_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)
