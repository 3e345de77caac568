"""Monthly text logs to one typed daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.numeric import zero_fill
from freshet.sources.schemas import MEASURES
from freshet.sources.results import write_result
from freshet.sources.tables import daily_log
from freshet.sources.text_log import read_text_logs


def combine_text_logs(
    spark: SparkSession, path: str, out: str, first_year: int | None = None, last_year: int | None = None
) -> None:
    """Read every log, set missing measures to 0 and write one table in folders by year, so later reads prune."""
    rows = zero_fill(read_text_logs(spark, path, first_year, last_year), MEASURES)
    # rebalance gathers a year's rows, yet splits a year that outgrows one task
    write_result(rows.hint("rebalance", "year"), out, partition_by=["year"])


def read_combined(spark: SparkSession, path: str, first_year: int | None = None, series_id: str | None = None) -> DataFrame:
    """The combined table as a daily log; the station is the series unless another name is given."""
    table = spark.read.parquet(path)
    if first_year is not None:
        table = table.where(F.col("year") >= first_year)
    return daily_log(table, series_id)
