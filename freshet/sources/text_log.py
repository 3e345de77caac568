"""Monthly fixed-layout text logs named ``{STATION}_{MON}_{YYYY}.txt``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.functions.calendar import MONTH_CODES, month_number
from freshet.functions.numeric import to_double
from freshet.sources.schemas import LOG_FIELDS, LOG_FOOT_LINES, LOG_HEAD_LINES, LOG_HEAD_LINES_FROM_2018

FILE_NAME = r"([A-Za-z0-9]+)_(" + "|".join(MONTH_CODES) + r")_(\d{4})\.txt$"


def read_text_logs(
    spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Every log file under ``path`` as typed daily rows, optionally for a span of years.

    One file is one month (about 50 lines), so a whole file per row is small; files spread over tasks. With both
    years given, files of other years are not even opened; where they lie in folders ``year=YYYY``, either year will do,
    as Spark prunes the folders.
    """
    reader = spark.read
    if first_year is not None and last_year is not None:
        years = ",".join(str(y) for y in range(first_year, last_year + 1))
        reader = reader.option("pathGlobFilter", f"*_{{{years}}}.txt")
    files = reader.text(path, wholetext=True)
    if "year" in files.columns:
        for year, keep in ((first_year, F.col("year") >= first_year), (last_year, F.col("year") <= last_year)):
            files = files if year is None else files.where(keep)
    return parse_text_logs(files.select(F.col("_metadata.file_name").alias("file_name"), "value"), first_year, last_year)


def parse_text_logs(files: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Rows (file_name, value) with a whole file as value -> one row per logged day.

    Head and foot lines are cut off by position, a line needs all ten fields, and station, month and year come
    from the file name. Files that are not logs are left out.
    """
    named = files.select(
        F.regexp_extract("file_name", FILE_NAME, 1).alias("station"),
        month_number(F.regexp_extract("file_name", FILE_NAME, 2)).alias("month"),
        F.regexp_extract("file_name", FILE_NAME, 3).try_cast("int").alias("year"),
        "value",
    ).where(F.col("year").isNotNull())
    if first_year is not None:
        named = named.where(F.col("year") >= first_year)
    if last_year is not None:
        named = named.where(F.col("year") <= last_year)
    lines = named.select("station", "year", "month", F.explode(_body_lines()).alias("line"))
    fields = lines.select(
        "station", "year", "month", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("f")
    ).where(F.size("f") >= len(LOG_FIELDS))
    return fields.select(
        "station",
        "year",
        "month",
        F.col("f")[0].try_cast("int").alias("day"),
        *[to_double(F.col("f")[i]).alias(name) for i, (_, name) in enumerate(LOG_FIELDS) if i > 0],
    ).na.drop()


def _body_lines() -> Column:
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n+$", "")
    lines = F.split(text, "\n")
    head = F.when(F.col("year") >= 2018, LOG_HEAD_LINES_FROM_2018).otherwise(LOG_HEAD_LINES)
    body = F.size(lines) - head - LOG_FOOT_LINES
    return F.slice(lines, head + 1, F.greatest(body, F.lit(0)))
