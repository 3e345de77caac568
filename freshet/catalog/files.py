"""Queries that write files under the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from freshet.catalog.models import LINEAR3, scores_sql
from freshet.catalog.registry import query
from freshet.catalog.sqltext import select
from freshet.catalog.tables import DAILY, TRAIN_END, VAL_END, daily_log
from freshet.plans import daily as daily_plan
from freshet.plans.daily import DailyConfig
from freshet.plans.reports import SCORE_NAMES
from freshet.session import shared_folder
from freshet.sources import log_source
from freshet.sources.text_log import read_text_logs

STATION, FIRST, LAST = "LAKE", 1997, 1999


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/freshet-files-{uuid.uuid4().hex}"


@query(
    "text_log_years",
    select(DAILY, f"""SELECT layout, '{STATION}' AS station, CAST(year(date_day) AS INTEGER) AS year,
  CAST(month(date_day) AS INTEGER) AS month, CAST(day(date_day) AS INTEGER) AS day, elevation_ft AS pool, elevation_ft,
  storage_2400, releases_power, releases_total, evap_in, inflow_adj, rain_dam_in, rain_bsn_in
FROM daily, (VALUES ('flat'), ('by_year'), ('folders')) l(layout)
WHERE elevation_ft IS NOT NULL AND rain_bsn_in IS NOT NULL AND year(date_day) BETWEEN {FIRST} AND {LAST}"""),
)
def _(spark, sf_dir):
    """The log as monthly files in both layouts, of which a span of years is read, folders of years also by Spark's own
    reader; incomplete lines drop out."""
    date = F.col("date_day")
    parts = {"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date), "pool": F.col("elevation_ft")}
    log = daily_log(spark, sf_dir).withColumn("station", F.lit(STATION)).withColumns(parts)
    folder, found = _folder(spark), []
    for layout in ("flat", "by_year"):
        log_source.write_logs(log, f"{folder}/{layout}", layout)
        found.append(log_source.read_logs(spark, f"{folder}/{layout}", FIRST, LAST, files_per_partition=12))
    found.append(read_text_logs(spark, f"{folder}/by_year", FIRST, LAST))
    marked = [df.select(F.lit(name).alias("layout"), "*") for df, name in zip(found, ("flat", "by_year", "folders"), strict=True)]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])


_LARGE = ["y_pred_next30", "y_lo90", "y_hi90", "y_lo50", "y_hi50"]


def _written(spark, sf_dir, name: str):
    """A file of the linear daily analysis, written twice over and read back from its CSV."""
    config = DailyConfig(TRAIN_END, VAL_END, models=("linear",))
    result, folder = daily_plan.daily_forecast(daily_log(spark, sf_dir), config=config), _folder(spark)
    result.write(folder)
    result.write(folder)
    return result.read(spark, folder, name)


_SMALL = "SELECT * REPLACE (" + ", ".join(f"round({c} / 1e6, 5) AS {c}" for c in _LARGE) + ") FROM ivals"


@query("forecast_file", select(LINEAR3, _SMALL))
def _(spark, sf_dir):
    return _written(spark, sf_dir, "forecast").withColumns({c: F.round(F.col(c) / 1e6, 5) for c in _LARGE})


@query("issue_day_file", select(LINEAR3, _SMALL + " WHERE day(date_day) = 1"))
def _(spark, sf_dir):
    return _written(spark, sf_dir, "issue_days").withColumns({c: F.round(F.col(c) / 1e6, 5) for c in _LARGE})


_MILLIONS = ["mae", "rmse", "flood_threshold", "flood_mae", "flood_rmse", "event_threshold"]
_SHARES = ["r2", "nse", "event_recall", "event_precision"]


@query(
    "score_file",
    select(LINEAR3 + ", " + scores_sql("long", "series_id, split, name"), "SELECT series_id, split, name, n, " + ", ".join(
        [f"round({c} / 1e6, 5) AS {SCORE_NAMES[c]}" for c in _MILLIONS]
        + [f"round({c}, 6) AS {SCORE_NAMES[c]}" for c in _SHARES] + [f"{c} AS {SCORE_NAMES[c]}" for c in ("flood_n", "event_n")]
    ) + " FROM scores"),
)
def _(spark, sf_dir):
    out = _written(spark, sf_dir, "scores")
    scaled = {SCORE_NAMES[c]: F.round(F.col(SCORE_NAMES[c]) / 1e6, 5) for c in _MILLIONS}
    return out.withColumns(scaled | {SCORE_NAMES[c]: F.round(SCORE_NAMES[c], 6) for c in _SHARES})
