"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.catalog.sqltext import over, rows, select
from freshet.catalog.tables import (
    DAILY, HEAVY, PRIORITY, SERIES, SOIL, cents, daily_log, priority_log, soil_hours, table,
)
from freshet.functions.calendar import DAYS_PER_YEAR, cycle_cos, cycle_sin
from freshet.functions.numeric import zero_if_null
from freshet.operators import aggregates, long_series
from freshet.operators.scaling import min_max_restored, min_max_scaled
from freshet.operators.windows import SeriesWindow, latest_rows, training_sequences
from freshet.plans.daily import daily_features
from freshet.plans.monthly import RAIN_FEATURES, daily_rain_features

W = SeriesWindow()
KEY = ["series_id", "date_day"]


def _filled(spark, sf_dir):
    log = daily_log(spark, sf_dir)
    return log.select(*KEY, *[zero_if_null(F.col(c)).alias(c) for c in ("rain_bsn_in", "rain_dam_in", "inflow_adj")])


FILLED = DAILY + """, filled AS (
  SELECT series_id, date_day, coalesce(rain_bsn_in, 0.0) AS rain_bsn_in, coalesce(rain_dam_in, 0.0) AS rain_dam_in,
         coalesce(inflow_adj, 0.0) AS inflow_adj FROM daily)"""


@query("daily_rollup", select(DAILY, "SELECT * FROM daily"))
def _(spark, sf_dir):
    return daily_log(spark, sf_dir)


SPANS = [3, 7, 14, 30, 45]


@query(
    "rolling_rain",
    select(FILLED, "SELECT series_id, date_day, " + ", ".join(
        f"sum(rain_bsn_in) {rows(1 - n, 0)} AS rain_{n}d, sum(rain_dam_in) {rows(1 - n, 0)} AS dam_{n}d" for n in SPANS
    ) + " FROM filled"),
)
def _(spark, sf_dir):
    return _filled(spark, sf_dir).select(
        *KEY,
        *[W.rolling_sum("rain_bsn_in", n).alias(f"rain_{n}d") for n in SPANS],
        *[W.rolling_sum("rain_dam_in", n).alias(f"dam_{n}d") for n in SPANS],
    )


@query(
    "rolling_prior_inflow",
    select(PRIORITY, "SELECT series_id, date_day, " + ", ".join(
        [f"lag(inflow_adj) {over()} AS qin_lag1"]
        + [f"round(avg(inflow_adj) {rows(-n, -1)}, 4) AS qin_mean_{n}d" for n in (3, 7, 14, 30)]
        + [f"sum(inflow_adj) {rows(-n, -1)} AS qin_sum_{n}d" for n in (3, 6, 12, 30)]
    ) + " FROM prio"),
)
def _(spark, sf_dir):
    return priority_log(spark, sf_dir).select(
        *KEY,
        W.lag("inflow_adj").alias("qin_lag1"),
        *[F.round(W.prior_mean("inflow_adj", n), 4).alias(f"qin_mean_{n}d") for n in (3, 7, 14, 30)],
        *[W.prior_sum("inflow_adj", n).alias(f"qin_sum_{n}d") for n in (3, 6, 12, 30)],
    )


def _target_sql(source: str, warm: bool, column: str = "inflow_adj") -> str:
    frame = rows(1, 30)
    gate = f" AND row_number() {over()} >= 30" if warm else ""
    return f"CASE WHEN count({column}) {frame} = 30{gate} THEN sum({column}) {frame} END"


@query(
    "next30_target",
    select(PRIORITY, f"""SELECT series_id, date_day, {_target_sql('prio', True)} AS inflow_next30,
       {_target_sql('prio', False)} AS inflow_next30_no_warmup,
       round(ln(1 + {_target_sql('prio', True)}), 9) AS inflow_next30_log FROM prio"""),
)
def _(spark, sf_dir):
    return priority_log(spark, sf_dir).select(
        *KEY,
        W.forward_sum("inflow_adj", 30).alias("inflow_next30"),
        W.forward_sum("inflow_adj", 30, warmup=False).alias("inflow_next30_no_warmup"),
        F.round(F.log1p(W.forward_sum("inflow_adj", 30)), 9).alias("inflow_next30_log"),
    )


@query(
    "shifted_target",
    select(PRIORITY, f"""SELECT series_id, date_day,
  CASE WHEN count(inflow_adj) {rows(-28, 1)} = 30 AND row_number() {over()} >= 30
       THEN sum(inflow_adj) {rows(-28, 1)} END AS shifted_30 FROM prio"""),
)
def _(spark, sf_dir):
    return priority_log(spark, sf_dir).select(*KEY, W.shifted_sum("inflow_adj", -28, 1).alias("shifted_30"))


@query(
    "rolling_calendar_days",
    select(PRIORITY, """SELECT series_id, date_day,
  sum(inflow_adj) OVER (PARTITION BY series_id ORDER BY date_day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)
    AS inflow_7_days,
  max(inflow_adj) OVER (PARTITION BY series_id ORDER BY date_day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
    AS highest_30_days FROM prio"""),
)
def _(spark, sf_dir):
    return priority_log(spark, sf_dir).select(
        *KEY,
        W.rolling_sum("inflow_adj", 7, calendar=True).alias("inflow_7_days"),
        W.rolling_max("inflow_adj", 30, calendar=True).alias("highest_30_days"),
    )


@query(
    "rolling_max_heavy",
    select(FILLED + f", flagged AS (SELECT *, CASE WHEN rain_bsn_in >= {HEAVY} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS heavy FROM filled)",
           "SELECT series_id, date_day, " + ", ".join(
               [f"sum(rain_bsn_in) {rows(1 - n, 0)} AS rain_{n}d" for n in (7, 14, 30)])
           + f", max(rain_bsn_in) {rows(-29, 0)} AS rain_max1d_30d, sum(heavy) {rows(-29, 0)} AS heavy_rain_days_30d FROM flagged"),
)
def _(spark, sf_dir):
    return daily_rain_features(daily_log(spark, sf_dir), HEAVY).select(*KEY, *RAIN_FEATURES)


SOIL_DAILY = SOIL + """, soil_daily AS (
  SELECT series_id, CAST(time AS DATE) AS date_day, avg(soil) AS soil FROM soil GROUP BY 1, 2)"""


@query(
    "rolling_mean_soil",
    select(SOIL_DAILY, "SELECT series_id, date_day, round(soil, 4) AS soil, " + ", ".join(
        f"round(avg(soil) {rows(1 - n, 0)}, 4) AS soil_{n}d_mean" for n in (7, 14, 30)) + " FROM soil_daily"),
)
def _(spark, sf_dir):
    daily = aggregates.daily_mean(soil_hours(spark, sf_dir), "soil")
    means = [F.round(W.rolling_mean("soil", n), 4).alias(f"soil_{n}d_mean") for n in (7, 14, 30)]
    return daily.select(*KEY, F.round("soil", 4).alias("soil"), *means)


@query(
    "lags_1_12",
    select(PRIORITY, "SELECT series_id, date_day, inflow_adj, " + ", ".join(
        f"lag(inflow_adj, {k}) {over()} AS inflow_{k}" for k in range(1, 13)) + " FROM prio"),
)
def _(spark, sf_dir):
    return priority_log(spark, sf_dir).select(*KEY, "inflow_adj", *W.lags("inflow_adj", range(1, 13), "inflow"))


@query(
    "diff_storage",
    select(DAILY, f"SELECT series_id, date_day, storage_2400 - lag(storage_2400) {over()} AS storage_change FROM daily"),
)
def _(spark, sf_dir):
    return daily_log(spark, sf_dir).select(*KEY, W.difference("storage_2400").alias("storage_change"))


@query(
    "strict_window_sum",
    select(DAILY, "SELECT series_id, date_day, " + ", ".join(
        f"CASE WHEN count(inflow_adj) {rows(1 - n, 0)} = {n} THEN sum(inflow_adj) {rows(1 - n, 0)} END AS inflow_sum_{n}"
        for n in (4, 5)) + " FROM daily"),
)
def _(spark, sf_dir):
    sums = [W.strict_sum("inflow_adj", n).alias(f"inflow_sum_{n}") for n in (4, 5)]
    return daily_log(spark, sf_dir).select(*KEY, *sums)


@query(
    "seasonal_encoding",
    select(PRIORITY, f"""SELECT DISTINCT date_day, CAST(year(date_day) AS INTEGER) AS year,
  CAST(month(date_day) AS INTEGER) AS month, CAST(day(date_day) AS INTEGER) AS day,
  CAST(dayofyear(date_day) AS INTEGER) AS doy,
  round(sin(2 * pi() * dayofyear(date_day) / {DAYS_PER_YEAR}), 9) + 0.0 AS doy_sin,
  round(cos(2 * pi() * dayofyear(date_day) / {DAYS_PER_YEAR}), 9) + 0.0 AS doy_cos,
  round(sin(2 * pi() * month(date_day) / 12.0), 9) + 0.0 AS mon_sin,
  round(cos(2 * pi() * month(date_day) / 12.0), 9) + 0.0 AS mon_cos FROM prio"""),
)
def _(spark, sf_dir):
    days = priority_log(spark, sf_dir).select("date_day").distinct()
    doy, month = F.dayofyear("date_day"), F.month("date_day")
    nine = lambda c, name: F.round(c, 9).alias(name)
    return days.select(
        "date_day", F.year("date_day").alias("year"), month.alias("month"), F.dayofmonth("date_day").alias("day"),
        doy.alias("doy"),
        nine(cycle_sin(doy, DAYS_PER_YEAR), "doy_sin"), nine(cycle_cos(doy, DAYS_PER_YEAR), "doy_cos"),
        nine(cycle_sin(month, 12), "mon_sin"), nine(cycle_cos(month, 12), "mon_cos"),
    )


FEATURES_SQL = FILLED + ", features AS (SELECT series_id, date_day, CAST(year(date_day) AS INTEGER) AS year, " \
    "CAST(month(date_day) AS INTEGER) AS month, inflow_adj AS inflow, rain_bsn_in AS rain_1d, rain_dam_in AS dam_1d, " \
    + ", ".join(f"sum(rain_bsn_in) {rows(1 - n, 0)} AS rain_{n}d, sum(rain_dam_in) {rows(1 - n, 0)} AS dam_{n}d" for n in SPANS) \
    + f", lag(inflow_adj) {over()} AS qin_lag1, " \
    + ", ".join(f"avg(inflow_adj) {rows(-n, -1)} AS qin_{n}d" for n in (3, 7, 14)) \
    + f", sum(inflow_adj) {rows(-30, -1)} AS qin_30d, avg(inflow_adj) {rows(-30, -1)} AS qin_30d_mean, sum(inflow_adj) {rows(-29, 0)} AS inflow_30d_sum, " \
    f"CAST(dayofyear(date_day) AS INTEGER) AS doy, sin(2 * pi() * dayofyear(date_day) / {DAYS_PER_YEAR}) AS doy_sin, " \
    f"cos(2 * pi() * dayofyear(date_day) / {DAYS_PER_YEAR}) AS doy_cos, " \
    f"{_target_sql('filled', True)} AS inflow_next30, ln(1 + {_target_sql('filled', True)}) AS inflow_next30_log FROM filled)"

_ROUNDED = {"qin_3d": 4, "qin_7d": 4, "qin_14d": 4, "qin_30d_mean": 4, "doy_sin": 9, "doy_cos": 9, "inflow_next30_log": 9}


@query(
    "daily_features",
    select(FEATURES_SQL, "SELECT * REPLACE (" + ", ".join(
        f"round({c}, {d}) + 0.0 AS {c}" for c, d in _ROUNDED.items()) + ") FROM features"),
)
def _(spark, sf_dir):
    return daily_features(daily_log(spark, sf_dir)).withColumns({c: F.round(c, d) for c, d in _ROUNDED.items()})


_MEANS = ["sm_7d_mean", "sm_14d_mean", "sm_30d_mean"]


@query(
    "daily_features_with_soil",
    select(FEATURES_SQL + ", " + SOIL_DAILY + """, joined AS (
  SELECT f.series_id, f.date_day, rain_1d, qin_30d_mean, inflow_next30, s.soil AS sm_1d
  FROM features f LEFT JOIN soil_daily s ON f.series_id = s.series_id AND f.date_day = s.date_day)""",
           "SELECT series_id, date_day, rain_1d, round(qin_30d_mean, 4) AS qin_30d_mean, inflow_next30, "
           "round(sm_1d, 4) AS sm_1d, " + ", ".join(
               f"round(avg(sm_1d) {rows(1 - n, 0)}, 4) AS sm_{n}d_mean" for n in (7, 14, 30)) + " FROM joined"),
)
def _(spark, sf_dir):
    features = daily_features(daily_log(spark, sf_dir), soil_hours(spark, sf_dir))
    kept = features.select(*KEY, "rain_1d", "qin_30d_mean", "inflow_next30", "sm_1d", *_MEANS)
    return kept.withColumns({c: F.round(c, 4) for c in ["qin_30d_mean", "sm_1d", *_MEANS]})


@query(
    "sequences_12",
    select(PRIORITY + f""", seq AS (
  SELECT series_id, date_day, inflow_adj AS target, list(inflow_adj) {rows(-12, -1)} AS inputs FROM prio)""",
           "SELECT series_id, date_day, target, " + ", ".join(f"inputs[{i}] AS x{i}" for i in range(1, 13))
           + " FROM seq WHERE len(inputs) = 12"),
)
def _(spark, sf_dir):
    pairs = training_sequences(priority_log(spark, sf_dir), "inflow_adj", 12, W)
    return pairs.select(*KEY, "target", *[F.col("inputs")[i].alias(f"x{i + 1}") for i in range(12)])


@query(
    "last_sequence",
    select(PRIORITY + f""", seq AS (
  SELECT series_id, date_day, list(inflow_adj) {rows(-11, 0)} AS inputs,
         row_number() OVER (PARTITION BY series_id ORDER BY date_day DESC) AS rn FROM prio)""",
           "SELECT series_id, date_day, " + ", ".join(f"inputs[{i}] AS x{i}" for i in range(1, 13))
           + " FROM seq WHERE rn = 1 AND len(inputs) = 12"),
)
def _(spark, sf_dir):
    seq = priority_log(spark, sf_dir).select(*KEY, W.sequence("inflow_adj", 12, include_current=True).alias("inputs"))
    last = latest_rows(seq, W).where(F.col("inputs").isNotNull())
    return last.select(*KEY, *[F.col("inputs")[i].alias(f"x{i + 1}") for i in range(12)])


@query(
    "minmax_scale",
    select(PRIORITY + """, ends AS (
  SELECT *, min(inflow_adj) OVER (PARTITION BY series_id) AS low, max(inflow_adj) OVER (PARTITION BY series_id) AS high
  FROM prio)""",
           """SELECT series_id, date_day, round((inflow_adj - low) / (high - low), 9) AS scaled,
  round(low + (inflow_adj - low) / (high - low) * (high - low), 2) AS restored FROM ends"""),
)
def _(spark, sf_dir):
    scaled = min_max_scaled(priority_log(spark, sf_dir), "inflow_adj", "scaled")
    back = min_max_restored(F.col("scaled"), F.col("scaled_low"), F.col("scaled_high"))
    return scaled.select(*KEY, F.round("scaled", 9).alias("scaled"), F.round(back, 2).alias("restored"))


@query(
    "latest_features",
    select(FEATURES_SQL, """SELECT series_id, date_day, rain_7d, rain_30d, qin_30d FROM features
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date_day DESC) = 1"""),
)
def _(spark, sf_dir):
    return latest_rows(daily_features(daily_log(spark, sf_dir)), W).select(*KEY, "rain_7d", "rain_30d", "qin_30d")


_READINGS_PART = "PARTITION BY series_id"


@query(
    "rolling_long_series",
    select(
        f"r AS (SELECT '{SERIES}' AS series_id, ts, event_id, round(value * 100) AS reading FROM events)",
        "SELECT event_id, reading, " + ", ".join([
            f"row_number() {over('ts, event_id')} AS position",
            f"sum(reading) {rows(-6, 0, 'ts, event_id')} AS sum_7",
            f"sum(reading) {rows(-44, 0, 'ts, event_id')} AS sum_45",
            f"max(reading) {rows(-29, 0, 'ts, event_id')} AS max_30",
            f"lag(reading, 12) {over('ts, event_id')} AS lag_12",
            f"lead(reading) {over('ts, event_id')} AS next_reading",
            f"sum(reading) {rows(-30, -1, 'ts, event_id')} AS prior_30",
            f"CASE WHEN count(reading) {rows(1, 30, 'ts, event_id')} = 30 AND row_number() {over('ts, event_id')} >= 30 "
            f"THEN sum(reading) {rows(1, 30, 'ts, event_id')} END AS next_30",
        ]) + " FROM r"),
)
def _(spark, sf_dir):
    readings = table(spark, sf_dir, "events").select(
        F.lit(SERIES).alias("series_id"), "ts", "event_id", cents("value").alias("reading")
    )
    features = lambda w: [
        w.rolling_sum("reading", 7).alias("sum_7"),
        w.rolling_sum("reading", 45).alias("sum_45"),
        w.rolling_max("reading", 30).alias("max_30"),
        w.lag("reading", 12).alias("lag_12"),
        w.lead("reading").alias("next_reading"),
        w.prior_sum("reading", 30).alias("prior_30"),
        w.forward_sum("reading", 30).alias("next_30"),
    ]
    out = long_series.chunked_windows(
        readings, features, ["series_id"], ["ts", "event_id"], back=44, ahead=30, chunk_rows=4096
    )
    return out.select(
        "event_id", "reading", "position", "sum_7", "sum_45", "max_30", "lag_12", "next_reading", "prior_30", "next_30"
    )
