"""Monthly queries: grain changes, joins, climatology, storage and water balance, text ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.catalog.sqltext import FLOWS, MONTH_MEANS, MONTH_SUMS, over, rows, select
from freshet.catalog.tables import (
    DAILY, HEAVY, PRIORITY, SOIL, TRAIN_END, VAL_END, daily_log, priority_log, soil_hours,
)
from freshet.functions import calendar
from freshet.operators import aggregates, distributions
from freshet.operators.scaling import mean_imputed
from freshet.operators.windows import SeriesWindow
from freshet.plans import monthly as plans
from freshet.session import durable
from freshet.sources.schemas import LOG_FIELDS, LOG_FOOT_LINES, LOG_HEAD_LINES
from freshet.sources.tables import daily_log as typed_log
from freshet.sources.text_log import parse_text_logs

MONTH_KEY = ["series_id", "year", "month"]


def rounded(df, columns: dict[str, int]):
    return df.withColumns({c: F.round(c, d) for c, d in columns.items()})


@query("monthly_sum", select(MONTH_SUMS, "SELECT * FROM months"))
def _(spark, sf_dir):
    return aggregates.monthly(daily_log(spark, sf_dir), sums=FLOWS)


@query(
    "monthly_mean",
    select(MONTH_MEANS, "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in FLOWS) + ") FROM months"),
)
def _(spark, sf_dir):
    return rounded(aggregates.monthly(daily_log(spark, sf_dir), means=FLOWS), {c: 4 for c in FLOWS})


MIXED_SUMS = ["releases_power", "releases_total", "evap_in", "inflow_adj", "rain_dam_in", "rain_bsn_in"]
MIXED_ONLY = "mixed AS (SELECT series_id, CAST(year(date_day) AS INTEGER) AS year, " \
    "CAST(month(date_day) AS INTEGER) AS month, CAST(date_trunc('month', min(date_day)) AS DATE) AS date, " \
    + ", ".join(f"coalesce(sum({c}), 0.0) AS {c}" for c in MIXED_SUMS) \
    + ", avg(elevation_ft) AS elevation_ft, arg_max(storage_2400, date_day) FILTER (storage_2400 IS NOT NULL) AS storage_2400," \
      " coalesce(sum(rain_bsn_in), 0.0) + coalesce(sum(rain_dam_in), 0.0) AS rainfall_total FROM daily GROUP BY 1, 2, 3)"
MIXED = DAILY + ", " + MIXED_ONLY


@query("monthly_mixed_agg", select(MIXED, "SELECT * REPLACE (round(elevation_ft, 6) AS elevation_ft) FROM mixed"))
def _(spark, sf_dir):
    return rounded(plans.monthly_log(daily_log(spark, sf_dir)), {"elevation_ft": 6})


RAIN_DAILY = DAILY + f""", rainy AS (
  SELECT series_id, date_day, coalesce(rain_bsn_in, 0.0) AS rain,
         CASE WHEN coalesce(rain_bsn_in, 0.0) >= {HEAVY} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS heavy FROM daily),
rain_rolls AS (
  SELECT series_id, date_day, sum(rain) {rows(-6, 0)} AS rain_7d, sum(rain) {rows(-13, 0)} AS rain_14d,
         sum(rain) {rows(-29, 0)} AS rain_30d, max(rain) {rows(-29, 0)} AS rain_max1d_30d,
         sum(heavy) {rows(-29, 0)} AS heavy_rain_days_30d FROM rainy)"""
SNAPSHOT = RAIN_DAILY + ", snapshot AS (SELECT series_id, CAST(year(date_day) AS INTEGER) AS year, " \
    "CAST(month(date_day) AS INTEGER) AS month, " \
    + ", ".join(f"arg_max({c}, date_day) FILTER ({c} IS NOT NULL) AS {c}" for c in plans.RAIN_FEATURES) \
    + " FROM rain_rolls GROUP BY 1, 2, 3)"


@query("month_end_snapshot", select(SNAPSHOT, "SELECT * FROM snapshot"))
def _(spark, sf_dir):
    daily = plans.daily_rain_features(daily_log(spark, sf_dir), HEAVY)
    return aggregates.month_end_snapshot(daily, plans.RAIN_FEATURES)


@query(
    "soil_daily_mean",
    select(SOIL, "SELECT series_id, CAST(time AS DATE) AS date_day, round(avg(soil), 4) AS soil FROM soil GROUP BY 1, 2"),
)
def _(spark, sf_dir):
    return rounded(aggregates.daily_mean(soil_hours(spark, sf_dir), "soil"), {"soil": 4})


@query(
    "soil_monthly_mean",
    select(SOIL, """SELECT series_id, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month,
  round(avg(soil), 4) AS soil FROM soil GROUP BY 1, 2, 3"""),
)
def _(spark, sf_dir):
    return rounded(aggregates.monthly_mean_of_hours(soil_hours(spark, sf_dir), "soil"), {"soil": 4})


@query(
    "daily_soil_join",
    select(DAILY + ", " + SOIL + """, soil_daily AS (
  SELECT series_id, CAST(time AS DATE) AS date_day, avg(soil) AS soil FROM soil GROUP BY 1, 2)""",
           """SELECT d.series_id, d.date_day, d.inflow_adj, round(s.soil, 4) AS soil
FROM daily d LEFT JOIN soil_daily s ON d.series_id = s.series_id AND d.date_day = s.date_day"""),
)
def _(spark, sf_dir):
    soil = aggregates.daily_mean(soil_hours(spark, sf_dir), "soil")
    joined = daily_log(spark, sf_dir).join(soil, ["series_id", "date_day"], "left")
    return joined.select("series_id", "date_day", "inflow_adj", F.round("soil", 4).alias("soil"))


CLIM = ["storage_2400", "rain_dam_in", "rain_bsn_in"]


@query(
    "climatology_monthly",
    select(DAILY, "SELECT series_id, CAST(month(date_day) AS INTEGER) AS month, "
           + ", ".join(f"round(avg({c}), 4) AS {c}" for c in CLIM) + " FROM daily GROUP BY 1, 2"),
)
def _(spark, sf_dir):
    by_month = aggregates.climatology(aggregates.with_month(daily_log(spark, sf_dir)), CLIM)
    return rounded(by_month, {c: 4 for c in CLIM})


@query(
    "future_rows_lags",
    select(DAILY + """, clim AS (
  SELECT series_id, CAST(month(date_day) AS INTEGER) AS position, avg(storage_2400) AS storage_2400,
         avg(rain_dam_in) AS rain_dam_in, avg(rain_bsn_in) AS rain_bsn_in FROM daily GROUP BY 1, 2),
longer AS (
  SELECT *, rain_dam_in + rain_bsn_in AS rainfall FROM (
    SELECT * FROM clim UNION ALL
    SELECT series_id, CAST(last + i AS INTEGER), NULL, NULL, NULL
    FROM (SELECT series_id, max(position) AS last FROM clim GROUP BY 1), (SELECT unnest([1, 2, 3]) AS i)))""",
           "SELECT series_id, position, CASE WHEN position <= 12 THEN monthname(make_date(2001, position, 1)) "
           "ELSE 'Extra ' || (position - 12) END AS label, round(storage_2400, 4) AS storage_2400, "
           "round(rain_dam_in, 4) AS rain_dam_in, round(rain_bsn_in, 4) AS rain_bsn_in, round(rainfall, 4) AS rainfall, "
           + ", ".join(f"round(lag(rainfall, {k}) {over('position')}, 4) AS rainfall_{k}" for k in (1, 2, 3))
           + " FROM longer"),
)
def _(spark, sf_dir):
    out = plans.rain_climatology(daily_log(spark, sf_dir))
    return rounded(out, {c: 4 for c in [*CLIM, "rainfall", "rainfall_1", "rainfall_2", "rainfall_3"]})


RAINY = ["rain_bsn_in", "rain_dam_in", "rainfall_total"]


@query(
    "climatology_next_month",
    select(MIXED + ", clim AS (SELECT series_id, month, " + ", ".join(
        f"avg({c}) FILTER (year <= {TRAIN_END}) AS {c}_next" for c in RAINY) + " FROM mixed GROUP BY 1, 2)",
           "SELECT m.series_id, m.year, m.month, " + ", ".join(f"round({c}_next, 4) AS {c}_next" for c in RAINY)
           + " FROM mixed m LEFT JOIN clim c ON m.series_id = c.series_id AND c.month = m.month % 12 + 1"),
)
def _(spark, sf_dir):
    months = plans.monthly_log(daily_log(spark, sf_dir))
    out = aggregates.with_next_month_climatology(durable(months), RAINY, fit=F.col("year") <= TRAIN_END)
    return rounded(out.select(*MONTH_KEY, *[f"{c}_next" for c in RAINY]), {f"{c}_next": 4 for c in RAINY})


HISTORY = MONTH_SUMS + ", tall AS (SELECT *, rain_dam_in + rain_bsn_in AS rainfall FROM months), " \
    "history AS (SELECT *, " \
    + f"lead(rainfall) {over('date')} AS rainfall_next, lead(inflow_adj) {over('date')} AS inflow_next, " \
    + ", ".join(f"lag({c}, {k}) {over('date')} AS {n}_{k}" for c, n in
                (("rainfall", "rainfall"), ("evap_in", "evap"), ("inflow_adj", "inflow")) for k in range(1, 6)) \
    + " FROM tall)"


@query("leads", select(HISTORY, "SELECT series_id, year, month, rainfall_next, inflow_next FROM history"))
def _(spark, sf_dir):
    history = plans.month_history_table(daily_log(spark, sf_dir))
    return history.select(*MONTH_KEY, "rainfall_next", "inflow_next")


@query("month_history", select(HISTORY, "SELECT * FROM history"))
def _(spark, sf_dir):
    return plans.month_history_table(daily_log(spark, sf_dir))


@query(
    "named_lags",
    select(MONTH_SUMS, "SELECT series_id, year, month, " + ", ".join(
        f"lag(inflow_adj, {k}) {over('date')} AS inflow_lag{k}" for k in (1, 3, 6, 12))
        + f", sum(rain_bsn_in) {rows(-3, -1, 'date')} AS rain_roll3, sum(rain_bsn_in) {rows(-6, -1, 'date')} AS rain_roll6"
        + f", sum(rain_bsn_in) {rows(-12, -1, 'date')} AS rain_roll12 FROM months"),
)
def _(spark, sf_dir):
    w = SeriesWindow(order=["date"])
    months = aggregates.monthly(daily_log(spark, sf_dir), sums=FLOWS)
    return months.select(
        *MONTH_KEY,
        *[w.lag("inflow_adj", k).alias(f"inflow_lag{k}") for k in (1, 3, 6, 12)],
        *[w.prior_sum("rain_bsn_in", n).alias(f"rain_roll{n}") for n in (3, 6, 12)],
    )


@query(
    "dam_residual",
    select(MONTH_SUMS + f""", line AS (
  SELECT series_id, regr_slope(rain_dam_in, rain_bsn_in) AS slope, regr_intercept(rain_dam_in, rain_bsn_in) AS base
  FROM months WHERE year <= {TRAIN_END} GROUP BY 1)""",
           """SELECT series_id, year, month, round(rain_dam_in - (base + slope * rain_bsn_in), 5) + 0.0 AS resid
FROM months JOIN line USING (series_id)"""),
)
def _(spark, sf_dir):
    months = aggregates.monthly(daily_log(spark, sf_dir), sums=FLOWS)
    out = distributions.regression_residual(
        months, "rain_dam_in", "rain_bsn_in", "resid", fit=F.col("year") <= TRAIN_END
    )
    return rounded(out.select(*MONTH_KEY, "resid"), {"resid": 5})


_MF_SUMS = [("rain_bsn_in", n) for n in (3, 6, 12)]
_MF_LAGGED = ["rain_bsn_in", "evap_in", "inflow_adj", "releases_total", "elevation_ft", "storage_2400"]
MONTHLY_FEATURES = SNAPSHOT + ", " + MIXED_ONLY + ", " + SOIL + f""", soil_months AS (
  SELECT series_id, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, avg(soil) AS soil
  FROM soil GROUP BY 1, 2, 3),
joined AS (
  SELECT m.*, s.* EXCLUDE (series_id, year, month), o.soil FROM mixed m
  LEFT JOIN snapshot s ON m.series_id = s.series_id AND m.year = s.year AND m.month = s.month
  LEFT JOIN soil_months o ON m.series_id = o.series_id AND m.year = o.year AND m.month = o.month),
line AS (
  SELECT series_id, regr_slope(rain_dam_in, rain_bsn_in) AS slope, regr_intercept(rain_dam_in, rain_bsn_in) AS base
  FROM joined WHERE year <= {TRAIN_END} GROUP BY 1),
clim AS (
  SELECT series_id, month AS next_month, avg(rain_bsn_in) AS rain_bsn_next, avg(rain_dam_in) AS rain_dam_next,
         avg(rainfall_total) AS rainfall_next FROM joined WHERE year <= {TRAIN_END} GROUP BY 1, 2),
mf AS (
  SELECT joined.*, lag(soil, 1) {over('date')} AS soil_lag1, lag(soil, 3) {over('date')} AS soil_lag3,
    avg(soil) {rows(-3, -1, 'date')} AS soil_roll3, """ + ", ".join(
    f"sum({c}) {rows(-n, -1, 'date')} AS rain_bsn_roll{n}" for c, n in _MF_SUMS) + ", " + ", ".join(
    f"lag(inflow_adj, {k}) {over('date')} AS inflow_lag{k}" for k in (1, 3, 6)) + f""",
    lag(inflow_adj, 12) {over('date')} AS inflow_same_month_last_year, """ + ", ".join(
    f"lag({c}, {k}) {over('date')} AS {c}_{k}" for c in _MF_LAGGED for k in range(1, 7)) + f""",
    sin(2 * pi() * joined.month / 12.0) AS mon_sin, cos(2 * pi() * joined.month / 12.0) AS mon_cos,
    lead(inflow_adj) {over('date')} AS y_next FROM joined),
monthly_features AS (
  SELECT mf.*, ln(1 + y_next) AS y_next_log, rain_dam_in - (base + slope * rain_bsn_in) AS rain_dam_resid,
         rain_bsn_next, rain_dam_next, rainfall_next
  FROM mf JOIN line ON mf.series_id = line.series_id
       LEFT JOIN clim ON mf.series_id = clim.series_id AND clim.next_month = mf.month % 12 + 1)"""
_MF_ROUND = {
    "elevation_ft": 6, "soil": 4, "soil_lag1": 4, "soil_lag3": 4, "soil_roll3": 4, "mon_sin": 9, "mon_cos": 9,
    "y_next_log": 9, "rain_dam_resid": 5, "rain_bsn_next": 4, "rain_dam_next": 4, "rainfall_next": 4,
    **{f"elevation_ft_{k}": 6 for k in range(1, 7)},
}


@query(
    "monthly_features",
    select(MONTHLY_FEATURES, "SELECT * REPLACE (" + ", ".join(
        f"round({c}, {d}) + 0.0 AS {c}" for c, d in _MF_ROUND.items()) + ") FROM monthly_features"),
)
def _(spark, sf_dir):
    log = durable(daily_log(spark, sf_dir))
    fit = F.col("year") <= TRAIN_END
    return rounded(plans.monthly_features(log, soil_hours(spark, sf_dir), HEAVY, fit), _MF_ROUND)


CHANGES = MONTH_MEANS + f""", tall AS (SELECT *, rain_dam_in + rain_bsn_in AS rainfall FROM months),
sums AS (
  SELECT *, storage_2400 - lag(storage_2400) {over('date')} AS storage_change,
    CASE WHEN count(inflow_adj) {rows(-4, 0, 'date')} = 5 THEN sum(inflow_adj) {rows(-4, 0, 'date')} END AS inflow_sum,
    CASE WHEN count(rainfall) {rows(-3, 0, 'date')} = 4 THEN sum(rainfall) {rows(-3, 0, 'date')} END AS rain_sum
  FROM tall),
diffs AS (
  SELECT *, inflow_sum - lag(inflow_sum) {over('date')} AS inflow_sum_change,
    rain_sum - lag(rain_sum) {over('date')} AS rain_sum_change FROM sums),
changes AS (
  SELECT *, rain_sum_change + inflow_sum_change - evap_in AS input_change,
    rain_sum_change + inflow_sum_change - evap_in - releases_total AS input_change_less_releases FROM diffs)"""
_CH = ["storage_change", "inflow_sum", "rain_sum", "inflow_sum_change", "rain_sum_change", "input_change",
       "input_change_less_releases"]


@query(
    "storage_input_changes",
    select(CHANGES, "SELECT series_id, year, month, date, " + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in _CH)
           + " FROM changes"),
)
def _(spark, sf_dir):
    return rounded(plans.storage_input_changes(daily_log(spark, sf_dir)), {c: 3 for c in _CH})


@query(
    "corr_storage_input",
    select(CHANGES, """SELECT series_id, round(corr(storage_change, input_change), 9) AS corr_input,
  round(corr(storage_change, input_change_less_releases), 9) AS corr_input_less_releases FROM changes GROUP BY 1"""),
)
def _(spark, sf_dir):
    changes = plans.storage_input_changes(daily_log(spark, sf_dir))
    out = distributions.correlation(changes, {
        "corr_input": ("storage_change", "input_change"),
        "corr_input_less_releases": ("storage_change", "input_change_less_releases"),
    })
    return rounded(out, {"corr_input": 9, "corr_input_less_releases": 9})


_WB = ["water_change", "carryover", "carryover_last_month", "storage_next_month"]


@query(
    "water_balance",
    select(MONTH_MEANS + f""", changed AS (
  SELECT *, lag(inflow_adj) {over('date')} + (rain_dam_in + rain_bsn_in) - evap_in - releases_total AS water_change
  FROM months), carried AS (SELECT *, storage_2400 + water_change AS carryover FROM changed)""",
           f"""SELECT series_id, year, month, date, round(water_change, 3) AS water_change, round(carryover, 3) AS carryover,
  round(lag(carryover) {over('date')}, 3) AS carryover_last_month,
  round(lead(storage_2400) {over('date')}, 3) AS storage_next_month FROM carried"""),
)
def _(spark, sf_dir):
    return rounded(plans.water_balance(daily_log(spark, sf_dir)), {c: 3 for c in _WB})


@query(
    "historical_month_mean",
    select(HISTORY, """SELECT series_id, month, round(avg(inflow_next), 4) AS historical_mean,
  round(avg(rainfall) FILTER (rainfall > 0), 4) AS positive_rain_mean FROM history WHERE month = 1 GROUP BY 1, 2"""),
)
def _(spark, sf_dir):
    history = durable(plans.month_history_table(daily_log(spark, sf_dir)))
    inflow = aggregates.month_history(history, "inflow_next", 1)
    rain = aggregates.month_history(history, "rainfall", 1, positive_only=True)
    rain = rain.withColumnRenamed("historical_mean", "positive_rain_mean")
    both = inflow.join(rain, ["series_id", "month"], "left")
    return rounded(both, {"historical_mean": 4, "positive_rain_mean": 4})


@query(
    "series_span",
    select(DAILY, f"""SELECT series_id, min(date_day) AS first_date, max(date_day) AS last_date,
  make_date({TRAIN_END + 1}, 1, 1) AS val_from, make_date({VAL_END + 1}, 1, 1) AS test_from FROM daily GROUP BY 1"""),
)
def _(spark, sf_dir):
    return aggregates.series_span(daily_log(spark, sf_dir), TRAIN_END, VAL_END)


@query(
    "mean_impute",
    select(DAILY, f"""SELECT series_id, date_day,
  round(coalesce(inflow_adj, avg(inflow_adj) FILTER (year(date_day) <= {TRAIN_END}) OVER (PARTITION BY series_id)), 4) AS inflow_adj,
  round(coalesce(rain_bsn_in, avg(rain_bsn_in) FILTER (year(date_day) <= {TRAIN_END}) OVER (PARTITION BY series_id)), 4) AS rain_bsn_in
FROM daily"""),
)
def _(spark, sf_dir):
    log = daily_log(spark, sf_dir).select("series_id", "date_day", "inflow_adj", "rain_bsn_in")
    filled = mean_imputed(log, ["inflow_adj", "rain_bsn_in"], F.year("date_day") <= TRAIN_END)
    return rounded(filled, {"inflow_adj": 4, "rain_bsn_in": 4})


@query(
    "calendar_columns",
    select(PRIORITY, """SELECT DISTINCT date_day, CAST(month(date_day) AS INTEGER) AS month,
  CAST(date_trunc('month', date_day) AS DATE) AS month_start,
  CAST(date_trunc('month', date_day) + INTERVAL 1 MONTH AS DATE) AS next_month_start,
  CAST(month(date_day) % 12 + 1 AS INTEGER) AS next_month, strftime(date_day, '%b') AS short_name,
  monthname(date_day) AS long_name,
  CASE WHEN month(date_day) IN (12, 1, 2) THEN 'DJF' WHEN month(date_day) IN (3, 4, 5) THEN 'MAM'
       WHEN month(date_day) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season FROM prio"""),
)
def _(spark, sf_dir):
    days = priority_log(spark, sf_dir).select("date_day").distinct()
    # the month goes through its three-letter code, as in the text logs
    code = F.upper(calendar.month_short_name(F.col("date_day")))
    coded = days.select("date_day", calendar.month_number(code).alias("month"))
    start = calendar.month_start(F.year("date_day"), F.col("month"))
    return coded.select(
        "date_day", "month", start.alias("month_start"), F.add_months(start, 1).alias("next_month_start"),
        calendar.next_month_number(F.col("month")).alias("next_month"),
        calendar.month_short_name(F.col("date_day")).alias("short_name"),
        calendar.month_long_name(F.col("date_day")).alias("long_name"),
        calendar.season(F.col("month")).alias("season"),
    )


@query(
    "typed_log",
    select(DAILY + """, shifted AS (
  SELECT *, CAST(year(date_day) AS INTEGER) AS y, CAST(month(date_day) AS INTEGER) AS m,
         CAST(day(date_day) + 3 AS INTEGER) AS d FROM daily)""",
           """SELECT 'basin' AS series_id, try_cast(y || '-' || m || '-' || d AS DATE) AS date_day, y AS year, m AS month, d AS day,
  CASE WHEN d % 10 <> 4 THEN inflow_adj END AS inflow_adj, rain_dam_in, rain_bsn_in
FROM shifted WHERE try_cast(y || '-' || m || '-' || d AS DATE) IS NOT NULL"""),
)
def _(spark, sf_dir):
    """Text columns with month codes, days past the end of the month and unreadable numbers, typed again."""
    log = daily_log(spark, sf_dir)
    day = F.dayofmonth("date_day") + 3
    raw = log.select(
        F.year("date_day").cast("string").alias("year"),
        F.upper(F.date_format("date_day", "MMM")).alias("month"),
        day.cast("string").alias("day"),
        F.when(day % 10 == 4, "n/a").otherwise(F.col("inflow_adj").cast("string")).alias("inflow adj"),
        F.col("rain_dam_in").cast("string").alias("rainfall inches (7A to Dam)"),
        F.col("rain_bsn_in").cast("string").alias("rainfall inches (7A to BSN)"),
    )
    return typed_log(raw)


@query(
    "text_log_round_trip",
    select(DAILY, """SELECT 'LAKE' AS station, CAST(year(date_day) AS INTEGER) AS year,
  CAST(month(date_day) AS INTEGER) AS month, CAST(day(date_day) AS INTEGER) AS day, elevation_ft AS pool, elevation_ft,
  storage_2400, releases_power, releases_total, evap_in, inflow_adj, rain_dam_in, rain_bsn_in FROM daily
WHERE elevation_ft IS NOT NULL AND rain_bsn_in IS NOT NULL"""),
)
def _(spark, sf_dir):
    """The log written as monthly text files (at most 31 lines each) and parsed back; incomplete lines drop out."""
    log = daily_log(spark, sf_dir).withColumn("day", F.dayofmonth("date_day")).withColumn("pool", F.col("elevation_ft"))
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("")) for _, name in LOG_FIELDS]
    line = F.struct("day", F.concat_ws("   ", F.lit(""), *fields).alias("line"))
    month = F.concat(F.lit("LAKE_"), F.upper(F.date_format("date_day", "MMM")), F.lit("_"), F.year("date_day"), F.lit(".txt"))
    files = log.groupBy(month.alias("file_name")).agg(F.sort_array(F.collect_list(line))["line"].alias("lines"))
    filler = lambda n: F.array_repeat(F.lit("report text"), n)
    text = F.concat(filler(LOG_HEAD_LINES), F.col("lines"), filler(LOG_FOOT_LINES))
    return parse_text_logs(files.select("file_name", F.concat(F.array_join(text, "\n"), F.lit("\n")).alias("value")))
