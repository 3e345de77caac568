"""Monthly analyses: next-month inflow, month distributions, next-month rain, storage change, water balance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.calendar import climatology_row_label, cycle_cos, cycle_sin
from freshet.functions.numeric import at_least, from_log_target, log_target, strict_total, zero_if_null
from freshet.operators import aggregates, bands, distributions, evaluation, linear, trees
from freshet.operators.products import interval_offsets, latest_years, sigma_intervals
from freshet.operators.scaling import mean_imputed
from freshet.operators.windows import SeriesWindow, append_future_rows, latest_rows
from freshet.plans.reports import score_report
from freshet.session import durable
from freshet.sources.results import write_result

# Default periods, heavy-rain limit and features of the published monthly model.
TRAIN_END, VAL_END = 2018, 2021
HEAVY_RAIN = 1.5
FEATURES = [
    "mon_sin", "mon_cos", "inflow_adj_1", "rain_bsn_roll3", "rain_bsn_roll12", "rain_14d", "rain_30d",
    "rain_max1d_30d", "inflow_same_month_last_year", "inflow_lag6", "rain_dam_resid", "rain_bsn_next",
    "rain_dam_next", "soil", "soil_lag1", "soil_lag3", "soil_roll3",
]

# Short model names in prediction columns, and the models that get bands.
REPORT_MODELS = {
    "linear": "lin", "ridge": "ridge", "lasso": "lasso", "last_value": "last", "forest": "rf", "boosted": "xgb",
}
BANDED = ("linear", "forest", "boosted")

MONTHS = SeriesWindow(order=["date"])


def monthly_log(log: DataFrame) -> DataFrame:
    """Month totals of the flows and rains, mean elevation and last storage."""
    out = aggregates.monthly(
        log,
        sums=["releases_power", "releases_total", "evap_in", "inflow_adj", "rain_dam_in", "rain_bsn_in"],
        means=["elevation_ft"],
        lasts=["storage_2400"],
    )
    return out.withColumn("rainfall_total", strict_total(F.col("rain_bsn_in"), F.col("rain_dam_in")))


def daily_rain_features(log: DataFrame, heavy: float = HEAVY_RAIN) -> DataFrame:
    """Rolling basin rain: totals, largest day and number of heavy days."""
    w = SeriesWindow()
    base = log.select("series_id", "date_day", zero_if_null(F.col("rain_bsn_in")).alias("rain"))
    flagged = base.withColumn("heavy", at_least(F.col("rain"), heavy))
    return flagged.select(
        "series_id",
        "date_day",
        *[w.rolling_sum("rain", n).alias(f"rain_{n}d") for n in (7, 14, 30)],
        w.rolling_max("rain", 30).alias("rain_max1d_30d"),
        w.rolling_sum("heavy", 30).alias("heavy_rain_days_30d"),
    )


RAIN_FEATURES = ["rain_7d", "rain_14d", "rain_30d", "rain_max1d_30d", "heavy_rain_days_30d"]


def monthly_features(
    log: DataFrame, soil_hours: DataFrame | None = None, heavy: float = HEAVY_RAIN, fit: Column | None = None
) -> DataFrame:
    """The feature table of the next-month model with its target.

    ``fit`` names the rows that climatology and rain residual are fitted on, by default all of them.
    """
    months = monthly_log(log)
    snapshot = aggregates.month_end_snapshot(daily_rain_features(log, heavy), RAIN_FEATURES)
    table = months.join(snapshot, ["series_id", "year", "month"], "left")
    if soil_hours is not None:
        soil = aggregates.monthly_mean_of_hours(soil_hours, "soil")
        table = table.join(soil, ["series_id", "year", "month"], "left")
    else:
        table = table.withColumn("soil", F.lit(None).cast("double"))
    w = MONTHS
    lagged = ["rain_bsn_in", "evap_in", "inflow_adj", "releases_total", "elevation_ft", "storage_2400"]
    featured = table.select(
        "*",
        w.lag("soil", 1).alias("soil_lag1"),
        w.lag("soil", 3).alias("soil_lag3"),
        w.prior_mean("soil", 3).alias("soil_roll3"),
        *[w.prior_sum("rain_bsn_in", n).alias(f"rain_bsn_roll{n}") for n in (3, 6, 12)],
        *[w.lag("inflow_adj", k).alias(f"inflow_lag{k}") for k in (1, 3, 6)],
        w.lag("inflow_adj", 12).alias("inflow_same_month_last_year"),
        *w.lags_of(lagged, range(1, 7)),
        cycle_sin(F.col("month"), 12).alias("mon_sin"),
        cycle_cos(F.col("month"), 12).alias("mon_cos"),
        w.lead("inflow_adj").alias("y_next"),
    ).withColumn("y_next_log", log_target(F.col("y_next")))
    featured = distributions.regression_residual(featured, "rain_dam_in", "rain_bsn_in", "rain_dam_resid", fit=fit)
    named = aggregates.with_next_month_climatology(
        featured, ["rain_bsn_in", "rain_dam_in", "rainfall_total"], fit=fit, source=months
    )
    return named.withColumnsRenamed(
        {"rain_bsn_in_next": "rain_bsn_next", "rain_dam_in_next": "rain_dam_next", "rainfall_total_next": "rainfall_next"}
    )


@dataclass
class MonthlyForecast:
    predictions: DataFrame
    scores: DataFrame
    best: DataFrame
    intervals: DataFrame | None  # every banded model on the test rows
    names: list[str]

    def report(self) -> DataFrame:
        """Test months with one column per model and the band columns of the banded ones."""
        test = self.predictions.where("split = 'test'")
        columns = {n: f"y_{short}" for n, short in REPORT_MODELS.items() if n in self.names}
        wide = evaluation.widen_predictions(test, columns, ["series_id", "date", "year", "month"])
        if self.intervals is None:
            return wide
        cells = [
            F.max(F.when(F.col("name") == n, F.col(f"y_{b}"))).alias(f"{columns[n]}_{b}")
            for n in BANDED if n in self.names for b in bands.LEVELS
        ]
        return wide.join(self.intervals.groupBy("series_id", "date").agg(*cells), ["series_id", "date"])

    def write(self, folder: str, fmt: str = "csv") -> None:
        write_result(score_report(self.scores), f"{folder}/metrics_monthly", fmt, order_by=["split", "RMSE", "name"])
        write_result(self.report(), f"{folder}/predictions_monthly", fmt, order_by=["date"])


def monthly_forecast(
    log: DataFrame,
    soil_hours: DataFrame | None = None,
    train_end: int = TRAIN_END,
    val_end: int = VAL_END,
    exclude_years: list[int] = (),
    features: list[str] | None = None,
    models: tuple[str, ...] = ("linear", "ridge", "lasso", "forest", "boosted", "last_value"),
    tree_share: float = 1.0,
    boost_share: float | None = None,
    fit_scope: str = "train",
    impute_before_drop: bool = False,
) -> MonthlyForecast:
    """Next-month inflow by every model, scores per split, and residual bands from the validation rows."""
    log = durable(log)
    on_train = (F.col("year") <= train_end) if fit_scope == "train" else None
    table = monthly_features(log, soil_hours, fit=on_train)
    chosen = features or FEATURES
    rows = table.select(
        "series_id", "date", "year", "month", *chosen, F.col("inflow_adj_1").alias("_last"),
        F.col("y_next").alias("y_true"), F.col("y_next_log").alias("y_log"),
        evaluation.split_by_year(F.col("year"), train_end, val_end, exclude_years).alias("split"),
    )
    if impute_before_drop:
        rows = mean_imputed(durable(rows), chosen, F.col("split") == "train")
    rows = durable(rows.na.drop())
    train = rows.where("split = 'train'")
    columns = {name: f"y_{name}" for name in models}

    def forest(own: DataFrame):
        spec = trees.ForestSpec(max(1, round(trees.MONTHLY_FOREST.trees * tree_share)), trees.MONTHLY_FOREST.depth, trees.MONTHLY_FOREST.leaf)
        model = trees.fit_forest(own, chosen, "y_log", spec)
        return lambda df: trees.predict(df, model, chosen, "y_forest")

    def boosted(own: DataFrame):
        share = tree_share if boost_share is None else boost_share
        spec = trees.BoostSpec(max(1, round(trees.MONTHLY_BOOST.rounds * share)), trees.MONTHLY_BOOST.depth)
        model = trees.fit_boosted(own, chosen, "y_log", spec)
        return lambda df: trees.predict(df, model, chosen, "y_boosted")

    wanted = {columns[n]: f for n, f in {"forest": forest, "boosted": boosted}.items() if n in models}
    out = trees.per_series(rows, wanted) if wanted else rows
    for name in models:
        column = columns[name]
        if name == "last_value":
            out = out.withColumn(column, F.col("_last"))
        elif name not in ("forest", "boosted"):
            if name == "lasso":
                model = linear.fit_lasso_cv(train, chosen, "y_log", "date")
            else:
                model = linear.fit_linear(train, chosen, "y_log", "least_squares" if name == "linear" else "ridge")
            out = linear.predict_linear(out, model, chosen, column)
            out = out.withColumn(column, from_log_target(F.col(column)))
    # the baseline, the inflow of the month before, is not fitted: it has no training rows
    stacked = evaluation.stack_predictions(out, columns, ["series_id", "date", "year", "month", "split", "y_true"])
    long = durable(stacked.where("name <> 'last_value' OR split <> 'train'"))
    scores = evaluation.score(long, ["series_id", "split", "name"])
    banded = None
    for name in [m for m in BANDED if m in columns]:
        mine = long.where(F.col("name") == name)
        residual = mine.where("split = 'val'").withColumn("residual", F.col("y_true") - F.col("y_pred"))
        part = bands.with_intervals(mine.where("split = 'test'"), bands.residual_bands(residual, "residual"))
        banded = part if banded is None else banded.unionByName(part)
    return MonthlyForecast(long, scores, evaluation.best_model(scores, metric="mae"), banded, list(columns))


def month_history_table(log: DataFrame, lags: int = 5, how: str = "sums") -> DataFrame:
    """Month table with total rain, next month's rain and inflow, and lags 1..n of rain, evaporation and inflow.

    ``how`` is sums (month totals) or means.
    """
    columns = ["rain_dam_in", "rain_bsn_in", "evap_in", "inflow_adj", "releases_total", "storage_2400"]
    months = aggregates.monthly(log, **{how: columns})
    months = months.withColumn("rainfall", strict_total(F.col("rain_dam_in"), F.col("rain_bsn_in")))
    w = MONTHS
    steps = range(1, lags + 1)
    return months.select(
        "*",
        w.lead("rainfall").alias("rainfall_next"),
        w.lead("inflow_adj").alias("inflow_next"),
        *w.lags("rainfall", steps),
        *w.lags("evap_in", steps, "evap"),
        *w.lags("inflow_adj", steps, "inflow"),
    )


@dataclass
class MonthOutlook:
    fitted: DataFrame
    normal: DataFrame
    gamma: DataFrame


MONTH_FEATURES = ["rainfall_1", "rainfall", "rainfall_next", "evap_in"]


def month_outlook(log: DataFrame, month: int, features: list[str] = MONTH_FEATURES) -> MonthOutlook:
    """Fitted inflow of one calendar month over the years, with normal and gamma intervals of its rain."""
    table = month_history_table(log)
    fitted = latest_years(linear.fitted_by_year(table, features, "inflow_next", month))
    rain = table.where((F.col("month") == month) & (F.col("rainfall") > 0))
    gamma = distributions.gamma_fit(rain, "rainfall")
    gamma = distributions.with_gamma_interval(distributions.with_gamma_interval(gamma, 0.50, "_50"), 0.95, "_95")
    normal = sigma_intervals(distributions.normal_fit(rain, "rainfall"))
    return MonthOutlook(fitted, normal, interval_offsets(gamma, ["_50", "_95"]))


RAIN_INPUTS = ["rainfall", "rainfall_1", "rainfall_2", "rainfall_3", "evap_in", "evap_1", "evap_2"]


def next_month_rain(log: DataFrame, features: list[str] = RAIN_INPUTS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Next month's mean rain from recent months: (scores on held-out months, forecast from the newest row)."""
    table = month_history_table(log, lags=12, how="means")
    rows = table.na.drop(subset=[*features, "rainfall_next"])
    rows = rows.withColumn("split", evaluation.hash_split(F.col("date"), seed))
    model = linear.fit_linear(rows.where("split = 'train'"), features, "rainfall_next")
    predicted = linear.predict_linear(rows, model, features)
    scores = evaluation.score(predicted, ["series_id", "split"], y="rainfall_next")
    newest = latest_rows(rows, MONTHS)
    forecast = linear.predict_linear(newest, model, features).select(
        "series_id", F.add_months("date", 1).alias("date"), F.col("y_pred").alias("rainfall")
    )
    return scores, forecast


def storage_input_changes(log: DataFrame) -> DataFrame:
    """Month-to-month change of storage beside the change of the summed inputs.

    Inflow is summed over five months and rain over four; a sum needs all its months.
    """
    columns = ["storage_2400", "inflow_adj", "rain_dam_in", "rain_bsn_in", "evap_in", "releases_total"]
    months = aggregates.monthly(log, means=columns)
    months = months.withColumn("rainfall", strict_total(F.col("rain_dam_in"), F.col("rain_bsn_in")))
    w = MONTHS
    sums = months.select(
        "*",
        w.difference("storage_2400").alias("storage_change"),
        w.strict_sum("inflow_adj", 5).alias("inflow_sum"),
        w.strict_sum("rainfall", 4).alias("rain_sum"),
    )
    changes = sums.select(
        "*", w.difference("inflow_sum").alias("inflow_sum_change"), w.difference("rain_sum").alias("rain_sum_change")
    )
    inputs = F.col("rain_sum_change") + F.col("inflow_sum_change") - F.col("evap_in")
    return changes.select(
        "series_id",
        "year",
        "month",
        "date",
        "storage_change",
        "inflow_sum",
        "rain_sum",
        "inflow_sum_change",
        "rain_sum_change",
        inputs.alias("input_change"),
        (inputs - F.col("releases_total")).alias("input_change_less_releases"),
    )


def water_balance(log: DataFrame) -> DataFrame:
    """Last month's inflow plus rain less losses, the carry-over it leaves, and next month's storage."""
    columns = ["storage_2400", "inflow_adj", "rain_dam_in", "rain_bsn_in", "evap_in", "releases_total"]
    months = aggregates.monthly(log, means=columns)
    w = MONTHS
    rain = strict_total(F.col("rain_dam_in"), F.col("rain_bsn_in"))
    change = w.lag("inflow_adj") + rain - F.col("evap_in") - F.col("releases_total")
    carried = months.select("*", change.alias("water_change")).withColumn(
        "carryover", F.col("storage_2400") + F.col("water_change")
    )
    return carried.select(
        "series_id",
        "year",
        "month",
        "date",
        "water_change",
        "carryover",
        w.lag("carryover").alias("carryover_last_month"),
        w.lead("storage_2400").alias("storage_next_month"),
    )


def rain_climatology(log: DataFrame, future_rows: int = 3, lags: int = 3) -> DataFrame:
    """Mean storage and rain by calendar month, with empty rows appended so that lags run past December."""
    columns = ["storage_2400", "rain_dam_in", "rain_bsn_in"]
    clim = aggregates.climatology(aggregates.with_month(log), columns)
    long = append_future_rows(clim, future_rows, "month", ["series_id"], columns)
    long = long.withColumn("rainfall", strict_total(F.col("rain_dam_in"), F.col("rain_bsn_in")))
    w = SeriesWindow(order=["month"])
    return long.select(
        "series_id",
        F.col("month").alias("position"),
        climatology_row_label(F.col("month")).alias("label"),
        *columns,
        "rainfall",
        *w.lags("rainfall", range(1, lags + 1)),
    )
