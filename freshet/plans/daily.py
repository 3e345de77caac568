"""Next-30-day inflow forecast from a daily log and subbasin panels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.calendar import cycle_cos, cycle_sin, DAYS_PER_YEAR
from freshet.functions.numeric import from_log_target, log_target, zero_if_null
from freshet.operators import aggregates, bands, evaluation, linear, panel, quantiles, trees
from freshet.operators.scaling import mean_imputed
from freshet.operators.windows import SeriesWindow
from freshet.plans.reports import score_report
from freshet.session import durable
from freshet.sources.checks import pick_features
from freshet.sources.results import read_result, write_result

# Default periods, quantiles, weights and features of the published model.
TRAIN_END, VAL_END = 2018, 2023
FLOOD_QUANTILE, EVENT_QUANTILE = 0.90, 0.75
FLOOD_WEIGHT, EVENT_WEIGHT = 3.0, 1.8
DAILY_FEATURES = ["qin_30d", "doy_sin", "doy_cos"]
PANEL_FEATURES = [
    "arain_SB4_7d", "arain_SB1_30d", "arain_SB4_30d", "asm_SB2_7d", "asm_SB3_7d",
    "asm_SB1_30d", "asm_SB2_30d", "asm_SB3_30d", "asm_SB4_30d",
]


@dataclass(frozen=True)
class DailyConfig:
    train_end: int = TRAIN_END
    val_end: int = VAL_END
    panel_features: list[str] = field(default_factory=lambda: list(PANEL_FEATURES))
    models: tuple[str, ...] = ("linear", "ridge", "forest", "weighted_forest", "regime_blend", "boosted")
    force_best: str | None = None
    issue_day: int = 1
    tree_share: float = 1.0  # share of the published tree counts, for trial runs
    boost_share: float | None = None  # share of the published boosting rounds; that of the trees unless given
    impute_before_drop: bool = False  # fill features with their training mean instead of dropping the row
    features: list[str] = field(default_factory=lambda: list(DAILY_FEATURES))


def daily_features(log: DataFrame, soil_hours: DataFrame | None = None) -> DataFrame:
    """Rolling rain and inflow, seasonality, and the next-30-day target, in one pass over one window.

    With hourly soil moisture, its daily mean and rolling means join in.
    """
    w = SeriesWindow()
    soil = []
    if soil_hours is not None:
        log = log.join(aggregates.daily_mean(soil_hours, "soil"), ["series_id", "date_day"], "left")
        soil = ["soil"]
    base = log.select(
        "series_id",
        "date_day",
        *soil,
        zero_if_null(F.col("rain_bsn_in")).alias("rain"),
        zero_if_null(F.col("rain_dam_in")).alias("dam"),
        zero_if_null(F.col("inflow_adj")).alias("inflow"),
    )
    spans = [3, 7, 14, 30, 45]
    doy = F.dayofyear("date_day")
    featured = base.select(
        "series_id",
        "date_day",
        F.year("date_day").alias("year"),
        F.month("date_day").alias("month"),
        "inflow",
        F.col("rain").alias("rain_1d"),
        F.col("dam").alias("dam_1d"),
        *[w.rolling_sum("rain", n).alias(f"rain_{n}d") for n in spans],
        *[w.rolling_sum("dam", n).alias(f"dam_{n}d") for n in spans],
        w.lag("inflow").alias("qin_lag1"),
        *[w.prior_mean("inflow", n).alias(f"qin_{n}d") for n in (3, 7, 14)],
        w.prior_sum("inflow", 30).alias("qin_30d"),
        w.prior_mean("inflow", 30).alias("qin_30d_mean"),
        w.rolling_sum("inflow", 30).alias("inflow_30d_sum"),
        doy.alias("doy"),
        cycle_sin(doy, DAYS_PER_YEAR).alias("doy_sin"),
        cycle_cos(doy, DAYS_PER_YEAR).alias("doy_cos"),
        w.forward_sum("inflow", 30).alias("inflow_next30"),
        *[F.col(c).alias("sm_1d") for c in soil],
        *[w.rolling_mean(c, n).alias(f"sm_{n}d_mean") for c in soil for n in (7, 14, 30)],
    )
    return featured.withColumn("inflow_next30_log", log_target(F.col("inflow_next30")))


def subbasin_features(rain: DataFrame, soil: DataFrame, names: list[str] = PANEL_FEATURES, match: str = "auto") -> DataFrame:
    """The basin summary and the subbasin features of ``names`` per date, from (series_id, date_day, area, rain) and
    (.., soil). Names of subbasins that the data lacks have no column."""
    rain_daily = durable(panel.daily_area_mean(rain, "rain"))
    soil_daily = durable(panel.daily_area_mean(soil, "soil"))
    areas = durable(panel.match_areas(rain_daily, soil_daily, match))
    return panel.named_panel(panel.subbasin_windows(rain_daily, soil_daily, areas), areas, names)


def model_table(features: DataFrame, sub: DataFrame | None, config: DailyConfig) -> tuple[DataFrame, list[str]]:
    """Rows complete in every chosen feature and the target, with split, thresholds and weights."""
    table = features if sub is None else features.join(sub, ["series_id", "date_day"], "left")
    chosen = list(config.features) + ([] if sub is None else pick_features(table, config.panel_features))
    rows = table.select(
        "series_id", "date_day", "year", "month", *chosen,
        F.col("inflow_next30").alias("y_true"), F.col("inflow_next30_log").alias("y_log"),
    ).withColumn("split", evaluation.split_by_year(F.col("year"), config.train_end, config.val_end))
    if config.impute_before_drop:
        rows = mean_imputed(durable(rows), chosen, F.col("split") == "train")
    # thresholds read the rows several times
    rows = durable(rows.na.drop())
    rows = quantiles.train_quantiles(rows, "y_true", {"flood": FLOOD_QUANTILE, "event": EVENT_QUANTILE})
    weight = evaluation.tail_weight(F.col("y_true"), F.col("event"), F.col("flood"), EVENT_WEIGHT, FLOOD_WEIGHT)
    high = (F.col("y_true") >= F.col("event")).cast("double")
    return rows.withColumns({"weight": weight, "high": high}), chosen


@dataclass
class DailyForecast:
    predictions: DataFrame  # long: one row per date and model
    scores: DataFrame
    best: DataFrame
    bands: DataFrame
    forecast: DataFrame  # best model on the test rows with intervals
    issue_days: DataFrame
    cadence: DataFrame
    issue_day: int = 1

    def files(self, folder: str) -> dict[str, str]:
        """Paths of the result files."""
        return {
            "scores": f"{folder}/metrics_daily_next30",
            "forecast": f"{folder}/predictions_daily_next30_with_ci",
            "issue_days": f"{folder}/predictions_monthly_issue_day{self.issue_day}_next30_with_ci",
            "cadence": f"{folder}/metrics_issue_cadence_next30",
        }

    def write(self, folder: str, fmt: str = "csv") -> dict[str, str]:
        """Scores, test forecast, issue-day slice and cadence scores as files; returns their paths."""
        paths = self.files(folder)
        cadence = score_report(self.cadence.join(self.best.withColumnRenamed("name", "model"), "series_id"))
        write_result(score_report(self.scores), paths["scores"], fmt, order_by=["split", "RMSE", "name"])
        write_result(self.forecast, paths["forecast"], fmt, order_by=["date_day"])
        write_result(self.issue_days, paths["issue_days"], fmt, order_by=["date_day"])
        write_result(cadence, paths["cadence"], fmt, order_by=["cadence"])
        return paths

    def read(self, spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> DataFrame:
        """One of the written files, typed as the table it was written from."""
        table = {"forecast": self.forecast, "issue_days": self.issue_days}.get(name)
        schema = score_report(self.scores).schema if name == "scores" else table.schema if table is not None else None
        if schema is None:
            schema = score_report(self.cadence.withColumn("model", F.lit(""))).schema
        return read_result(spark, self.files(folder)[name], schema, fmt)


def predict_all(table: DataFrame, chosen: list[str], config: DailyConfig) -> tuple[DataFrame, dict[str, str]]:
    """One prediction column for every configured model, fitted on the training rows of each series.

    Linear models are solved for all series at once. Tree models are fitted series by series, several fits at a time.
    """
    train = table.where(F.col("split") == "train")
    columns = {name: f"y_{name}" for name in config.models}
    shrink = lambda s: trees.ForestSpec(max(1, round(s.trees * config.tree_share)), s.depth, s.leaf)

    def forest(spec: trees.ForestSpec, column: str, weight: str | None = None):
        def fit(rows: DataFrame):
            model = trees.fit_forest(rows, chosen, "y_log", shrink(spec), weight)
            return lambda df: trees.predict(df, model, chosen, column)

        return fit

    def blended(rows: DataFrame):
        specs = [shrink(s) for s in (trees.REGIME_CLASSIFIER, trees.REGIME_LOW, trees.REGIME_HIGH)]
        blend = trees.fit_regime_blend(rows, chosen, "y_log", "high", "weight", *specs)
        return None if blend is None else lambda df: trees.predict_regime_blend(df, blend, chosen, "y_regime_blend")

    def boosted(rows: DataFrame):
        share = config.tree_share if config.boost_share is None else config.boost_share
        spec = trees.BoostSpec(max(1, round(trees.DAILY_BOOST.rounds * share)), trees.DAILY_BOOST.depth)
        model = trees.fit_boosted(rows, chosen, "y_log", spec)
        return lambda df: trees.predict(df, model, chosen, "y_boosted")

    fits = {
        "forest": forest(trees.DAILY_FOREST, "y_forest"),
        "weighted_forest": forest(trees.WEIGHTED_FOREST, "y_weighted_forest", "weight"),
        "regime_blend": blended,
        "boosted": boosted,
    }
    unknown = set(config.models) - {"linear", "ridge", *fits}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    wanted = {columns[name]: fits[name] for name in config.models if name in fits}
    out = trees.per_series(table, wanted) if wanted else table
    for name in ("linear", "ridge"):
        if name in config.models:
            model = linear.fit_linear(train, chosen, "y_log", "least_squares" if name == "linear" else "ridge", penalty=1.0)
            out = linear.predict_linear(out, model, chosen, columns[name])
            out = out.withColumn(columns[name], from_log_target(F.col(columns[name])))
    return out, columns


def daily_forecast(
    log: DataFrame,
    rain: DataFrame | None = None,
    soil: DataFrame | None = None,
    config: DailyConfig = DailyConfig(),
    soil_hours: DataFrame | None = None,
) -> DailyForecast:
    """The whole analysis. The feature table is written once, so model fits never rescan the inputs.

    ``rain`` and ``soil`` are subbasin rows, ``soil_hours`` one sensor's readings.
    """
    if config.force_best is not None and config.force_best not in config.models:
        raise ValueError(f"forced model {config.force_best} is not among {config.models}")
    sub = None if rain is None else subbasin_features(rain, soil, config.panel_features)
    table, chosen = model_table(daily_features(log, soil_hours), sub, config)
    predicted, columns = predict_all(durable(table), chosen, config)
    keep = ["series_id", "date_day", "month", "split", "y_true", "flood", "event"]
    long = durable(evaluation.stack_predictions(predicted, columns, keep))
    scores = evaluation.score(long, ["series_id", "split", "name"], flood="flood", event="event")
    best = evaluation.best_model(scores, force=config.force_best)
    of_best = long.join(best, ["series_id", "name"])
    residuals = of_best.where("split = 'val'").withColumn("residual", F.col("y_true") - F.col("y_pred"))
    offsets = bands.residual_bands(residuals, "residual")
    test = of_best.where("split = 'test'")
    with_bands = bands.with_intervals(test, offsets)
    forecast = with_bands.select(
        "series_id", "date_day", F.col("y_true").alias("y_true_next30"), F.col("y_pred").alias("y_pred_next30"),
        "y_lo90", "y_hi90", "y_lo50", "y_hi50",
    )
    return DailyForecast(
        predictions=long,
        scores=scores,
        best=best,
        bands=offsets,
        forecast=forecast,
        issue_days=evaluation.issue_day_rows(forecast, config.issue_day),
        cadence=evaluation.cadence_scores(test, config.issue_day, flood="flood", event="event"),
        issue_day=config.issue_day,
    )
