import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import trees
from freshet.plans import daily, monthly

START = date(2015, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(365 * 5):
        d = START + timedelta(days=i)
        rain = float(max(0, rng.normal(1 + math.sin(i / 58), 1)))
        rows.append(("basin", d, 1500.0, float(1000 + i % 50), 1.0, 2.0, 0.1, 5 + 3 * rain + rng.random(), rain / 2, rain))
    schema = ("series_id string, date_day date, elevation_ft double, storage_2400 double, releases_power double, "
              "releases_total double, evap_in double, inflow_adj double, rain_dam_in double, rain_bsn_in double")
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def panel_sides(spark):
    rng = np.random.default_rng(2)
    rows = lambda: [("basin", START + timedelta(days=i), a, float(rng.random())) for i in range(365 * 5) for a in (10.0, 30.0)]
    schema = "series_id string, date_day date, area double, {} double"
    return spark.createDataFrame(rows(), schema.format("rain")), spark.createDataFrame(rows(), schema.format("soil"))


def test_daily_forecast_end_to_end(log, panel_sides):
    config = daily.DailyConfig(2017, 2018, ["arain_SB1_30d", "asm_SB2_30d"], tree_share=0.01)
    out = daily.daily_forecast(log, *panel_sides, config=config)
    scores = out.scores.collect()
    assert {r.name for r in scores} == set(config.models) and {r.split for r in scores} == {"train", "val", "test"}
    assert all(math.isfinite(r.rmse) for r in scores)
    by = {(r.name, r.split): r for r in scores}
    assert by[("forest", "train")].r2 > 0.3 and by[("boosted", "train")].mae < by[("linear", "train")].mae
    val = sorted((r.flood_mae, r.mae, r.name) for r in scores if r.split == "val" and r.flood_mae is not None)
    assert out.best.first().name == val[0][2]
    rows = out.forecast.collect()
    assert len(rows) > 300 and all(r.y_lo90 <= r.y_lo50 <= r.y_hi50 <= r.y_hi90 for r in rows)
    assert all(r.date_day.day == 1 for r in out.issue_days.collect())
    assert {r.cadence for r in out.cadence.collect()} == {"daily_all", "monthly_day1"}


def test_forced_model_must_be_configured(log):
    with pytest.raises(ValueError, match="forced model"):
        daily.daily_forecast(log, config=daily.DailyConfig(2017, 2018, models=("linear",), force_best="forest"))


def test_forced_model_wins_and_results_are_written(log, spark, tmp_path):
    config = daily.DailyConfig(2017, 2018, models=("linear", "ridge"), force_best="ridge", issue_day=2)
    out = daily.daily_forecast(log, config=config)
    assert out.best.first().name == "ridge"
    out.write(str(tmp_path))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name))
    scores = read("metrics_daily_next30")
    assert {"split", "name", "MAE", "RMSE", "R2", "NSE", "FloodMAE", "EventRecall"} <= set(scores.columns)
    assert scores.count() == 6
    days = [r.date_day for r in read("predictions_daily_next30_with_ci").collect()]
    assert days == sorted(days) and len(days) > 300
    assert all(r.date_day.endswith("-02") for r in read("predictions_monthly_issue_day2_next30_with_ci").collect())
    cadence = read("metrics_issue_cadence_next30").collect()
    assert [(r.cadence, r.model) for r in cadence] == [("daily_all", "ridge"), ("monthly_day2", "ridge")]


def test_soil_features_enter_the_model(log):
    hours = log.select("series_id", F.col("date_day").cast("timestamp_ntz").alias("time"), F.col("rain_bsn_in").alias("soil"))
    table = daily.daily_features(log, hours)
    config = daily.DailyConfig(2017, 2018, features=["sm_7d_mean", "qin_30d_mean"])
    rows, chosen = daily.model_table(table, None, config)
    assert chosen == ["sm_7d_mean", "qin_30d_mean"] and rows.count() == 365 * 5 - 29 - 30
    late = hours.where("year(time) > 2015")
    kept = lambda impute: daily.model_table(
        daily.daily_features(log, late), None,
        daily.DailyConfig(2017, 2018, features=["sm_1d"], impute_before_drop=impute),
    )[0].where("year = 2015").count()
    assert kept(False) == 0 and kept(True) == 365 - 29


def test_panel_features_must_exist(log, panel_sides):
    with pytest.warns(UserWarning), pytest.raises(ValueError, match="no feature"):
        sub = daily.subbasin_features(*panel_sides)
        daily.model_table(daily.daily_features(log), sub, daily.DailyConfig(panel_features=["arain_SB9_7d"]))


def test_regime_blend_needs_both_regimes(frame):
    rows = [(float(i), float(i), float(i > 95), 1.0) for i in range(100)]
    df = frame(rows, "x double, y double, high double, w double")
    assert trees.fit_regime_blend(df, ["x"], "y", "high", "w") is None
    spec = trees.ForestSpec(5, 4, 1)
    blend = trees.fit_regime_blend(df, ["x"], "y", "high", "w", spec, spec, spec, min_rows=3)
    got = trees.predict_regime_blend(df, blend, ["x"]).agg(F.count("y_pred")).first()[0]
    assert got == 100


def test_row_weights_move_a_forest(frame):
    df = frame([(1.0, 0.0, 1.0), (1.0, 10.0, 99.0)] * 30, "x double, y double, w double")
    mean = lambda w: trees.predict(
        df, trees.fit_forest(df, ["x"], "y", trees.ForestSpec(20, 2, 1), w), ["x"], log_target=False
    ).first().y_pred
    assert mean("w") > 9 > 6 > mean(None)


def test_monthly_forecast_end_to_end(log, spark):
    hours = log.select("series_id", F.col("date_day").cast("timestamp_ntz").alias("time"), (F.col("rain_bsn_in") / 10).alias("soil"))
    out = monthly.monthly_forecast(log, hours, 2017, 2018, tree_share=0.004)
    scores = {(r.name, r.split): r for r in out.scores.collect()}
    assert {n for n, _ in scores} == {"linear", "ridge", "lasso", "forest", "boosted", "last_value"}
    assert scores[("linear", "train")].n == 24
    banded = out.intervals.collect()
    assert {r.name for r in banded} == {"linear", "forest", "boosted"}
    assert all(r.y_lo90 <= r.y_hi90 for r in banded)
    report = out.report()
    assert {"y_lin", "y_ridge", "y_lasso", "y_last", "y_rf", "y_xgb", "y_lin_lo90", "y_xgb_hi50"} <= set(report.columns)
    assert report.count() == len({r.date for r in banded})


def test_monthly_features_fit_scope(log):
    everything = monthly.monthly_features(log).where("year = 2015 AND month = 12").first()
    first_year = monthly.monthly_features(log, fit=F.col("year") <= 2015).where("year = 2015 AND month = 12").first()
    january = log.where("month(date_day) = 1 AND year(date_day) = 2015").agg(F.sum("rain_bsn_in")).first()[0]
    assert first_year.rain_bsn_next == pytest.approx(january)
    assert everything.rain_bsn_next != pytest.approx(january)


def test_month_analyses(log):
    outlook = monthly.month_outlook(log, 1)
    # the first January has no rain before it
    assert sorted(r.year for r in outlook.fitted.collect()) == [2016, 2017, 2018, 2019]
    assert outlook.gamma.first().down_95 > outlook.gamma.first().down_50 > 0
    scores, forecast = monthly.next_month_rain(log)
    assert forecast.count() == 1 and {r.split for r in scores.collect()} == {"train", "test"}
    changes = monthly.storage_input_changes(log).orderBy("date").collect()
    assert changes[0].storage_change is None and changes[4].inflow_sum is not None and changes[3].inflow_sum is None
    assert changes[4].input_change is None and changes[5].input_change is not None
    balance = monthly.water_balance(log).orderBy("date").collect()
    assert balance[0].water_change is None and balance[-1].storage_next_month is None
    assert monthly.rain_climatology(log).count() == 15


def test_every_series_has_trees_of_its_own(frame):
    """A long series that rises with x and a short one that falls; one too short for two regimes."""
    rows = [("long", i, float(i % 50), float(i % 50) * 2 + 10, "train" if i < 250 else "test") for i in range(300)]
    rows += [("short", i, float(i), 500.0 - 5 * i, "train" if i < 30 else "test") for i in range(40)]
    rows += [("untrained", i, float(i), 1.0, "test") for i in range(3)]
    df = frame(rows, "series_id string, t int, x double, y double, split string")
    df = df.withColumns({"high": (F.col("y") > 60).cast("double"), "w": F.lit(1.0)})
    spec = trees.ForestSpec(10, 5, 1)

    def forest(train):
        model = trees.fit_forest(train, ["x"], "y", spec)
        return lambda d: trees.predict(d, model, ["x"], "y_forest", log_target=False)

    def blend(train):
        model = trees.fit_regime_blend(train, ["x"], "y", "high", "w", spec, spec, spec, min_rows=40)
        return None if model is None else lambda d: trees.predict_regime_blend(d, model, ["x"], "y_blend")

    with pytest.warns(UserWarning, match="too few training rows"):
        out = trees.per_series(df, {"y_forest": forest, "y_blend": blend}).collect()
    assert len(out) == len(rows)
    of = lambda s: [r for r in out if r.series_id == s]
    assert all(abs(r.y_forest - r.y) < 8 for r in of("long")) and all(abs(r.y_forest - r.y) < 60 for r in of("short"))
    assert all(355 <= r.y_forest <= 500 for r in of("short"))  # the range of its own training rows
    assert all(r.y_forest is None and r.y_blend is None for r in of("untrained"))
    assert all(r.y_blend is not None for r in of("long")) and all(r.y_blend is None for r in of("short"))
    assert trees.per_series(df.limit(0), {"y_forest": forest}).collect() == []
