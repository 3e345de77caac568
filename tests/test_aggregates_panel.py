from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from freshet.operators import aggregates, panel, scaling

LOG = "series_id string, date_day date, x double, y double"


def test_monthly_sums_means_and_last_values(frame):
    df = frame([
        ("a", date(2020, 1, 1), None, 1.0), ("a", date(2020, 1, 5), None, 5.0), ("a", date(2020, 1, 9), None, None),
        ("a", date(2020, 2, 1), 2.0, None),
    ], LOG)
    out = {r.month: r for r in aggregates.monthly(df, sums=["x"], lasts=["y"]).collect()}
    assert out[1].x == 0.0 and out[1].y == 5.0 and out[1].date == date(2020, 1, 1)
    assert out[2].x == 2.0 and out[2].y is None
    snap = {r.month: r.y for r in aggregates.month_end_snapshot(df, ["y"]).collect()}
    assert snap == {1: 5.0, 2: None}


def test_hourly_means(frame):
    df = frame([
        ("a", datetime(2020, 1, 1, 0), 1.0), ("a", datetime(2020, 1, 1, 23), 3.0), ("a", datetime(2020, 1, 2, 0), None),
    ], "series_id string, time timestamp_ntz, soil double")
    assert {r.date_day: r.soil for r in aggregates.daily_mean(df, "soil").collect()} == {
        date(2020, 1, 1): 2.0, date(2020, 1, 2): None,
    }
    assert aggregates.monthly_mean_of_hours(df, "soil").first().soil == 2.0


def test_next_month_climatology_uses_the_fit_rows(frame):
    df = frame([("a", 2000, 1, 1.0), ("a", 2001, 1, 100.0), ("a", 2000, 12, 5.0)],
               "series_id string, year int, month int, rain double")
    out = aggregates.with_next_month_climatology(df, ["rain"], fit=F.col("year") <= 2000)
    got = {(r.year, r.month): r.rain_next for r in out.collect()}
    assert got == {(2000, 1): None, (2001, 1): None, (2000, 12): 1.0}


AREA = "series_id string, date_day date, area double, {} double"
D = [date(2020, 1, d) for d in range(1, 32)]


def sides(frame, rain_areas, soil_areas):
    rain = frame([("b", D[0], a, 1.0) for a in rain_areas], AREA.format("rain"))
    soil = frame([("b", D[0], a, 1.0) for a in soil_areas], AREA.format("soil"))
    return rain, soil


def matched(frame, rain_areas, soil_areas, how="auto"):
    out = panel.match_areas(*sides(frame, rain_areas, soil_areas), how).orderBy("k").collect()
    return [(r.subbasin, r.rain_area, r.soil_area, round(r.weight, 4)) for r in out]


def test_areas_in_common_are_kept(frame):
    assert matched(frame, [3.0, 1.0, 9.0, 1.0], [1.0, 3.0, 7.0]) == [("SB1", 1, 1, 0.25), ("SB2", 3, 3, 0.75)]


def test_areas_without_common_ones_are_ranked(frame):
    assert matched(frame, [3.0, 1.0], [20.0, 10.0]) == [("SB1", 1, 10, 0.25), ("SB2", 3, 20, 0.75)]
    assert matched(frame, [3.0, 1.0], [3.0, 4.0], "rank") == [("SB1", 1, 3, 0.25), ("SB2", 3, 4, 0.75)]
    assert matched(frame, [3.0, 1.0], [20.0, 10.0], "exact") == []


def test_unequal_counts_fail(frame):
    with pytest.raises(Exception, match="differ in their number of areas"):
        matched(frame, [1.0, 2.0], [10.0])


def test_dense_panel_and_summaries(frame):
    rain = frame([("b", D[0], 1.0, 4.0), ("b", D[0], 1.0, 6.0), ("b", D[2], 3.0, 8.0)], AREA.format("rain"))
    soil = frame([("b", D[1], 1.0, 0.5), ("b", D[2], 3.0, 0.1), ("b", D[2], 1.0, None)], AREA.format("soil"))
    rain, soil = panel.daily_area_mean(rain, "rain"), panel.daily_area_mean(soil, "soil")
    areas = panel.match_areas(rain, soil)
    dense = panel.dense_panel(rain, soil, areas)
    cells = {(r.date_day.day, r.subbasin): (r.rain, r.soil) for r in dense.collect()}
    assert cells == {
        (1, "SB1"): (5.0, None), (1, "SB2"): (0.0, None), (2, "SB1"): (0.0, 0.5), (2, "SB2"): (0.0, None),
        (3, "SB1"): (0.0, None), (3, "SB2"): (8.0, 0.1),
    }
    long = panel.rolling_panel(dense)
    third = {r.subbasin: r for r in long.where(F.col("date_day") == D[2]).collect()}
    assert third["SB1"].arain_7d == 5 and third["SB1"].asm_7d == 0.5 and third["SB2"].arain_30d == 8
    summary = {r.date_day.day: r for r in panel.basin_summary(long).collect()}
    assert summary[3].arain_weighted_7d == pytest.approx(0.25 * 5 + 0.75 * 8)
    assert summary[3].arain_spread_7d == pytest.approx(1.5 * 2**0.5)
    assert summary[1].asm_weighted_7d == 0 and summary[1].asm_spread_30d is None
    wide = panel.wide_panel(long, panel.subbasin_labels(areas)).where(F.col("date_day") == D[2]).first()
    assert wide.arain_SB1_7d == 5 and wide.arain_SB2_7d == 8 and wide.asm_SB2_30d == 0.1


def test_imputation_and_scaling_are_fitted_on_chosen_rows(frame):
    df = frame([("a", date(2020, 1, 1), 2.0, 0.0), ("a", date(2020, 1, 2), None, 1.0), ("a", date(2020, 1, 3), 10.0, 1.0)], LOG)
    fit = F.col("date_day") <= date(2020, 1, 2)
    assert sorted(r.x for r in scaling.mean_imputed(df, ["x"], fit).collect()) == [2, 2, 10]
    scaled = scaling.min_max_scaled(scaling.mean_imputed(df, ["x"]), "x", "s")
    back = scaled.select("s", scaling.min_max_restored(F.col("s"), F.col("s_low"), F.col("s_high")).alias("x"))
    assert sorted((r.s, r.x) for r in back.collect()) == [(0, 2), (0.5, 6), (1, 10)]
    assert [r.s for r in scaling.min_max_scaled(df.limit(1), "x", "s").collect()] == [0]
