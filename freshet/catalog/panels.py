"""Subbasin queries: area matching, weights, dense panel, weighted means and spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.catalog.registry import query
from freshet.catalog.sqltext import rows, select
from freshet.catalog.tables import SERIES, panel_sql, rain_by_area, soil_by_area
from freshet.operators import panel
from freshet.session import durable

SUBBASINS = [f"SB{k}" for k in range(1, 6)]


def _sides(spark, sf_dir, exact):
    """Both sides as daily area means, written once: the panel reads them more than once."""
    rain = durable(panel.daily_area_mean(rain_by_area(spark, sf_dir, exact), "rain"))
    soil = durable(panel.daily_area_mean(soil_by_area(spark, sf_dir, exact), "soil"))
    return rain, soil


def _areas_sql(exact: bool) -> str:
    if exact:
        number = """SELECT CAST(row_number() OVER (ORDER BY area) AS INTEGER) AS k, area AS rain_area, area AS soil_area
  FROM (SELECT DISTINCT area FROM rain_rows INTERSECT SELECT DISTINCT area FROM soil_rows)"""
    else:
        number = """SELECT CAST(r.k AS INTEGER) AS k, r.area AS rain_area, s.area AS soil_area
  FROM (SELECT area, row_number() OVER (ORDER BY area) AS k FROM (SELECT DISTINCT area FROM rain_rows)) r
  JOIN (SELECT area, row_number() OVER (ORDER BY area) AS k FROM (SELECT DISTINCT area FROM soil_rows)) s ON r.k = s.k"""
    return panel_sql(exact) + f""",
numbered AS ({number}),
areas AS (SELECT '{SERIES}' AS series_id, k, 'SB' || k AS subbasin, rain_area, soil_area,
                 rain_area / sum(rain_area) OVER () AS weight FROM numbered)"""


def _panel_sql(exact: bool) -> str:
    by = "PARTITION BY subbasin"
    return _areas_sql(exact) + f""",
cells AS (
  SELECT d.date_day, a.k, a.subbasin, a.weight, coalesce(r.rain, 0.0) AS rain, s.soil
  FROM (SELECT DISTINCT date_day FROM rain_rows UNION SELECT DISTINCT date_day FROM soil_rows) d CROSS JOIN areas a
  LEFT JOIN rain_rows r ON r.date_day = d.date_day AND r.area = a.rain_area
  LEFT JOIN soil_rows s ON s.date_day = d.date_day AND s.area = a.soil_area),
panel AS (
  SELECT '{SERIES}' AS series_id, date_day, subbasin, weight,
         sum(rain) {rows(-6, 0, 'date_day', by)} AS arain_7d, sum(rain) {rows(-29, 0, 'date_day', by)} AS arain_30d,
         avg(soil) {rows(-6, 0, 'date_day', by)} AS asm_7d, avg(soil) {rows(-29, 0, 'date_day', by)} AS asm_30d
  FROM cells)"""


_WEIGHT = "SELECT * REPLACE (round(weight, 9) AS weight) FROM areas"
_PANEL = "SELECT series_id, date_day, subbasin, round(weight, 9) AS weight, " + ", ".join(
    f"round({c}, 8) AS {c}" for c in panel.FEATURES) + " FROM panel"


@query("area_exact_match", select(_areas_sql(True), _WEIGHT))
def _(spark, sf_dir):
    rain, soil = rain_by_area(spark, sf_dir), soil_by_area(spark, sf_dir)
    return panel.match_areas(rain, soil).withColumn("weight", F.round("weight", 9))


@query("area_rank_match", select(_areas_sql(False), _WEIGHT))
def _(spark, sf_dir):
    rain, soil = rain_by_area(spark, sf_dir, False), soil_by_area(spark, sf_dir, False)
    return panel.match_areas(rain, soil).withColumn("weight", F.round("weight", 9))


def _long(spark, sf_dir, exact):
    rain, soil = _sides(spark, sf_dir, exact)
    return panel.subbasin_windows(rain, soil, durable(panel.match_areas(rain, soil)))


def _long_rounded(spark, sf_dir, exact):
    out = _long(spark, sf_dir, exact).withColumn("weight", F.round("weight", 9))
    return out.withColumns({c: F.round(c, 8) for c in panel.FEATURES})


@query("subbasin_panel", select(_panel_sql(True), _PANEL))
def _(spark, sf_dir):
    return _long_rounded(spark, sf_dir, True)


@query("subbasin_panel_by_rank", select(_panel_sql(False), _PANEL))
def _(spark, sf_dir):
    return _long_rounded(spark, sf_dir, False)


_SUMMARY = ["arain_weighted_7d", "arain_weighted_30d", "asm_weighted_7d", "asm_weighted_30d", "arain_spread_7d",
            "asm_spread_30d"]
SUMMARY_SQL = _panel_sql(True) + """, summary AS (
  SELECT series_id, date_day, coalesce(sum(weight * arain_7d), 0) AS arain_weighted_7d,
         coalesce(sum(weight * arain_30d), 0) AS arain_weighted_30d, coalesce(sum(weight * asm_7d), 0) AS asm_weighted_7d,
         coalesce(sum(weight * asm_30d), 0) AS asm_weighted_30d, stddev_samp(arain_7d) AS arain_spread_7d,
         stddev_samp(asm_30d) AS asm_spread_30d FROM panel GROUP BY 1, 2)"""


@query(
    "weighted_spread",
    select(SUMMARY_SQL, "SELECT series_id, date_day, " + ", ".join(f"round({c}, 8) AS {c}" for c in _SUMMARY)
           + " FROM summary"),
)
def _(spark, sf_dir):
    return panel.basin_summary(_long(spark, sf_dir, True)).withColumns({c: F.round(c, 8) for c in _SUMMARY})


_WIDE = [f"{a}_{sb}_{b}" for a, b in (("arain", "7d"), ("arain", "30d"), ("asm", "7d"), ("asm", "30d")) for sb in SUBBASINS]


@query(
    "panel_wide",
    select(_panel_sql(True), "SELECT series_id, date_day, " + ", ".join(
        f"round(max({a}_{b}) FILTER (subbasin = '{sb}'), 8) AS {a}_{sb}_{b}"
        for a, b in (("arain", "7d"), ("arain", "30d"), ("asm", "7d"), ("asm", "30d")) for sb in SUBBASINS)
        + " FROM panel GROUP BY 1, 2"),
)
def _(spark, sf_dir):
    wide = panel.wide_panel(_long(spark, sf_dir, True), SUBBASINS)
    return wide.withColumns({c: F.round(c, 8) for c in _WIDE})


@query(
    "panel_pivot",
    select(_areas_sql(True), f"""SELECT '{SERIES}' AS series_id, date_day, """ + ", ".join(
        f"round(avg(rain) FILTER (subbasin = '{sb}'), 8) AS {sb}" for sb in SUBBASINS)
        + " FROM rain_rows JOIN areas ON area = rain_area GROUP BY 2"),
)
def _(spark, sf_dir):
    rain, soil = _sides(spark, sf_dir, True)
    labels = panel.match_areas(rain, soil).select("series_id", F.col("rain_area").alias("area"), "subbasin")
    wide = panel.pivot_mean(rain.join(labels, ["series_id", "area"]), "rain", SUBBASINS)
    return wide.withColumns({sb: F.round(sb, 8) for sb in SUBBASINS})
