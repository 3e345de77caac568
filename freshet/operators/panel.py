"""Subbasin panels: area matching, dense date grid, rolling features, weighted means and spreads.

Inputs are (series_id, date_day, area, value). They are first reduced to one row per date and area, so every later
step works on (days x subbasins) rows however many raw readings there were.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.operators.windows import SeriesWindow
from freshet.session import durable

FEATURES = ["arain_7d", "arain_30d", "asm_7d", "asm_30d"]


def daily_area_mean(df: DataFrame, value: str) -> DataFrame:
    """One row per series, date and area; rows lacking date or area are left out."""
    known = df.na.drop(subset=["date_day", "area"])
    return known.groupBy("series_id", "date_day", "area").agg(F.avg(value).alias(value))


def match_areas(rain: DataFrame, soil: DataFrame, match: str = "auto") -> DataFrame:
    """Number the subbasins: (series_id, k, subbasin, rain_area, soil_area, weight).

    ``exact`` keeps the areas found on both sides, ``rank`` pairs the k-th smallest of each side, ``auto`` ranks only
    where a series shares no area. Ranking needs equal counts and fails otherwise. ``weight`` is the area share.
    """
    areas = lambda df, flag: df.select("series_id", "area").na.drop().distinct().withColumn(flag, F.lit(True))
    both = areas(rain, "_rain").join(areas(soil, "_soil"), ["series_id", "area"], "full")
    w = Window.partitionBy("series_id")
    count = lambda cond: F.count(F.when(cond, 1))
    in_rain, in_soil = F.col("_rain").isNotNull(), F.col("_soil").isNotNull()
    counted = both.select(
        "*",
        count(in_rain & in_soil).over(w).alias("_shared"),
        count(in_rain).over(w).alias("_n_rain"),
        count(in_soil).over(w).alias("_n_soil"),
    )
    by_rank = {"auto": F.col("_shared") == 0, "rank": F.lit(True), "exact": F.lit(False)}[match]
    kept = counted.where(by_rank | (in_rain & in_soil))
    upto = w.orderBy("area").rowsBetween(Window.unboundedPreceding, 0)
    numbered = kept.select(
        "*", count(in_rain).over(upto).alias("_k_rain"), count(in_soil).over(upto).alias("_k_soil")
    )
    # an area found on both sides carries two ranks, and each side keeps its own
    rain_side = F.struct(F.col("_k_rain").alias("k"), F.col("area").alias("rain_area"), _no_area("soil_area"))
    soil_side = F.struct(F.col("_k_soil").alias("k"), _no_area("rain_area"), F.col("area").alias("soil_area"))
    ranks = F.array_compact(F.array(F.when(in_rain, rain_side), F.when(in_soil, soil_side)))
    unequal = F.raise_error(F.lit("no shared subbasin area, and the two sides differ in their number of areas"))
    checked = F.when(by_rank & (F.col("_n_rain") != F.col("_n_soil")), unequal.cast("int")).otherwise(0)
    ranked = numbered.select("series_id", checked.alias("_ok"), F.explode(ranks).alias("s"))
    matched = ranked.groupBy("series_id", "s.k").agg(
        F.max("s.rain_area").alias("rain_area"), F.max("s.soil_area").alias("soil_area"), F.max("_ok").alias("_ok")
    )
    return matched.select(
        "series_id",
        (F.col("k") + F.col("_ok")).cast("int").alias("k"),
        F.concat(F.lit("SB"), F.col("k").cast("string")).alias("subbasin"),
        "rain_area",
        "soil_area",
        (F.col("rain_area") / F.sum("rain_area").over(Window.partitionBy("series_id"))).alias("weight"),
    )


def _no_area(name: str):
    return F.lit(None).cast("double").alias(name)


def dense_panel(rain: DataFrame, soil: DataFrame, areas: DataFrame) -> DataFrame:
    """(series_id, date_day, k, subbasin, weight, rain, soil) for every date of either side and every subbasin.

    Missing rain is 0, missing soil stays null. ``rain`` and ``soil`` are daily area means.
    """
    side = lambda df, area, value: df.join(
        areas.select("series_id", "k", F.col(area).alias("area")), ["series_id", "area"]
    ).select("series_id", "date_day", "k", value)
    known = side(rain, "rain_area", "rain").unionByName(side(soil, "soil_area", "soil"), allowMissingColumns=True)
    # dates with readings of unmatched areas only are not part of the grid
    cell = known.groupBy("series_id", "date_day", "k").agg(F.max("rain").alias("rain"), F.max("soil").alias("soil"))
    # at most one entry per subbasin
    by_date = cell.groupBy("series_id", "date_day").agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("rain", "soil")))).alias("_cells")
    )
    labels = areas.groupBy("series_id").agg(F.collect_list(F.struct("k", "subbasin", "weight")).alias("_subbasins"))
    grid = by_date.join(labels, "series_id").select(
        "series_id", "date_day", "_cells", F.explode("_subbasins").alias("s")
    )
    value = F.try_element_at("_cells", F.col("s.k"))
    return grid.select(
        "series_id",
        "date_day",
        "s.k",
        "s.subbasin",
        "s.weight",
        F.coalesce(value["rain"], F.lit(0.0)).alias("rain"),
        value["soil"].alias("soil"),
    )


def panel_cells(rain: DataFrame, soil: DataFrame, areas: DataFrame) -> DataFrame:
    """(series_id, date_day, k, rain, soil): the readings of either side, by subbasin; no row where there is none.

    ``rain`` and ``soil`` are daily area means, ``areas`` a written table.
    """
    side = lambda df, area, value: df.join(
        areas.select("series_id", "k", F.col(area).alias("area")), ["series_id", "area"]
    ).select("series_id", "date_day", "k", value)
    return side(rain, "rain_area", "rain").unionByName(side(soil, "soil_area", "soil"), allowMissingColumns=True)


def panel_dates(cells: DataFrame) -> DataFrame:
    """(series_id, date_day, i): the dates of a series' readings, numbered in order; the calendar bounds them."""
    dates = cells.groupBy("series_id").agg(F.array_sort(F.collect_set("date_day")).alias("_dates"))
    return dates.select("series_id", F.posexplode("_dates").alias("i", "date_day")).select("series_id", "date_day", "i")


def subbasin_windows(rain: DataFrame, soil: DataFrame, areas: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """What ``rolling_panel`` of the dense panel gives, without building that panel.

    Readings carry the number of their date among all dates of the series, and windows reach back by that number, so
    dates without a reading need no row. Rows are added only for the dates that are ``asked`` for (series_id,
    date_day), by default all dates; each asked date has every subbasin. One exchange by series and subbasin serves
    merging and windows. ``areas`` is a written table.
    """
    cells = panel_cells(rain, soil, areas)
    dates = durable(panel_dates(cells))
    wanted = dates if asked is None else dates.join(asked.select("series_id", "date_day").distinct(), ["series_id", "date_day"], "left_semi")
    empty = wanted.join(areas.select("series_id", "k"), "series_id").select("series_id", "date_day", "i", "k", F.lit(True).alias("_asked"))
    placed = cells.join(dates, ["series_id", "date_day"]).unionByName(empty, allowMissingColumns=True)
    merged = placed.repartition("series_id", "k").groupBy("series_id", "k", "i", "date_day").agg(
        F.coalesce(F.max("rain"), F.lit(0.0)).alias("rain"), F.max("soil").alias("soil"), F.max("_asked").alias("_asked")
    )
    back = lambda n: Window.partitionBy("series_id", "k").orderBy("i").rangeBetween(1 - n, 0)
    rolled = merged.select(
        "series_id", "date_day", "k", "_asked",
        *[F.sum("rain").over(back(n)).alias(f"arain_{n}d") for n in (7, 30)],
        *[F.avg("soil").over(back(n)).alias(f"asm_{n}d") for n in (7, 30)],
    ).where("_asked")
    return rolled.join(areas.select("series_id", "k", "subbasin", "weight"), ["series_id", "k"]).select(
        "series_id", "date_day", "subbasin", "weight", *FEATURES
    )


def rolling_panel(dense: DataFrame) -> DataFrame:
    """Per-subbasin rain sums and soil means over 7 and 30 rows."""
    w = SeriesWindow(["series_id", "subbasin"], ["date_day"])
    return dense.select(
        "series_id",
        "date_day",
        "subbasin",
        "weight",
        w.rolling_sum("rain", 7).alias("arain_7d"),
        w.rolling_sum("rain", 30).alias("arain_30d"),
        w.rolling_mean("soil", 7).alias("asm_7d"),
        w.rolling_mean("soil", 30).alias("asm_30d"),
    )


def basin_summary(panel: DataFrame) -> DataFrame:
    """Area-weighted features and their spread (sample standard deviation) across subbasins, per date."""
    return panel.groupBy("series_id", "date_day").agg(*_summary())


def _summary() -> list[Column]:
    return [
        *[F.coalesce(F.sum(F.col("weight") * F.col(c)), F.lit(0.0)).alias(c.replace("_", "_weighted_", 1))
          for c in FEATURES],
        F.stddev_samp("arain_7d").alias("arain_spread_7d"),
        F.stddev_samp("asm_30d").alias("asm_spread_30d"),
    ]


def cell_name(name: str) -> tuple[str, str] | None:
    """(feature, subbasin) of a column such as ``arain_SB4_7d``; None for other names."""
    parts = re.fullmatch(r"(arain|asm)_(SB[0-9]+)_(7d|30d)", name)
    return (f"{parts[1]}_{parts[3]}", parts[2]) if parts else None


def named_panel(panel: DataFrame, areas: DataFrame, names: list[str]) -> DataFrame:
    """One row per date with the basin summary and those of the requested cells whose subbasin exists, by their names.

    The request decides the columns: of the areas, only the subbasins that it names are looked up.
    """
    cells = {n: cell_name(n) for n in names if cell_name(n)}
    asked = sorted({sb for _, sb in cells.values()})
    found = {r["subbasin"] for r in areas.where(F.col("subbasin").isin(asked)).select("subbasin").distinct().collect()} if asked else set()
    values = [F.max(F.when(F.col("subbasin") == sb, F.col(c))).alias(n) for n, (c, sb) in cells.items() if sb in found]
    return panel.groupBy("series_id", "date_day").agg(*_summary(), *values)


def wide_panel(panel: DataFrame, subbasins: list[str], columns: list[str] = FEATURES) -> DataFrame:
    """One row per date with columns such as ``arain_SB1_7d``, for the listed subbasins in list order."""
    cell = lambda c, sb: F.max(F.when(F.col("subbasin") == sb, F.col(c))).alias(c.replace("_", f"_{sb}_", 1))
    return panel.groupBy("series_id", "date_day").agg(*[cell(c, sb) for c in columns for sb in subbasins])


def pivot_mean(df: DataFrame, value: str, subbasins: list[str]) -> DataFrame:
    """Mean value as a date x subbasin table."""
    return df.groupBy("series_id", "date_day").pivot("subbasin", subbasins).agg(F.avg(value))


def subbasin_labels(areas: DataFrame) -> list[str]:
    """Labels in rank order; a basin has a handful."""
    ranked = areas.groupBy("k", "subbasin").agg(F.count(F.lit(1)).alias("n")).orderBy("k")
    return [r["subbasin"] for r in ranked.collect()]
