"""Reservoir-like inputs derived from the driver's tables, and the same derivations in SQL.

The driver's data holds no hydrology, so orders play the inflow, line items the rain and losses, regions the
subbasins and events the soil sensor. Money is counted in cents and rates in hundredths: sums of whole numbers are
exact in any order, so both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SERIES = "basin"
TRAIN_END, VAL_END = 1998, 2000
HEAVY = 600.0
SOIL_SHIFT_DAYS = 8400  # moves the sensor's month from January 2024 to January 2001, into the span of the log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    # rint is one machine instruction; round() on doubles goes through BigDecimal
    return F.rint(F.col(column) * 100)


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day with orders or shipments.

    Each table shrinks to one row per day before the two meet, so the join handles days, not raw rows.
    """
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date_day")).agg(
        F.count(F.lit(1)).cast("double").alias("elevation_ft"),
        F.max_by(cents("o_totalprice"), "o_orderkey").alias("storage_2400"),
        F.sum(cents("o_totalprice")).alias("inflow_adj"),
    )
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date_day")).agg(
        F.sum(F.col("l_linenumber").cast("double")).alias("releases_power"),
        F.sum(cents("l_tax")).alias("releases_total"),
        F.sum(cents("l_discount")).alias("evap_in"),
        F.sum(F.floor(F.col("l_extendedprice") / 1000).cast("double")).alias("rain_dam_in"),
        F.sum("l_quantity").alias("rain_bsn_in"),
    )
    return orders.join(shipped, "date_day", "full").select(F.lit(SERIES).alias("series_id"), "*")


DAILY = f"""
ord AS (
  SELECT CAST(o_orderdate AS DATE) AS date_day, CAST(count(*) AS DOUBLE) AS elevation_ft,
         arg_max(round(o_totalprice * 100), o_orderkey) AS storage_2400, sum(round(o_totalprice * 100)) AS inflow_adj
  FROM orders GROUP BY 1),
shp AS (
  SELECT CAST(l_shipdate AS DATE) AS date_day, CAST(sum(l_linenumber) AS DOUBLE) AS releases_power,
         sum(round(l_tax * 100)) AS releases_total, sum(round(l_discount * 100)) AS evap_in,
         sum(floor(l_extendedprice / 1000)) AS rain_dam_in, sum(l_quantity) AS rain_bsn_in
  FROM lineitem GROUP BY 1),
daily AS (
  SELECT '{SERIES}' AS series_id, coalesce(ord.date_day, shp.date_day) AS date_day, elevation_ft, storage_2400,
         inflow_adj, releases_power, releases_total, evap_in, rain_dam_in, rain_bsn_in
  FROM ord FULL JOIN shp ON ord.date_day = shp.date_day)"""


def priority_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily inflow of five series, one per order priority."""
    day = F.col("o_orderdate").cast("date").alias("date_day")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day).agg(
        F.sum(cents("o_totalprice")).alias("inflow_adj")
    )


PRIORITY = """
prio AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date_day,
         sum(round(o_totalprice * 100)) AS inflow_adj
  FROM orders GROUP BY 1, 2)"""


def soil_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings, moved into the span of the log."""
    shifted = F.col("ts") - F.make_dt_interval(days=F.lit(SOIL_SHIFT_DAYS))
    return table(spark, sf_dir, "events").select(
        F.lit(SERIES).alias("series_id"), shifted.alias("time"), cents("value").alias("soil")
    )


SOIL = f"""
soil AS (
  SELECT '{SERIES}' AS series_id, ts - INTERVAL {SOIL_SHIFT_DAYS} DAY AS time, round(value * 100) AS soil FROM events)"""


def _exact_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area by region, the same on both sides: number of nations plus a tenth of the region key."""
    by_region = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return by_region.select("n_regionkey", (F.col("n") + F.col("n_regionkey") / 10.0).alias("area"))


def _balance_areas(spark: SparkSession, sf_dir: str, name: str, nation: str, balance: str) -> DataFrame:
    """Area by region from account balances, which the two sides do not share."""
    nations = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, name).join(nations, F.col(nation) == F.col("n_nationkey"))
        .groupBy("n_regionkey").agg(F.sum(cents(balance)).alias("area"))
    )


def rain_by_area(spark: SparkSession, sf_dir: str, exact: bool = True) -> DataFrame:
    """(series_id, date_day, area, rain) per order, by the region of its customer.

    The region is attached to the customers first. Customers may be many and one of them hot, so no broadcast is
    forced: Spark sends the table whole only below its size limit and splits a hot key when it sorts and merges.
    """
    areas = _exact_areas(spark, sf_dir) if exact else _balance_areas(spark, sf_dir, "customer", "c_nationkey", "c_acctbal")
    nations = table(spark, sf_dir, "nation").join(areas, "n_regionkey").select("n_nationkey", "area")
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf_dir, "orders").join(
        people.select("c_custkey", "area"), F.col("o_custkey") == F.col("c_custkey")
    )
    return orders.select(
        F.lit(SERIES).alias("series_id"),
        F.col("o_orderdate").cast("date").alias("date_day"),
        "area",
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("rain"),
    )


def soil_by_area(spark: SparkSession, sf_dir: str, exact: bool = True) -> DataFrame:
    """(series_id, date_day, area, soil) per line item, by the region of its supplier."""
    areas = _exact_areas(spark, sf_dir) if exact else _balance_areas(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal")
    nations = table(spark, sf_dir, "nation").join(areas, "n_regionkey").select("n_nationkey", "area")
    makers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf_dir, "lineitem").join(
        makers.select("s_suppkey", "area"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return lines.select(
        F.lit(SERIES).alias("series_id"),
        F.col("l_shipdate").cast("date").alias("date_day"),
        "area",
        F.col("l_quantity").alias("soil"),
    )


def _area_sql(exact: bool) -> str:
    if exact:
        one = "SELECT n_regionkey, count(*) + n_regionkey / 10.0 AS area FROM nation GROUP BY n_regionkey"
        return f"rain_areas AS ({one}), soil_areas AS ({one})"
    side = lambda t, k, b: (
        f"SELECT n_regionkey, sum(round({b} * 100)) AS area FROM {t} JOIN nation ON {k} = n_nationkey GROUP BY 1"
    )
    return (
        f"rain_areas AS ({side('customer', 'c_nationkey', 'c_acctbal')}), "
        f"soil_areas AS ({side('supplier', 's_nationkey', 's_acctbal')})"
    )


def panel_sql(exact: bool) -> str:
    return f"""
{_area_sql(exact)},
rain_rows AS (
  SELECT CAST(o_orderdate AS DATE) AS date_day, CAST(a.area AS DOUBLE) AS area, avg(floor(o_totalprice / 1000)) AS rain
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
       JOIN rain_areas a ON a.n_regionkey = n.n_regionkey GROUP BY 1, 2),
soil_rows AS (
  SELECT CAST(l_shipdate AS DATE) AS date_day, CAST(a.area AS DOUBLE) AS area, avg(l_quantity) AS soil
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n_nationkey
       JOIN soil_areas a ON a.n_regionkey = n.n_regionkey GROUP BY 1, 2)"""
