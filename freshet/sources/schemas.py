"""Typed layouts of the inputs.

CSV columns are read as text and cast with try_cast, so one bad field is a null and not a failed job.
"""

from __future__ import annotations

from pyspark.sql.types import LongType, StructField, StructType

# The ten fields of a log line in file order, as (header in the files, name here).
LOG_FIELDS = [
    ("day", "day"),
    ("pool", "pool"),
    ("elevations (ft)", "elevation_ft"),
    ("storage (2400hr)", "storage_2400"),
    ("releases (power)", "releases_power"),
    ("releases (total)", "releases_total"),
    ("evap inches", "evap_in"),
    ("inflow adj", "inflow_adj"),
    ("rainfall inches (7A to Dam)", "rain_dam_in"),
    ("rainfall inches (7A to BSN)", "rain_bsn_in"),
]

# Layout of a monthly text log. Head lines grew by one from 2018 on.
LOG_HEAD_LINES = 10
LOG_HEAD_LINES_FROM_2018 = 11
LOG_FOOT_LINES = 12

# Headers of the soil and subbasin files.
SOIL_TIME = "time"
SOIL_VALUE = "volumetric_soil_water_layer_1"
SUBBASIN_DATE = "date"
SUBBASIN_AREA = "area_m2_used"
SUBBASIN_RAIN = "rain_mm_aw"
SUBBASIN_SOIL = "sm_aw"

LOG_RENAMES = dict(LOG_FIELDS)
MEASURES = [name for _, name in LOG_FIELDS if name != "day"]

SMALL_TABLE = StructType([StructField(c, LongType()) for c in "ABCDE"])
