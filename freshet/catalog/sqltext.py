"""Small helpers for writing the SQL counterparts."""

from __future__ import annotations

from freshet.catalog.tables import DAILY

PART = "PARTITION BY series_id"


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def over(order: str = "date_day", part: str = PART) -> str:
    return f"OVER ({part} ORDER BY {order})"


def rows(start: int, end: int, order: str = "date_day", part: str = PART) -> str:
    """Frame from row t+start to row t+end."""
    edge = lambda k: "CURRENT ROW" if k == 0 else (f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING")
    return f"OVER ({part} ORDER BY {order} ROWS BETWEEN {edge(start)} AND {edge(end)})"


def months_sql(how: str, columns: list[str], name: str = "months", source: str = "daily") -> str:
    """Month table: ``how`` is sum (0 for none) or avg."""
    agg = (lambda c: f"coalesce(sum({c}), 0.0)") if how == "sum" else (lambda c: f"avg({c})")
    cells = ", ".join(f"{agg(c)} AS {c}" for c in columns)
    return f"""{name} AS (
  SELECT series_id, CAST(year(date_day) AS INTEGER) AS year, CAST(month(date_day) AS INTEGER) AS month,
         CAST(date_trunc('month', min(date_day)) AS DATE) AS date, {cells}
  FROM {source} GROUP BY 1, 2, 3)"""


FLOWS = ["rain_dam_in", "rain_bsn_in", "evap_in", "inflow_adj", "releases_total", "storage_2400"]
MONTH_SUMS = DAILY + ", " + months_sql("sum", FLOWS)
MONTH_MEANS = DAILY + ", " + months_sql("avg", FLOWS)
