"""Column names of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Score names in result files.
SCORE_NAMES = {
    "mae": "MAE",
    "rmse": "RMSE",
    "r2": "R2",
    "nse": "NSE",
    "flood_threshold": "FloodThreshold",
    "flood_n": "FloodN",
    "flood_mae": "FloodMAE",
    "flood_rmse": "FloodRMSE",
    "event_threshold": "EventThreshold",
    "event_n": "EventN",
    "event_recall": "EventRecall",
    "event_precision": "EventPrecision",
}

# Columns of the scenario table.
SCENARIO_NAMES = {"scenario": "Scenario", "predicted_inflow": "Predicted Inflow"}

# Columns of the simulated next-month inflow.
SIMULATION_NAMES = {
    "year": "Year (used)",
    "month": "Month used for rainfall",
    "simulated_rain": "Simulated rainfall__1",
    "predicted_inflow": "Predicted inflow__1",
}


def score_report(scores: DataFrame) -> DataFrame:
    return scores.withColumnsRenamed({k: v for k, v in SCORE_NAMES.items() if k in scores.columns})


def scenario_report(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumnsRenamed(SCENARIO_NAMES)


def simulation_report(simulated: DataFrame) -> DataFrame:
    return simulated.select("series_id", *[F.col(c).alias(name) for c, name in SIMULATION_NAMES.items()])
