"""Column checks with an error that names what is missing."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; found {df.columns}")
    return df


def pick_features(df: DataFrame, requested: list[str]) -> list[str]:
    """The requested features that exist, in request order; warns about the others, fails when none is left."""
    missing = [c for c in requested if c not in df.columns]
    if missing:
        warnings.warn(f"requested features not in the table: {missing}", stacklevel=2)
    kept = [c for c in requested if c in df.columns]
    if not kept:
        raise ValueError("no feature selected")
    return kept
