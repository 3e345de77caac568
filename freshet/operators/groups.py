"""Facts of a group, one small row each, joined to the group's rows.

A window over a whole group holds all its rows in one task. Here the facts come from an aggregation with map-side
partials, so a group may hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.session import durable

def join_groups(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per group); null keys match, groups without facts get nulls.

    The facts should be a written table, whose size Spark knows: it broadcasts a small one and joins a large one by its
    keys, where it splits a hot key.
    """
    side = facts.withColumnsRenamed({c: f"_key_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
    return rows.join(side, same, "left").drop(*[f"_key_{c}" for c in by])


def with_facts(df: DataFrame, facts: list[Column], by: list[str]) -> DataFrame:
    """``df`` with aggregates of its groups as columns. ``df`` is read twice, so it should be cheap to read."""
    return join_groups(df, durable(df.groupBy(*by).agg(*facts)), by)
