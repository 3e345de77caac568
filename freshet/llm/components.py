"""Connected components of a link table by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import durable


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); component is the smallest id that is reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so paths shorten by a
    power of two. Labels are written to the shared folder after each round; a lost executor costs one round. Null ids
    and self links are ignored; an empty table gives no rows.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    links = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(
        links.groupBy(F.col("a").alias("id"))
        .agg(F.min("b").alias("near"))
        .select("id", F.least("id", "near").alias("label"), F.lit(True).alias("moved"))
    )
    for _ in range(max_rounds):
        near = (
            links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("of_a")), "a")
            .groupBy(F.col("b").alias("id"))
            .agg(F.min("of_a").alias("near"))
        )
        step = labels.select("id", "label").join(near, "id").select(
            "id", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        labels = durable(
            step.join(jump, "next", "left").select(
                "id",
                F.least("next", F.coalesce("beyond", "next")).alias("label"),
                (F.least("next", F.coalesce("beyond", "next")) < F.col("label")).alias("moved"),
            )
        )
        if labels.filter("moved").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
